import random

import pytest

LANGS = {
    "en": "the of and to in that with this from which river stone window garden letter morning".split(),
    "fr": "le la les des une que pour dans avec sur rivière pierre fenêtre jardin lettre matin".split(),
    "de": "der die das und nicht mit von für auf ist fluss stein fenster garten brief morgen".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with what the operators must stand: null, empty, blank, short, long, repeated."""
    rng = random.Random(7)
    out = [None, "", " \t\n", "one", "Drei kleine Worte hier", "日本語 テキスト", "\ud800".encode("utf-8", "replace").decode(), "!!! ???", "a" * 50_000, " ".join(["x"] * 5_000)]
    out += [prose(rng, lang, n) for lang in LANGS for n in (3, 40, 200, 3_000)]
    return [*out, out[-1], out[-2]]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents rows over the texts, with a repeated row, a null id, null sources and languages."""
    rows = [(k, t, ["en", "fr", "de", None][k % 4], ["a", "b", None][k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [rows[-1], (None, "a row without an id, but with words enough for shingles", None, None, 3)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


CLASHING = ("root", "v", "bucket", "comp", "score", "row", "kept", "spans", "key", "size", "n", "sig", "cell", "rank", "host", "valid", "words", "taken", "x", "code")


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})

    return add


def plain(rows) -> list:
    return sorted(map(repr, map(tuple, rows)))


@pytest.fixture(scope="session")
def same():
    """Whether two DataFrames hold the same rows, however often each."""

    def check(a, b):
        assert a.columns == b.columns
        assert plain(a.collect()) == plain(b.collect())

    return check
