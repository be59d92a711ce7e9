"""Personal data (operator 3): candidate gradient boosting.

Rules of high recall propose overlapping spans. Those of the base kinds (email, ip, card, phone) are
kept as their formats say. All other proposals - credentials, national phone numbers, social
security numbers, bank accounts - are scored by boosted trees over format and context features; the
scores are calibrated on examples that the trees have not seen, and each kind keeps the spans above
the lowest threshold that gives the asked precision there. Kept spans do not overlap base spans or
each other: a credential with its name stays as a whole, of others the likelier one.

There are no labels for personal data in the tables, so the trees learn from EXAMPLES written spans
in written contexts (seeded, the same each time), half of them look-alikes: hashes, versions, dates,
amounts, order numbers.

The rules of one kind also fit spans of another (a social security number looks like a telephone number), so
those are examples against that kind.

Defined results: null is empty; a text without candidates has no spans; repeated rows and rows with a null id are each
scanned; equally likely spans go to the one proposed first; a very long text is scanned whole by rules that are linear in its
length; an empty table gives no rows; columns beside those named, whatever their names, are not read, or kept as they are
where documents are redacted. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, platt
from .common import received, send

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "tel", "ssn", "iban")
#: Examples that are written for each added kind, and the share of kept ones that must be right.
EXAMPLES, PRECISION = 800, 0.99
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A named value: in quotes everything up to the closing one in its line, else up to a space or separator. Possessive, so linear at any length.
_KEYED = re.compile(
    r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:[\"'](?=\s*+[=:]))?\s*+[=:]\s*+"
    r"(?:\"(?=[^\"\n]{4})(?P<double>(?:[^\"\\\n]++|\\[^\n])*+)\"|'(?=[^'\n]{4})(?P<single>(?:[^'\\\n]++|\\[^\n])*+)'|[\"']?+(?P<plain>[^\s\"',;]{4,}+))"
)
_RULES = (
    ("secret", _KEYED),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+")),
    ("tel", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,6}\)|[0-9]{2,9})(?:[\x20./-]{1,2}[0-9]{2,9}){1,4}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
)
_PART = re.compile(r"[_/+-]")
#: Beginnings that issuers give their keys (fixed values).
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "eyJ")
#: Words before a span that speak for it, at the begin of a word, and against it, as whole words (fixed values).
_HINTS = ("pass", "pwd", "secret", "token", "key", "tel", "phone", "call", "fax", "mobil", "ssn", "social", "iban", "bank", "account", "konto", "cuenta", "compte")
_AGAINST = ("sha", "hash", "commit", "md5", "checksum", "integrity", "version", "v", "isbn", "date", "order", "invoice", "page", "pages", "fig", "id", "no", "total", "eur", "usd", "sha1", "sha256")
_FOR, _CONTRARY = (re.compile(rf"(?<![a-z])(?:{'|'.join(words)}){end}") for words, end in ((_HINTS, ""), (_AGAINST, "(?![a-z0-9])")))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind that pass its test, by start, then kind."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(BASE[k], s, e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the rules propose, overlaps included."""
    digits = _DIGIT.search(text)
    return [(kind, m.start(), m.end()) for kind, rule in _RULES if digits or kind == "secret" for m in rule.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    n = len(span)
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits = [c for c in span if "0" <= c <= "9"]
    upper, lower = sum("A" <= c <= "Z" for c in span), sum("a" <= c <= "z" for c in span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    head = span[:40].lower()
    keyed = _KEYED.fullmatch(span) if kind == "secret" else None
    value = keyed[keyed.lastgroup] if keyed else span
    return [
        float(ADDED.index(kind)), float(n), entropy, len(digits) / n, upper / n, lower / n,
        sum(c in "0123456789abcdef" for c in span) / n, float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)), float(len(digits)),
        float(span.count("-")), float(span.count(".")), float(span.count("/")), float("=" in span or ":" in span), float(any(x in head for x in _HINTS[:5])),
        float(_FOR.search(before) is not None), float(_CONTRARY.search(before) is not None), float(span[:4].isupper() and span[:4].isalpha()),
        float(start > 0 and text[start - 1] in "\"'"), float(len(set(map(str.isdigit, span))) == 2 and upper > 0), _mod97(span) if kind == "iban" else 0.0,
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False)) / n), float(span[0] == "("), float(groups[0] > 1900 if groups and len(groups) == 1 else 0),
        float(keyed is not None), float(keyed is not None and keyed.lastgroup != "plain"), float(keyed is not None and "=" in span[: keyed.start(keyed.lastgroup)]), float(len(value)), float(value.islower() and value.isalpha()),
        float(any(c in "(.[{$<" for c in value)), float(sum(a.islower() != b.islower() for a, b in zip(value, value[1:], strict=False)) / n), float(max(map(len, _PART.split(value)))), float(sum(c in "_/+-" for c in value) / n), float(value.startswith(_ISSUED)),
    ]


def _mod97(span: str) -> float:
    s = span.replace(" ", "")
    return float(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1)


def _written(rng: np.random.Generator) -> tuple[list[list[float]], list[int], list[str]]:
    """Features and labels of written examples."""

    def some(chars: str, n: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), n))

    digit, hexa, letters = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    capitals = letters.upper()
    pick = lambda *x: x[rng.integers(0, len(x))]

    def word() -> str:
        return some(letters, int(rng.integers(2, 9)))

    def capital() -> str:
        return some(capitals, 1)

    def key() -> str:
        name = pick("password", "passwd", "pwd", "secret", "token", "api_key", "access_key")
        return pick(name, name.upper(), name.title(), f'"{name}"') + pick("=", ": ", " = ", ":")

    def quoted(value: str) -> str:
        mark = pick('"', '"', "'")
        return mark + value + mark

    def long() -> str:
        pieces = [some(letters + capitals + digit + "_-", int(rng.integers(20, 300))) for _ in range(3)]
        return ".".join(pieces) if rng.random() < 0.5 else "".join(pieces)

    def iban() -> str:
        country, body = pick("DE", "FR", "ES", "GB"), some(digit, int(rng.integers(14, 21)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    yes = {
        "secret": lambda: pick("", "", word() + " ") + pick(
            pick("password", "passwd", "secret", "token", "api_key") + pick("=", ": ", " = ") + some(hexa, int(rng.integers(10, 33))),
            pick("AKIA", "ASIA") + some(pick(capitals, capitals + digit), 16), pick("ghp_", "sk_live_", "xoxb-") + some(letters + capitals + digit, int(rng.integers(20, 40))),
            pick("key ", "token ", "secret ") + some(letters + capitals + digit, 32), pick("password", "pwd") + "=" + some(letters + digit, 10),
            key() + quoted(some(hexa, pick(32, 40, 64))), key() + quoted(some(letters + capitals + digit + "!@#$%&*.", int(rng.integers(6, 24)))), key() + quoted(pick(word() + word() + word(), word() + " " + word() + " " + word(), some(letters + capitals, int(rng.integers(6, 40))))),
            pick("password", "pwd", "secret") + pick("=", " = ") + pick(some(letters, int(rng.integers(6, 14))), some(letters + capitals + "!@#%&*", int(rng.integers(8, 20)))),
            key() + pick("", '"') + long(), pick("", "key ", "token ", "Bearer ") + long(), pick("sk_live_", "ghp_", "key ", "token ") + some(letters + capitals, int(rng.integers(24, 40)))),
        "tel": lambda: pick("call ", "tel ", "phone: ", "mobile ", "") + f"({some(digit, 3)}) {some(digit, 3)}-{some(digit, 4)}" if rng.random() < 0.5 else pick("call ", "tel. ", "tel ", "fax ", "phone ") + pick(f"{some(digit, 3)} {some(digit, 3)} {some(digit, 4)}", f"0{some(digit, 3)} {some(digit, int(rng.integers(5, 9)))}", f"0{some(digit, 2)}/{some(digit, int(rng.integers(6, 9)))}", f"0{some(digit, 4)}-{some(digit, 6)}"),
        "ssn": lambda: pick("ssn ", "social security ", "", "") + f"{some('12345678', 3)}-{some(digit, 2)}-{some(digit, 4)}",
        "iban": lambda: pick("iban ", "account ", "konto ", "") + iban(),
    }
    no = {
        "secret": lambda: pick(
            pick("sha256:", "commit ", "hash ", "md5 ", '"') + some(hexa, pick(32, 40, 64)), "https-" + word() + "-" + word() + "-" + some(digit, 4),
            pick("token: ", "password: ") + word(), some(digit, int(rng.integers(16, 30))), word() + "_" + word() + "_" + word() + some(digit, 2), "id " + some(digit, 8) + "-" + some(digit, 8),
            pick("token", "secret", "key", "password") + pick(" = ", "=", ": ") + word() + pick(".", "(", "[") + word() + pick("()", ")", "]", "." + word()), pick("token: ", "password: ", "secret: ", "Token: ") + pick("the ", "and ", "a ") + word(),
            pick("", "/") + pick("/", "-", "_", "+").join(word() for _ in range(int(rng.integers(3, 30)))), pick("", "", capital()) + word() + word() + word() + word(), some(pick("-", "_", "/", "a", "x", "=-"), int(rng.integers(16, 300))), some(capitals, int(rng.integers(16, 24)))),
        "tel": lambda: pick(
            f"{some('12', 1)}{some(digit, 3)}-{some('01', 1)}{some(digit, 1)}-{some('012', 1)}{some(digit, 1)}", f"{some(digit, 2)}/{some(digit, 2)}/20{some(digit, 2)}",
            f"pages {some(digit, 3)}-{some(digit, 3)}", f"version {some(digit, 2)}.{some(digit, 2)}.{some(digit, 3)}", f"order {some(digit, 4)} {some(digit, int(rng.integers(3, 9)))}", pick("invoice ", "id ", "no. ") + f"{some(digit, 4)}-{some(digit, int(rng.integers(5, 9)))}", f"total {some(digit, 3)} {some(digit, 3)}", f"{some(digit, 2)} {some(digit, 2)}", " ".join(some(digit, 4) for _ in range(4))),
        "ssn": lambda: pick("order ", "invoice ", "id ") + f"{some(digit, 3)}-{some(digit, 2)}-{some(digit, 4)}",
        "iban": lambda: pick("", "order ", "id ") + pick(*"AB") + pick(*"XY") + some(digit, 2) + some(capitals + digit, 16),
    }
    x, y, kinds = [], [], []
    for label, makers in ((1, yes), (0, no)):
        for kind, make in makers.items():
            for _ in range(EXAMPLES):
                lead = " ".join(word() for _ in range(6)) + " "
                text = lead + make() + pick(" ", ". ", "\n", '"') + word()
                # what one kind's span looks like to the rules of another kind counts against that one
                for k, s, e in candidates(text):
                    x.append(features(text, k, s, e))
                    y.append(label if k == kind else 0)
                    kinds.append(k)
    return x, y, kinds


class SpanModel:
    """Boosted trees, their calibration and a threshold for each added kind."""

    def __init__(self, seed: int = 11):
        x, y, kinds = _written(np.random.default_rng(seed))
        x, y, kinds = np.array(x), np.array(y, float), np.array(kinds)
        seen = np.random.default_rng(seed + 1).random(len(y)) < 0.6
        self.trees = BoostedTrees().fit(x[seen], y[seen])
        margin = self.trees.margin(x[~seen])
        self.a, self.b = platt(margin, y[~seen])
        p = self._probability(margin)
        self.thresholds = {}
        for kind in ADDED:
            own = kinds[~seen] == kind
            scores, truth = p[own], y[~seen][own]
            order = np.argsort(-scores, kind="stable")
            right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
            # a cut below the last right span would take in wrong ones alone
            good = np.flatnonzero((right >= PRECISION) & (truth[order] == 1))
            # half way to the best score that is left out, so that a like span on neither side of it is decided by chance
            last = good[-1] if len(good) else -1
            below = float(scores[order[last + 1]]) if last + 1 < len(order) else 0.0
            self.thresholds[kind] = (float(scores[order[last]]) + below) / 2 if len(good) else 2.0

    def _probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -50, 50)))

    def spans(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """All kept spans of a whole text, by start, then kind."""
        if not text:
            return []
        kept = [(k, s, e, 1.0) for k, s, e in base_spans(text)]
        if proposed := candidates(text):
            p = self._probability(self.trees.margin(np.array([features(text, *c) for c in proposed])))
            taken = _merged((s, e) for _, s, e, _ in kept)
            # a named value goes as a whole, before what lies in it, and is as likely as the likeliest secret in it
            named = [i for i, (k, s, e) in enumerate(proposed) if k == "secret" and _KEYED.fullmatch(text, s, e)]
            ends, at = [proposed[i][2] for i in named], 0
            for i, (k, s, e) in enumerate(proposed):
                if k == "secret" and (at := bisect.bisect_left(ends, e)) < len(named) and proposed[named[at]][1] <= s:
                    p[named[at]] = max(p[named[at]], p[i])
            first = np.zeros(len(p), bool)
            first[named] = p[named] >= self.thresholds["secret"]
            for i in np.lexsort((-p, ~first)):
                kind, s, e = proposed[i]
                if p[i] >= self.thresholds[kind] and _free(taken, s, e):
                    kept.append((kind, s, e, float(p[i])))
        order = {k: i for i, k in enumerate(BASE + ADDED)}
        return sorted(kept, key=lambda x: (x[1], order[x[0]], x[2]))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether the span overlaps none of the separate spans that are taken; then it is taken too."""
    k = bisect.bisect_left(taken, (start, end))
    if any(s < end and start < e for s, e in taken[max(0, k - 1) : k + 1]):
        return False
    taken.insert(k, (start, end))
    return True


def redacted(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scan(model, redact: bool) -> object:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: SpanModel = received(model)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t.as_py() for t in batch.column(at)]
            spans = [m.spans(t) for t in texts]
            cols = list(batch.columns)
            if redact:
                cols[at] = pa.array([redacted(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names)
            else:
                cols[at] = pa.array([[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays(cols, ["spans" if n == "text" else n for n in batch.schema.names])

    return run


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of each row of docs (doc_id, text)."""
    model = send(docs.sparkSession, SpanModel())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan(model, False), f"doc_id long, spans {SPAN_TYPE}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced, n_chars (if there) counted anew, other columns as they are."""
    model = send(docs.sparkSession, SpanModel())
    out = docs.mapInArrow(_scan(model, True), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
