import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sylva.llm.chat import ChatTemplate, format_conversations, masked_text, parse_formatted
from sylva.llm.queries_native import OP4_SQL, op4_chat_format

HARD = ["", "\\", "\\s", "\\\\h", "###", "####", "\\###", "</turn>", "</turn", "</turn>\n", "### Assistant: ", "\\e</turn>\\", "a\nb", ": ", "é 日本", "<</turn>>", "#" * 50, "\\c:"]
SCHEMA = "conv_id long, turn long, role string, text string"


def outputs(spark, rows, template=None):
    df = spark.createDataFrame(rows, SCHEMA)
    out = format_conversations(df, template)
    return {r["conv_id"]: r for r in out.select("*", parse_formatted(F.col("formatted"), template).alias("back"), masked_text(F.col("segments"), template).alias("masked")).collect()}


def test_round_trip_of_hard_texts(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "judge", "a: b", "", "@x", "###", "</turn>"]), "".join(rng.choice(HARD) for _ in range(rng.randrange(4)))) for _ in range(rng.randrange(1, 7))]
        want[c] = turns
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    got = outputs(spark, rows)
    for c, turns in want.items():
        assert [(x["role"], x["text"]) for x in got[c]["back"]] == turns
        assert got[c]["masked"] == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        assert sum(s["loss"] for s in got[c]["segments"]) == sum(r == "assistant" for r, _ in turns)
        # texts hold no mark of the template
        assert got[c]["formatted"].count("</turn>\n") == len(turns)


@pytest.mark.parametrize(
    "roles,valid",
    [("u", True), ("ua", True), ("sua", True), ("uaua", True), ("a", False), ("s", False), ("uu", False), ("usu", False), ("uata", True), ("uat", False), ("uattau", True), ("ut", False), ("ux", False)],
)
def test_turn_order(spark, roles, valid):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool", "x": "other"}
    assert outputs(spark, [(1, k, names[r], "t") for k, r in enumerate(roles)])[1]["valid"] == valid


def test_other_template(spark):
    t = ChatTemplate(open="<|", sep="|>", close="<|end|>", escape="~", trained=("assistant", "tool"))
    rows = [(1, 0, "user", "a <| ~ <|end|>"), (1, 1, "tool", "~s"), (1, 2, "assistant", "x|>y")]
    got = outputs(spark, rows, t)[1]
    assert [(x["role"], x["text"]) for x in got["back"]] == [r[2:] for r in rows]
    assert got["masked"] == "~sx|>y"


def test_cases(spark, clash, same):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (None, 0, "user", "n"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 0, "user", "long " * 20_000)]
    got = outputs(spark, rows)
    assert [(x["role"], x["text"]) for x in got[1]["back"]] == [("user", ""), ("", "x")]
    assert [x["text"] for x in got[2]["back"]] == ["a", "a", "b"]
    assert got[None]["valid"] and got[3]["back"][0]["text"] == "long " * 20_000
    df = spark.createDataFrame(rows, SCHEMA)
    assert format_conversations(df.limit(0)).count() == 0
    same(format_conversations(clash(df)), format_conversations(df))


def test_native(spark, tiny):
    plan = op4_chat_format(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query(spark, tiny):
    from .oracles import assert_same

    assert_same(spark, tiny, op4_chat_format, OP4_SQL)
    row = op4_chat_format(spark, tiny).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
