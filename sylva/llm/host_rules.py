"""Quality rules (operator 13): measures of each text, failures counted by host, host verdicts joined back.

Each rule says of a document whether it fails. Failures are added up for each host, and a host's rate is shrunk towards the rate of all
hosts by a beta prior whose strength is estimated from the hosts themselves (moments of the beta-binomial distribution): hosts that
differ no more than chance all get the common rate, a host of few documents stays near it, one of many keeps its own. A host is
refused if the shrunk rate of any rule is above MAX_RATE; its documents are not kept, nor are those that fail the base rules themselves.

A text is measured in its row by array functions: the hashes of its 5-word windows say whether any comes twice, and only then are
they sorted with their places. Measures are written once; failures are partial sums before the shuffle. Hosts that hold more than a
share of 1 / HOT_SHARE of the documents are fewer than HOT_SHARE and are broadcast; all others are joined by a shuffle in which no key is larger than
that. The prior is a row for each rule. DataFrame functions only.

Defined results: a null text has no words, fails base_failed, and counts for its host; a null source is no host: its documents are judged by the
base rules alone and count nowhere; a source with :// counts as its host, A-Z lower-cased, any other as it is; repeated rows and null
ids are judged and counted each on its own; a rate equal to MAX_RATE is not above it; a very long text is measured whole in its row;
an empty table gives no rows; columns other than doc_id, text and source, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .urls import host_of

#: Words of a window.
WINDOW = 5
#: White space between words (fixed values), and the characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "[#*$%&|<>]"
#: The shrunk rate of failures above which a host is refused.
MAX_RATE = 0.5
#: Hosts with more than this part of the documents are joined by a broadcast.
HOT_SHARE = 10_000

#: (name, condition on the measures): the document fails.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("same_lines", "100 * n_dup_lines > 30 * n_lines"),
)
#: Rules that a document itself must not fail.
BASE_RULES = ("few_words", "repeated")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def _window_hashes(words: Column) -> Column:
    """A hash for each window, in order."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = _bound(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words in the windows whose hash comes twice: each place counts the words up to the next one, all of its window at most."""

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1).h == x.h) | (F.get(s, i + 1).h == x.h))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def words(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(ordered, lambda s: _bound(places(s), words))).otherwise(F.lit(0).cast("long"))


def text_measures(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words> of a text, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def measures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("own"))).alias("lines"),
            _bound(_window_hashes(w), _covered).alias("n_repeat_words"),
        )

    return _bound(words_of(text), measures)


def source_host(source: Column) -> Column:
    return F.when(F.instr(source, "://") > 0, host_of(source)).otherwise(source)


def document_measures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the measures of each row."""
    measured = docs.select("doc_id", source_host(F.col("source")).alias("host"), text_measures(F.col("text")).alias("m"))
    return measured.select("doc_id", "host", "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.lines.n").alias("n_lines"), (F.col("m.lines.n") - F.col("m.lines.own")).alias("n_dup_lines"), "m.n_repeat_words")


def host_rates(measures: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """host, rule, docs, failed, rate: the shrunk rate of each rule for each host.

    With n documents and f failures of a host, N, Q and F the sums of n, n squared and f, k hosts and m = F / N, the variance between hosts is
    (sum(f * f / n) - N m m - (k - 1) m (1 - m)) / (N - Q / N), and the prior is worth m (1 - m) / variance - 1 documents.
    """
    counted = measures.where("host is not null").groupBy("host").agg(F.count("*").alias("docs"), *[F.count_if(F.expr(c)).alias(r) for r, c in rules])
    counted = settle(counted, "host-failures")
    each = counted.select("host", "docs", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r, _ in rules])).alias("x")).select("host", "docs", "x.*")
    moments = each.groupBy("rule").agg(
        F.sum("docs").cast("double").alias("n"), F.sum("failed").cast("double").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("docs").cast("double") * F.col("docs")).alias("q"), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("docs")).alias("r"),
    ).withColumn("m", F.col("f") / F.col("n"))
    spread = (F.col("r") - F.col("f") * F.col("m") - (F.col("k") - 1) * F.col("m") * (1 - F.col("m"))) / F.nullif(F.col("n") - F.col("q") / F.col("n"), F.lit(0.0))
    prior = moments.withColumn("spread", spread).select("rule", "m", F.when(F.col("spread") > 0, F.greatest(F.lit(0.0), F.col("m") * (1 - F.col("m")) / F.col("spread") - 1)).alias("worth"))
    rate = F.when(F.col("worth").isNull(), F.col("m")).otherwise((F.col("failed") + F.col("worth") * F.col("m")) / (F.col("docs") + F.col("worth")))
    return each.join(F.broadcast(prior), "rule").select("host", "rule", "docs", "failed", rate.alias("rate"))


def judged_documents(docs: DataFrame, rules: Sequence[tuple[str, str]] = RULES, base: Sequence[str] = BASE_RULES, max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of each row, base_failed, host_refused and kept."""
    measures = settle(document_measures(docs), "rule-measures")
    total = measures.count()
    verdicts = host_rates(measures, rules).groupBy("host").agg(F.max("docs").alias("docs"), F.bool_or(F.col("rate") > max_rate).alias("refused"))
    verdicts = settle(verdicts, "host-verdicts")
    hot = F.broadcast(verdicts.where(F.col("docs") > total // HOT_SHARE).select("host", F.col("refused").alias("hot")))
    known = measures.join(hot, "host", "left")
    settled = known.where("hot is not null or host is null").withColumn("refused", F.coalesce("hot", F.lit(False)))
    rest = known.where("hot is null and host is not null").join(verdicts.select("host", "refused"), "host")
    out = settled.unionByName(rest.select(*settled.columns))
    failed = F.lit(False)
    for rule, condition in rules:
        failed = failed | F.expr(condition) if rule in base else failed
    return out.select("doc_id", "host", *measures.columns[2:], failed.alias("base_failed"), F.col("refused").alias("host_refused"), (~failed & ~F.col("refused")).alias("kept"))
