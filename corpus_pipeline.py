"""From documents to a training mix: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. run() writes what a stage returns to the shared folder and reads it for the next one.

Defined results: language, contamination and personal data are judged by a row's own text, whatever its id; rows that repeat a doc_id
leave near-dedup once for each group of copies their texts are in; a row with a null doc_id goes there if a row with an id is its
copy, and equal texts without an id leave once; null and empty texts have no language and go in the first stage; very long texts are
whole in every stage; rows that tie in id, source and size share the words taken of them, one more word at most for some, and lose none;
columns beside those of documents, whatever their names, are carried to the last stage and end there; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import discard, n_words, settle, table
from sylva.llm.decontaminate import clean_documents
from sylva.llm.graph import divided_join
from sylva.llm.langid import UNKNOWN, fit_language_model, label_documents
from sylva.llm.mixing import taken_words
from sylva.llm.near_dedup import near_groups
from sylva.llm.pii import redact_documents

#: A text of at least SURE_WORDS words whose best language has a smaller mean than this is in none of them.
MIN_SCORE, SURE_WORDS = 0.5, 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of lang; the model learns from the labelled rows of docs."""
    model = fit_language_model(docs)
    labelled = label_documents(docs.select(F.struct("*").alias("row"), "text"), model, "row")
    rejected = (F.col("lang_pred") == UNKNOWN) | ((F.col("score") < MIN_SCORE) & (F.col("n_words") >= SURE_WORDS))
    return labelled.where(~rejected).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest id, of its texts that with the smallest hash."""
    every = near_groups(docs).where("kept")
    groups = every.where("doc_id is not null")
    kept = groups.groupBy("doc_id", "comp", F.when(F.col("comp").isNull(), F.col("text_hash")).alias("own")).agg(F.min("text_hash").alias("hash")).select("doc_id", "hash").distinct()
    named = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))
    named = named.join(kept, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")
    alone = every.where("doc_id is null").select(F.col("text_hash").alias("hash")).distinct()
    unnamed = docs.where("doc_id is null").select(F.struct("*").alias("row"), F.xxhash64("text").alias("hash"))
    unnamed = unnamed.join(alone, "hash", "left_semi").dropDuplicates(["hash"]).select("row.*")
    return named.unionByName(unnamed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of: their columns, size in words, and the words taken."""
    key = F.to_json(F.struct("doc_id", "source", "size")).alias("key")  # null ids and sources are told from all others
    sums = taken_words(docs).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("words"), F.count("*").alias("rows"))
    sums = settle(sums.where("words > 0").select(key, "words", "rows", F.col("rows").alias("held")), "mix-words")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").withColumn("size", n_words(F.col("text"))).withColumn("key", key)
    known = settle(divided_join(own, sums, "key", "held", total=docs.count()).drop("key").withColumn("part", F.spark_partition_id()), "mix-rows", codec="zstd")
    one = known.where("rows = 1").withColumn("taken", F.col("words")).drop("words", "rows", "part")
    return one.unionByName(_shared(known.where("rows > 1"))).where("taken > 0")


def _shared(alike: DataFrame) -> DataFrame:
    """Rows of equal id, source and size with their shares of the words taken of all of them, to the word: the k-th gets floor(words (k + 1) / rows) - floor(words k / rows).

    Rows are numbered inside the part that holds them; a part's first number is the sum of the parts before.
    """
    key = ["doc_id", "source", "size"]
    parts = alike.groupBy(*key, "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.expr("a.doc_id <=> p.doc_id and a.source <=> p.source and a.size = p.size and a.part = p.part")
    k = F.row_number().over(Window.partitionBy(*key, "part").orderBy("text", "lang", "n_chars")) - 1
    numbered = alike.withColumn("k", k).alias("a").join(parts.withColumn("before", before).alias("p"), same).select("a.*", "p.before").withColumn("k", F.col("before") + F.col("k"))
    words, rows = F.col("words").cast("decimal(38,0)"), F.col("rows")
    upto = lambda n: F.floor(words * n / rows)
    return numbered.withColumn("taken", (upto(F.col("k") + 1) - upto(F.col("k"))).cast("long")).drop("words", "rows", "part", "k", "before")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix", mix),
]

#: SQL can express neither the learned models nor MinHash groups; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        earlier, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(earlier)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
