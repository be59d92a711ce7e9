"""Queries of the operators on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_is, table
from .decontaminate import contaminated_pairs
from .langid import fit_language_model, label_documents
from .near_dedup import near_duplicates
from .periodic import periodic_runs, rewritten
from .pii import BASE, personal_spans
from .quality import fit_ranker, measured_documents, score_measured


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_is("doc_id", 3, 1)
    measured = measured_documents(docs, "doc_id")
    scored = score_measured(measured, fit_ranker(measured, table(spark, sf_dir, "labels").where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "item_shingles", "question_found", "answer_found")


OP7_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', ' ', 'g')), ' ') AS w FROM documents),
iw AS (
  SELECT row_number() OVER () AS k, item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', ' ', 'g')), ' ') AS w,
    greatest(8, CAST(pow(2, ceil(log2(len(w)))) AS BIGINT)) AS top FROM benchmark),
ish AS (
  SELECT k, item_id, p AS i, greatest(1, len(w) - 4) AS n, least(5, len(w)) AS width, CASE WHEN top > 8 AND len(w) <= top // 4 * 3 THEN top // 4 * 3 ELSE top END AS size,
    array_to_string(w[p:p + least(5, len(w)) - 1], ' ') AS s
  FROM iw, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(p) WHERE w[1] <> ''),
dsh AS (
  SELECT r, doc_id, p - 1 AS pos, array_to_string(w[p:p + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) t(p)
  UNION ALL SELECT r, doc_id, p - 1, array_to_string(w[p:p + width - 1], ' ') FROM dw, (SELECT DISTINCT width FROM ish WHERE width < 5), unnest(range(1, len(w) - width + 2)) t(p)),
m AS (
  SELECT r, doc_id, k, item_id, n, i, width, size, pos, unnest([pos // size - 1, pos // size]) AS passage
  FROM ish JOIN dsh USING (s)),
f AS (
  SELECT r, doc_id, k, item_id, n, passage, count(DISTINCT i) FILTER (i <= (n + 1) // 2) AS q, count(DISTINCT i) FILTER (i > (n + 1) // 2) AS a
  FROM m WHERE passage >= 0 AND pos + width <= (passage + 2) * size GROUP BY ALL),
best AS (
  SELECT doc_id, item_id, n, max({'both': q + a, 'q': q}) AS x FROM f
  WHERE 100 * (q + a) >= 75 * n AND 100 * q >= 50 * ((n + 1) // 2) AND 100 * a >= 50 * (n - (n + 1) // 2)
  GROUP BY r, doc_id, k, item_id, n)
SELECT doc_id, item_id, n AS item_shingles, x.q AS question_found, x.both - x.q AS answer_found FROM best
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_is("doc_id", 4, 2)
    model = fit_language_model(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return label_documents(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_other")


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=rewritten, keep_text=False)
    digest = F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256")
    return found.select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", digest, "collapsed_sha256")


OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
crc AS (
  SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM raw),
a AS (SELECT *, h // 10 AS g, (h // 10) % n AS a FROM crc),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
t AS (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT x.r, x.i AS i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i),
isle AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k, i FROM e),
m AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM isle GROUP BY r, q, k HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT r, start, length, min(q) AS period FROM m GROUP BY r, start, length),
summed AS (
  SELECT r, count(*) AS n_runs, min({'l': -length, 's': start, 'p': period}) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, (1000 * -best.l) // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)
"""


QUERIES = {"op2_language_id": op2_language_id, "op3_personal_data": op3_personal_data, "op6_quality": op6_quality, "op7_decontaminate": op7_decontaminate, "op1_near_dedup": op1_near_dedup, "op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {"op7_decontaminate": OP7_SQL, "op11_periodic_runs": OP11_SQL}
