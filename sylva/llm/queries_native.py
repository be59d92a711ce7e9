"""Queries of operators 4, 9, 10 and 13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, masked_text, parse_formatted
from .common import table
from .host_rules import judged_documents
from .mixing import taken_words
from .urls import judge_urls

#: (verdict, host, path)
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trial).alias("text"))
    out = format_conversations(rows.unionByName(planted)).withColumn("back", parse_formatted(F.col("formatted"))).withColumn("masked", masked_text(F.col("segments")))
    turns = F.array_join(F.transform("back", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP4_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, turn, role, text,
    length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'))
    + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'tool' THEN 4
      ELSE 1 + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c')) END
    + 4 + 2 + 8 AS n,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END AS letter
  FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text), 's?u(a(t+a)*u)*(a(t+a)*)?') AS valid
FROM c GROUP BY conv_id
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    row_number() OVER () AS n FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[CAST((k - 1) % 3 + 1 AS INT)] AS w FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2 * CAST(coalesce(sum(source_size) OVER before, 0) AS BIGINT))
    / (CAST(sum(w) OVER () AS BIGINT) - CAST(coalesce(sum(w) OVER before, 0) AS BIGINT)) AS level
  FROM w WINDOW before AS (ORDER BY source_size / w::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size,
    (SELECT level FROM l WHERE level * w <= 2.0::DOUBLE * source_size ORDER BY source_size / w::DOUBLE, k LIMIT 1) * w) AS target FROM l),
q AS (
  SELECT n, doc_id, d.source, size, t.source_size, t.target, coalesce(md5(CAST(doc_id AS VARCHAR)), md5('size ' || size)) AS key,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), md5('size ' || size)), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN target > 0 THEN (pass * source_size + upto) / target END AS finish,
    greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - (pass * source_size + upto - size))) AS due
  FROM q, unnest([0, 1]) p(pass)),
g AS (
  SELECT *, CAST(coalesce(sum(due) OVER (ORDER BY finish NULLS FIRST, source NULLS LAST, pass, key, doc_id, size, upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS given FROM c)
SELECT doc_id, size, source_size, target,
  CAST(sum(greatest(0, least(due, (SELECT CAST(ceil(1.5::DOUBLE * sum(size)) AS BIGINT) FROM d) - given))) AS BIGINT) AS taken
FROM g GROUP BY n, doc_id, size, source_size, target
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS n, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT n, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(v, rh, rp)),
f AS (
  SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h JOIN r
  ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp) GROUP BY n),
u AS (SELECT n, host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS href FROM h),
a AS (
  SELECT n, src, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(href, '(?i)&(?:#0*47|#x0*2f|sol);', '/', 'g'), '(?i)&(?:#0*58|#x0*3a|colon);', ':', 'g'),
    '(?i)&(?:#0*46|#x0*2e|period);', '.', 'g'), '(?i)&(?:#0*45|#x0*2d);', '-', 'g'), '(?i)&(?:#0*38|#x0*26|amp);', '&', 'g') AS href FROM u),
l AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (
    SELECT DISTINCT n, src, translate(regexp_extract(href, '^(?i:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM a WHERE regexp_matches(href, '^(?i:[a-z][a-z0-9+.-]*:)?//'))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
e AS (
  SELECT 'trust' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM l
  UNION ALL SELECT 'distrust', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM l),
s AS (
  SELECT 'trust' AS kind, host, count(*) FILTER (v = 'allow') AS seed FROM h JOIN f USING (n) WHERE host <> '' GROUP BY host
  UNION ALL SELECT 'distrust', host, count(*) FILTER (v = 'block') FROM h JOIN f USING (n) WHERE host <> '' GROUP BY host),
walk AS (
  SELECT 0 AS k, kind, host, seed / CAST(sum(seed) OVER (PARTITION BY kind) AS DOUBLE) AS x FROM s WHERE seed > 0
  UNION ALL SELECT k + 1, walk.kind, dst, sum(share * x) FROM walk JOIN e ON e.kind = walk.kind AND src = host WHERE k < 12 GROUP BY k, walk.kind, dst),
g AS (
  SELECT host, coalesce(sum(y) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(y) FILTER (kind = 'distrust'), 0) AS d
  FROM (SELECT kind, host, x * power(0.85, k) * CASE WHEN k < 12 THEN 0.15 ELSE 1 END AS y FROM walk) GROUP BY host)
SELECT page_id, coalesce(h.host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(v, CASE WHEN d * (SELECT sum(seed) FROM s WHERE kind = 'distrust') > 1e-6 AND d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f USING (n) LEFT JOIN g ON g.host = h.host
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CASE WHEN contains(source, '://') THEN translate(regexp_extract(substr(source, instr(source, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE source END AS host
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM d)),
twice AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, s HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(5)) t(k) GROUP BY r),
l AS (SELECT r, count(*) AS n, count(DISTINCT line) AS own FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.r, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.own, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
f AS (
  SELECT host, rule, count(*) AS docs, CAST(count_if(failed) AS DOUBLE) AS failed FROM (
    SELECT host, unnest([
      {'rule': 1, 'failed': n_words < 10}, {'rule': 2, 'failed': 100 * n_repeat_words > 20 * n_words}, {'rule': 3, 'failed': 10 * n_symbols > n_words},
      {'rule': 4, 'failed': n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)}, {'rule': 5, 'failed': 100 * n_dup_lines > 30 * n_lines}], recursive := true)
    FROM m WHERE host IS NOT NULL) GROUP BY host, rule),
p AS (
  SELECT rule, sum(failed) / sum(docs) AS m, count(*) AS k, sum(docs) AS n, sum(docs::DOUBLE * docs) AS q, sum(failed * failed / docs) AS s FROM f GROUP BY rule),
v AS (SELECT rule, m, (s - n * m * m - (k - 1) * m * (1 - m)) / nullif(n - q / n, 0) AS spread FROM p),
b AS (SELECT rule, m, CASE WHEN spread > 0 THEN greatest(0, m * (1 - m) / spread - 1) END AS worth FROM v),
h AS (
  SELECT host, bool_or(CASE WHEN worth IS NULL THEN m ELSE (failed + worth * m) / (docs + worth) END > 0.5) AS refused FROM f JOIN b USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(refused, false) AS kept
FROM m LEFT JOIN h USING (host)
"""

QUERIES = {"op4_chat_format": op4_chat_format, "op9_mix_sources": op9_mix_sources, "op10_url_filter": op10_url_filter, "op13_quality_rules": op13_quality_rules}
ORACLES = {"op4_chat_format": OP4_SQL, "op9_mix_sources": OP9_SQL, "op10_url_filter": OP10_SQL, "op13_quality_rules": OP13_SQL}
