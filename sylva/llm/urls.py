"""URL filters (operator 10): rules by host suffix and path prefix, and trust flow over the host link graph.

Where no rule fits, a host's verdict comes from two personalised PageRank walks over the links
between hosts: trust flows along links from hosts whose pages rules allow, distrust flows against
the links from hosts whose pages rules block (who links to a blocked host shares its distrust). Both
run as one, told apart by a column. A host is blocked if its distrust is above ratio times its trust and worth more than
min_distrust blocked pages, which no size of the table changes.

Rules beyond MAX_RULES would make too large an expression and are joined by the suffixes of hosts
instead; both ways give the same. The rank of a host with very many pages is broadcast to them (divided_join), and the links of a host
with more than PART_LINKS are walked in parts, to each of which its rank goes.

Defined results: a null url or one without :// has an empty host and path, no rule, and the verdict
of the empty host (which holds no links and no seeds: allow). Null html has no links; links to //host take part,
relative ones don't; character references of the marks of an address are read. Trust equal to distrust allows; of two rules of equal
length that fit, the first by code point wins. A page, however long, is searched by one regular expression.
Repeated rows and null ids are judged each on its own; links count once for each pair of hosts and page. An empty table gives
no rows; columns other than page_id, url and html, whatever their names, are not read. Everything is
DataFrame functions; host tables are shuffled, never collected.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, settle
from .graph import divided_join

#: Rules that become one expression at most.
MAX_RULES = 500
#: Links of a host that meet its rank in one task, about, and pages of a host that do.
PART_LINKS, HOST_PAGES = 50_000, 1_000
#: Marks of an address and their character references (fixed values).
REFERENCES = (("/", "#0*47|#x0*2f|sol"), (":", "#0*58|#x0*3a|colon"), (".", "#0*46|#x0*2e|period"), ("-", "#0*45|#x0*2d"), ("&", "#0*38|#x0*26|amp"))
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule (verdict, host, path) that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pages (page_id, host, path) with fit, the struct<rule, verdict> of the longest rule that fits."""
    if len(rules) <= MAX_RULES:
        return pages.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    given = F.from_json(F.lit(json.dumps([{"verdict": v, "h": h, "p": p} for v, h, p in rules])), "array<struct<verdict:string,h:string,p:string>>")
    table = pages.sparkSession.range(1).select(F.inline(given))
    numbered = settle(pages.withColumn("row", F.monotonically_increasing_id()), "urls-pages")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = F.concat("h", "p")
    # the rules come from the driver, so a task can hold them
    fits = numbered.select("row", "path", F.explode(F.array_distinct(suffixes)).alias("h")).join(F.broadcast(table), "h").where(F.col("path").startswith(F.col("p")))
    best = fits.groupBy("row").agg(F.min_by(F.struct(rule.alias("rule"), "verdict"), F.struct(-F.length(rule), rule)).alias("fit"))
    return numbered.join(best, "row", "left").drop("row")


def linked_host(href: Column) -> Column:
    """Host of an absolute or //host link, else empty."""
    for mark, names in REFERENCES:
        href = F.regexp_replace(href, f"(?i)&(?:{names});", mark)
    return F.when(href.rlike("(?i)^(?:[a-z][a-z0-9+.-]*:)?//"), host_of(F.concat(F.lit(":"), F.regexp_replace(href, "^[^/]*", "")))).otherwise("")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, weight: pages of host src with links to another host dst."""
    found = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), linked_host), lambda h: h != ""))).alias("dst"),
    )
    return found.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_ranks(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """kind, host, r: rank in each kind's walk over edges (kind, src, dst, weight), restarted at seeds (kind, host, restart).

    A host without outgoing links gives its rank back to nobody (the walk ends there), so no
    global sum is needed between rounds. Lineage is cut every four rounds.
    """
    key = F.concat(F.substring("kind", 1, 1), "src")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    known = divided_join(edges.withColumn("key", key), out.select(key.alias("key"), "out", F.ceil(F.col("n") / PART_LINKS).cast("int").alias("parts"), "n"), "key", "n", total=edges.count())
    share = (damping * F.col("weight") / F.col("out")).alias("share")
    steps = settle(known.select("kind", F.col("src").alias("host"), "dst", share, "parts", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part")), "urls-steps")
    hubs = settle(out.where(F.col("n") > PART_LINKS).select("kind", F.col("src").alias("host"), F.ceil(F.col("n") / PART_LINKS).cast("int").alias("parts")), "urls-hubs")
    many = hubs.count() > 0
    start = settle(seeds, "urls-seeds")
    rank, held = start.select("kind", "host", F.col("restart").alias("r")), None
    back = start.select("kind", "host", ((1 - damping) * F.col("restart")).alias("r"))
    for k in range(1, rounds + 1):
        if many:
            parted = rank.join(hubs, ["kind", "host"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        moved = (steps.join(parted, ["kind", "host", "part"]) if many else steps.join(rank, ["kind", "host"])).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("r")).alias("r"))
        rank = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if k % 4 == 0:
            rank = settle(rank, "urls-rank")
            if held is not None:
                discard(held)
            held = rank
    return rank


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    damping: float = 0.85,
    rounds: int = 12,
    min_distrust: float = 1e-6,
    ratio: float = 1.0,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages."""
    kinds = {"trust": "allow", "distrust": "block"}
    judged = with_rule(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    counted = [F.count(F.when(F.col("fit.verdict") == v, 1)).alias(kind) for kind, v in kinds.items()]
    hosts = settle(judged.where("host != '' and fit is not null").groupBy("host").agg(*counted), "urls-hosts")
    total = hosts.agg(*[F.sum(kind).alias(kind) for kind in kinds]).first()
    links = settle(host_links(pages), "urls-links")
    ways = (("trust", "src", "dst"), ("distrust", "dst", "src"))
    edges = reduce(DataFrame.unionByName, [links.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "weight") for kind, a, b in ways])
    seeds = reduce(DataFrame.unionByName, [hosts.where(F.col(kind) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(kind) / F.lit(float(total[kind] or 1))).alias("restart")) for kind in kinds])
    walked = personalised_ranks(edges, seeds, damping, rounds)
    ranks = walked.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0)).alias(kind) for kind in kinds])
    sizes = judged.where("host is not null").groupBy("host").agg(F.count("*").alias("n")).join(ranks, "host", "left")
    own = divided_join(judged.where("host is not null"), sizes, "host", "n", "left", pages.count(), least=HOST_PAGES)
    own = own.unionByName(judged.where("host is null"), allowMissingColumns=True)
    own = own.withColumns({kind: F.coalesce(kind, F.lit(0.0)) for kind in kinds})
    blocked = (F.col("distrust") * float(total["distrust"] or 0) > min_distrust) & (F.col("distrust") > ratio * F.col("trust"))
    return own.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
