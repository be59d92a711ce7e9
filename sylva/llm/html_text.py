"""HTML extraction (operator 8): a host suffix index decides what repeats, structure where the text is.

A page becomes blocks of text in page order. Blocks inside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments - by element, role, class or id - are
dropped. A class or id that names such a thing among other words (social-impact) only makes a block doubtful. Inside an article or
main a name drops only a container that is plainly named as an advert, notice, menu, sidebar or comments; any other name there (widget, related), and every name
of a heading, paragraph or other element of TEXTUAL, only makes it doubtful: the index decides.

The token streams of the other blocks of all of a host's pages are put side by side and suffixes that begin
with the same RUN tokens meet. The tokens that lie in a run of RUN or more which PAGES pages of different
content share are covered, which is what a suffix array of the host gives whose neighbours have RUN tokens
in common. Not every suffix needs to be sent for that: of WINDOW suffixes in a row the one with the smallest
hash, and those that begin a block, stand for the others. So a shared run of RUN + WINDOW - 1 tokens, or one of RUN
at the begin of a block, always has one of them; blocks that hold a repeated one then send all
their suffixes, and those are counted.

The text lies in the articles if they hold SHARE of the tokens that are not covered, else in main if
that does, else anywhere. Anywhere, blocks of which COVERED is covered go, and so do doubtful ones. Inside an article or main
only runs that HOST_SHARE of the host's pages have are covered: what some articles share is text, what
most pages of a host share is not. An article or main of which COPIED is covered is itself a copy and
loses nothing. The unique blocks stay whole.

Suffixes are counted in two steps, so a host with a third of all pages is no single task's work. Up to KEYS
repeated suffixes are looked up in a broadcast (18 MB), more in a join; both give the same.

Defined results: null and empty html give empty text; text outside any element is a block; a page that lies wholly inside a form is
empty; an unclosed comment, script or tag runs to the end; repeated rows are each returned; pages of equal
content (dropped blocks aside) count once in what repeats; a null url has the empty host; a run that as many pages hold as
are asked is covered; a very long page is one page in one task, about 30 bytes a token; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import received, send, settle
from .urls import host_of

#: Tokens of a suffix that must be equal, suffixes of which one is sent, pages of different content that must share it, share of a block that must be covered.
RUN, WINDOW, PAGES, COVERED = 8, 8, 3, 0.8
#: Share of a host's pages that must share what goes from an article, of the tokens that an article or main must hold, and of it that must be covered in a copy.
HOST_SHARE, SHARE, COPIED = 0.5, 1 / 3, 0.5
#: Repeated suffixes that are broadcast at most, and the parts that a host's suffixes are divided into where its pages are counted in: so many, and one more for each PART_PAGES pages of the table.
KEYS, PARTS, PART_PAGES = 2_000_000, 16, 50_000
DROP, OPEN, MAIN, ARTICLE, INNER = range(5)
#: Added to the zone of a doubtful block.
DOUBT = 8
#: Base of the sums that tokens are hashed by.
ODD = 0x9E3779B97F4A7C15

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript".split())
DROPPED = frozenset("nav header footer aside form script style noscript template svg canvas iframe object video audio head menu dialog button select textarea title noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu navbar nav navigation breadcrumb breadcrumbs footer "
    "masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup share sharing social related recommended comment comments respond disqus "
    "pagination pager widget widgets toolbar skip".split()
)
#: Marks that drop inside an article or main too, and elements that no name drops there.
PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sidebar menu navbar nav breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe signup "
    "share sharing comment comments respond disqus pagination pager".split()
)
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th tr table tbody caption figure figcaption a b i em strong span code q cite time sup sub small mark abbr".split())
#: Names that say an element holds content in spite of such marks, and words that say another element is there.
CONTENT, BESIDE = frozenset("content article post entry story".split()), frozenset("has with no without".split())
#: Words that say nothing of what an element holds.
STRUCTURE = frozenset(
    "area bar block bottom box btn button buttons col column container css fixed footer form global group header icon icons id info inner item items js left line link links list "
    "main message meta module outer page panel primary right row secondary section site slot sticky text title top unit view wrap wrapper".split()
)

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")


def _drops(tag: str, raw: str, within: bool = False) -> int:
    """2 if an element's name or attributes say it is not part of the text, 1 if they may say so, else 0; within an article or main names say less."""
    if tag in DROPPED:
        return 2
    if not raw or tag in ("html", "body"):
        return 0
    doubt = 0
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return 2
        if name == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if name in ("class", "id"):
            for part in value.split():
                words = set(_NAME.findall(part))
                if words & MARKS and not words & BESIDE:
                    if words <= MARKS | STRUCTURE and not (within and (tag in TEXTUAL or not words & PLAIN)):
                        return 2
                    doubt = max(doubt, int(not words & CONTENT))
    return doubt


def page_blocks(source: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block: article, main, open, or dropped; with a question mark if doubtful."""
    return [(("dropped", "open", "main", "article", "article")[z % DOUBT] + "?" * (z // DOUBT), t) for z, t in _blocks(source)]


def _blocks(source: str | None) -> list[tuple[int, str]]:
    """(DROP, or OPEN, MAIN, ARTICLE, INNER for an article in main, with DOUBT added if doubtful; text) of each block."""
    out: list[tuple[int, str]] = []
    if not source:
        return out
    stack: list[tuple[str, int]] = []  # element, whether it drops
    dropping = doubts = articles = mains = headings = headers = 0
    text: list[str] = []  # of the block at hand
    lost: list[str] = []  # what inline elements that drop hold of it

    def flush() -> None:
        own = (INNER if mains else ARTICLE) if articles else MAIN if mains else OPEN
        for pieces, zone in ((text, own + DOUBT * (doubts > 0)), (lost, DROP)):
            if pieces:
                if joined := " ".join("".join(pieces).split()):
                    out.append((zone, joined))
                pieces.clear()

    def put(piece: str) -> None:
        (text if not dropping or (headers == dropping and headings and articles) else lost).append(piece)

    def pop() -> None:
        nonlocal dropping, doubts, articles, mains, headings, headers
        tag, drops = stack.pop()
        dropping -= drops == 2
        doubts -= drops == 1
        headers -= drops == 2 and tag == "header"
        articles -= tag == "article"
        mains -= tag == "main"
        headings -= len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()

    def close(tag: str, *limits: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in limits:
                return

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            put(html.unescape(source[at:]))
            break
        m = _TOKEN.match(source, lt)
        if m is None:
            put(html.unescape(source[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            put(html.unescape(source[at:lt]))
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        end, tag, raw = m.group(1) if m.group(2) else m.group(4), tag.lower(), m.group(3) if m.group(2) else m.group(6)
        block = tag in BLOCKS
        if block:
            flush()
        if end:
            close(tag)
        elif tag in VOID or (raw and raw.endswith("/") and tag in RAW):
            if tag == "br":
                put(" ")
        elif tag in RAW:
            # everything up to its end tag is its own
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = over.end() if over else n
        else:
            if block:
                close("p", "table", "td", "button", "article", "section", "div")
            if tag == "li":
                close("li", "ul", "ol", "menu", "dir")
            elif tag in ("dd", "dt"):
                close("dd", "dl")
                close("dt", "dl")
            elif tag in ("tr", "td", "th"):
                close("td", "tr", "table")
                close("th", "tr", "table")
            drops = _drops(tag, raw, articles > 0 or mains > 0)
            stack.append((tag, drops))
            dropping += drops == 2
            doubts += drops == 1
            headers += drops == 2 and tag == "header"
            articles += tag == "article"
            mains += tag == "main"
            headings += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    flush()
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("zone", pa.int8()), ("text", pa.string())]))
    for batch in batches:
        blocks = [_blocks(source.as_py()) for source in batch.column("html")]
        contents = [_signed(xxhash.xxh64_intdigest("\n".join(t for z, t in own if z != DROP))) for own in blocks]
        rest = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in rest), pa.array([[{"zone": z, "text": t} for z, t in own] for own in blocks], kind), pa.array(contents, pa.int64())], [*rest, "blocks", "content"]
        )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Host, zones and texts of the blocks of each page."""
    column = batch.column("blocks")
    ends, held = column.offsets.to_numpy(), column.values
    zones, texts = held.field("zone").to_numpy(zero_copy_only=False), held.field("text").to_pylist()
    for k, host in enumerate(batch.column("host").to_pylist()):
        yield host, zones[ends[k] : ends[k + 1]], texts[ends[k] : ends[k + 1]]


class TokenHashes:
    """Hashes of the tokens of a text that single spaces part: sums of bytes times powers of an odd number, all tokens at once."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8)
        if len(b) > len(self.powers):
            n = max(1 << 16, 2 * len(b))
            self.powers, self.inverses = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (ODD, pow(ODD, -1, 1 << 64)))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * self.powers[: len(b)], out=sums[1:])
        breaks = np.flatnonzero(b == 32)
        start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(b)]])
        h = (sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _suffixes(host: str, zones: np.ndarray, texts: list[str], hashes: TokenHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of host and first RUN tokens of each suffix of a page that has so many, the whole of a shorter page; and where blocks begin and the last ends.

    Dropped blocks have no tokens here. Texts hold no white space but single spaces.
    """
    kept = (zones != DROP).tolist()
    ends = np.cumsum([0, *(t.count(" ") + 1 if k else 0 for k, t in zip(kept, texts, strict=True))])
    if not ends[-1]:
        return np.zeros(0, np.int64), ends
    n = hashes(" ".join([t for k, t in zip(kept, texts, strict=True) if k]).encode("utf-8", "surrogatepass"))
    width = min(RUN, len(n))
    key = np.full(len(n) - width + 1, xxhash.xxh64_intdigest(f"{width} {host}"), np.uint64)
    for k in range(width):
        key = (key ^ n[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64), ends


def _anchors(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the suffixes that stand for the others."""
    width = min(WINDOW, len(keys))
    if not width:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(keys, width).argmin(axis=1) + np.arange(len(keys) - width + 1)
    return np.unique(np.concatenate([least, ends[:-1][ends[:-1] < len(keys)]]))


def _around(keys: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places of all suffixes that begin in a block that some of the suffixes at the places touch."""
    held = np.zeros(len(ends) + 1, np.int64)
    last = np.minimum(places + RUN, ends[-1]) - 1
    np.add.at(held, np.searchsorted(ends, places, "right") - 1, 1)
    np.add.at(held, np.searchsorted(ends, last, "right"), -1)
    return np.flatnonzero(np.repeat(np.cumsum(held)[: len(ends) - 1] > 0, np.diff(ends))[: len(keys)])


def _finder(known) -> object:
    """Places of a page's repeated suffixes and whether most of its host's pages have them: looked up in a broadcast, or of the column places."""

    def find(batch: pa.RecordBatch, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if known is None:
            own = np.array(batch.column("places")[k].as_py() or [], np.int64)
            return own // 2, own % 2 == 1
        repeated, most = received(known)
        at = np.minimum(np.searchsorted(repeated, keys), max(0, len(repeated) - 1))
        places = np.flatnonzero(repeated[at] == keys) if len(repeated) else np.zeros(0, np.int64)
        return places, most[at[places]] if len(repeated) else np.zeros(0, bool)

    return find


def _keys(pick) -> object:
    """Rows with the hashes of suffixes: those that pick names, each once, or all in their places if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            out = []
            for k, page in enumerate(_pages(batch)):
                keys, ends = _suffixes(*page, hashes)
                out.append(np.unique(keys[pick(batch, k, keys, ends)]) if pick else keys)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "host", "content")), pa.array(out, pa.list_(pa.int64()))], ["row", "host", "content", "keys"])

    return run


_KEYED = "row long, host string, content long, keys array<bigint>"


def _text(zones: np.ndarray, texts: list[str], ends: np.ndarray, places: np.ndarray, most: np.ndarray) -> str:
    """Text of a page whose suffixes at the places are repeated."""

    def covered(places: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.zeros(len(texts), np.int64)
        steps = np.zeros(ends[-1] + RUN + 1, np.int64)
        np.add.at(steps, places, 1)
        np.add.at(steps, places + RUN, -1)
        before = np.concatenate([[0], np.cumsum(np.cumsum(steps)[: ends[-1]] > 0)])
        return before[ends[1:]] - before[ends[:-1]]

    sizes, some, lasting = np.diff(ends), covered(places), covered(places[most])
    doubtful, zones = zones >= DOUBT, zones % DOUBT
    repeated = some >= COVERED * sizes
    stay = (zones != DROP) & ~repeated
    for zone in (zones >= ARTICLE, (zones == MAIN) | (zones == INNER)):
        if zone.any():
            copy = lasting[zone].sum() >= COPIED * sizes[zone].sum()
            own = (sizes if copy else sizes - lasting)[zone].sum()
            if own >= SHARE * (own + (sizes - some)[~zone & (zones != DROP)].sum()):
                stay = zone & (copy | ((lasting < COVERED * sizes) & ~(doubtful & repeated)))
                break
    return "\n\n".join(t for t, s in zip(texts, stay.tolist(), strict=True) if s)


def _keep(find) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            out = []
            for k, (host, zones, texts) in enumerate(_pages(batch)):
                keys, ends = _suffixes(host, zones, texts, hashes)
                out.append(_text(zones, texts, ends, *find(batch, k, keys)) if texts else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def _with_places(read: DataFrame, repeated: DataFrame) -> tuple[DataFrame, object]:
    """Rows and a finder of their suffixes in repeated (key, most)."""
    if repeated.count() <= KEYS:
        held = repeated.toPandas().sort_values("key")
        return read, _finder(send(read.sparkSession, (held["key"].to_numpy(np.int64), held["most"].to_numpy(bool))))
    places = read.mapInArrow(_keys(None), _KEYED).select("row", F.posexplode("keys").alias("place", "key")).join(repeated, "key")
    places = places.groupBy("row").agg(F.collect_list(2 * F.col("place") + F.col("most").cast("int")).alias("places"))
    return read.join(places, "row", "left"), _finder(None)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.monotonically_increasing_id().alias("row"), "html")
    read = settle(pages.mapInArrow(_read, "page_id long, url string, host string, row long, blocks array<struct<zone:tinyint,text:string>>, content long"), "html-read", codec="zstd")
    contents = read.groupBy("host", "content").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    copies = settle(contents.where("n > 1").select("host", "content", "first"), "html-copies")
    parts = PARTS + read.count() // PART_PAGES
    sizes = contents.groupBy("host").agg(F.count("*").alias("pages")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def counted(rows: DataFrame, pick) -> DataFrame:
        """host, key, n: in how many pages of different content each picked suffix is."""
        keyed = rows.mapInArrow(_keys(pick), _KEYED).where(F.size("keys") > 0).join(copies, ["host", "content"], "left")
        return keyed.where("first is null or row = first").select("host", F.explode("keys").alias("key")).groupBy("key").agg(F.min("host").alias("host"), F.count("*").alias("n")).where(F.col("n") >= PAGES)

    anchors = settle(counted(read, lambda batch, k, keys, ends: _anchors(keys, ends)).select("key", F.lit(False).alias("most")), "html-anchors")
    rows, find = _with_places(read, anchors)
    runs = counted(rows, lambda batch, k, keys, ends: _around(keys, ends, find(batch, k, keys)[0])).withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    runs = runs.join(sizes, ["host", "part"]).select("key", (F.col("n") >= F.lit(HOST_SHARE) * F.col("pages")).alias("most"))
    rows, find = _with_places(read, settle(runs, "html-repeated"))
    out = rows.mapInArrow(_keep(find), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
