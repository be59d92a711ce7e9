import random
import re

import pytest

from sylva.llm.html_text import COVERED, PAGES, RUN, main_texts, page_blocks
from sylva.llm.queries_pages import op8_html_text


def kept(html):
    return [t for z, t in page_blocks(html) if z != "dropped"]


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("<p>a &amp; b&nbsp;c&#233;</p>", ["a & b cé"]), ("<p>a<p>b<br>c", ["a", "b c"]), ("<b>x</b>y <i>z</i>", ["xy z"]), ("a < b", ["a < b"]), ("<p title='a>b'>t", ["t"]), ("<p>x<!-- <p>no --> y", ["x y"]),
        ("<script>if(a<b)'</p>'</script><p>t", ["t"]), ("<style>p{}</style>t", ["t"]), ("<p>x<script>open", ["x"]), ("<p>x<!-- open", ["x"]), ("<P CLASS='AD'>no</P>t", ["t"]), ("<div hidden>no</div>t", ["t"]),
        ("<div style='display: none'>no</div>t", ["t"]), ("<nav>m</nav><div role=banner>h</div><form><input>f</form>t", ["t"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<table><tr><td>a<td>b</table>", ["a", "b"]), ("", []), (None, []),
        ("<p class='social-impact'>t</p><div id='related-work'>u</div>", ["t", "u"]), ("<div class='ad-box'>no</div><div id=share-buttons>no</div>t", ["t"]),
        ("<body class='has-sidebar'>t<aside>no</aside>", ["t"]), ("<div class='post-content'>t</div><section id='comments'>no</section>", ["t"]), ("<div class='cookie-notice'>no<div>no</div></div>t", ["t"]), ("x</p></div>y", ["x", "y"]),
        ("<article><header><h1>H</h1><p>by</p></header><p>t</p><footer>f</footer></article>", ["H", "t"]), ("<textarea>no</textarea><select><option>no</select>t", ["t"]), ("<p>a\n \t b</p>", ["a b"]), ("<p>a <span class='ad'>no</span>b</p>", ["a b"]), ("<p>a<span hidden>no</span><b>c</b></p>", ["ac"]), ("<div class='ad'>no<p>no</div>t", ["t"]),
    ],
)
def test_blocks(html, blocks):
    assert kept(html) == blocks


def run(spark, rows):
    return {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_an_article_is_the_text(spark):
    html = "<div>Intro</div><article><h1>T</h1><p>one</p><p>two</p></article><div>Outro</div>"
    assert run(spark, [(1, "http://a.b/", html), (2, "http://a.b/", html.replace("article", "main"))]) == {1: "T\n\none\n\ntwo", 2: "T\n\none\n\ntwo"}


def brute(rows):
    """Open pages by a suffix array of each host: all runs of RUN tokens and more that PAGES pages share."""
    hosts = {}
    for page, url, html in rows:
        own = [t for z, t in page_blocks(html) if z == "open"]
        hosts.setdefault((url or "").partition("://")[2].split("/")[0].lower(), []).append((page, own))
    out = {}
    for pages in hosts.values():
        streams = [" ".join(own).split() for _, own in pages]
        content = {tuple(own): k for k, (_, own) in enumerate(pages)}
        array = sorted((s[i:], content[tuple(pages[k][1])], k, i) for k, s in enumerate(streams) for i in range(len(s)))
        covered = [[False] * len(s) for s in streams]
        begin = 0
        for end in range(1, len(array) + 1):
            if end == len(array) or array[end][0][:RUN] != array[begin][0][:RUN]:
                if len(array[begin][0]) >= RUN and len({c for _, c, _, _ in array[begin:end]}) >= PAGES:
                    for _, _, k, i in array[begin:end]:
                        covered[k][i : i + RUN] = [True] * RUN
                begin = end
        for k, (page, own) in enumerate(pages):
            at, kept_ = 0, []
            for t in own:
                n = len(t.split())
                if sum(covered[k][at : at + n]) < COVERED * n:
                    kept_.append(t)
                at += n
            out[page] = "\n\n".join(kept_)
    return out


def test_repeated_runs_of_open_pages(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(12), text(9), text(30), text(5)]
    rows = []
    for k in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.choice([4, 15, 40])) for _ in range(6)]
        rows.append((k, f"http://host{k % 3}.org/{k}", "<nav>home about</nav>" + "".join(f"<div>{p}</div>" for p in parts)))
    rows += [(100, "http://host0.org/copy", rows[0][2]), (101, "http://host0.org/copy2", rows[0][2])]
    assert run(spark, rows) == brute(rows)


def test_cases(spark, clash, same):
    rows = [(1, None, None), (2, "http://a/", ""), (2, "http://a/", "<p>x"), (None, "no scheme", "<p>y"), (3, "http://a/", "<p>" + "long " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["text"][:9], r["n_chars"]) for r in main_texts(df).collect()), key=repr)
    assert got == sorted([(1, "", 0), (2, "", 0), (2, "x", 1), (None, "y", 1), (3, "long long", 149_999)], key=repr)
    assert main_texts(df.limit(0)).count() == 0
    same(main_texts(clash(df)), main_texts(df))


def test_query_on_the_pages(spark, tiny):
    import html as entities
    import re

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in op8_html_text(spark, tiny).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r["page_id"]], re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*(>|\Z)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_repeated_runs_of_marked_pages(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    notice, story, rows, want = text(12), text(60), [], {}
    for k in range(8):  # a notice without a telling class inside each article
        own = text(40)
        rows.append((k, "http://a.org/x", f"<nav>{text(9)}</nav><article><p>{own}</p><p>{notice}</p></article>"))
        want[k] = own
    for k in range(10, 14):  # copies under other menus and with one other line
        line = text(9)
        rows.append((k, "http://a.org/y", f"<nav>{text(9)}</nav><article><p>{story}</p><p>{line}</p></article>"))
        want[k] = f"{story}\n\n{line}"
    body, teaser = text(80), text(6)
    rows.append((20, "http://a.org/z", f"<article>{teaser}</article><main><p>{body}</p></main>"))
    rows.append((21, "http://a.org/z", f"<article>{teaser}</article><div>{body}</div>"))
    rows.append((22, "http://b.org/z", f"<main><p>{body}</p><article>{teaser}</article></main>"))
    rows.append((23, "http://b.org/z", f"<article><p>{notice}</p><p>{body}</p></article>"))
    want |= {20: body, 21: f"{teaser}\n\n{body}", 22: f"{body}\n\n{teaser}", 23: f"{notice}\n\n{body}"}
    share, lede = "tell all of your many friends about this page", text(30)
    for k in range(30, 33):  # a line that three articles of many share, one in a doubtful element, one of a template
        rows.append((k, "http://c.org/z", f"<article><p>{lede}</p><p>{text(30)}</p><p class='share-among-friends'>{share}</p><p class='social-impact'>{k}</p></article>"))
        want[k] = rows[-1][2].split("<p>")[1].split("<")[0] + "\n\n" + rows[-1][2].split("<p>")[2].split("<")[0] + f"\n\n{k}"
    for k in range(33, 40):
        rows.append((k, "http://c.org/z", f"<article><p>{text(30)}</p></article>"))
        want[k] = rows[-1][2].split("<p>")[1].split("<")[0]
    assert run(spark, rows) == want
    monkeypatch.setattr("sylva.llm.html_text.KEYS", 0)
    assert run(spark, rows) == want


@pytest.mark.parametrize(
    "inner,kept",
    [
        ('<h2 id="navigation">Navigation</h2>', True), ('<h2 id="related">Related work</h2>', True), ('<p class="comment">A comment on the law</p>', True), ('<div class="widget">How a widget is made</div>', True), ('<section id="social">Of social life</section>', True),
        ('<blockquote class="share">A share of the land</blockquote>', True), ('<div class="ad">Buy now</div>', False), ('<div id="comments">First!</div>', False), ('<ul class="menu"><li>Home</li></ul>', False), ('<div class="cookie-notice">We use cookies</div>', False), ('<p hidden>Not shown</p>', False),
    ],
)
@pytest.mark.parametrize("around", ["article", "main"])
def test_names_inside_articles(spark, inner, kept, around):
    page = f"<{around}><p>One two three.</p>{inner}<p>Four five six.</p></{around}>"
    text = main_texts(spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")).first()["text"]
    own = re.sub("<[^>]*>", "", inner)
    assert text == "\n\n".join(["One two three.", *[own] * kept, "Four five six."])
