"""Character references in HTML: decoded in the tree, as written in raw mode, and in the queries as their SQL has them."""

import pytest
from oracle import assert_same

from sylva import queries
from sylva.sources.parsers import parse

TITLES = ["a &amp; b", "a&&amp", "x = &quot;1&quot;", "&amp;lt; &#38;", "plain", "&copy &eacute;"]


def test_raw_html():
    text = "<title>a &quot;b&quot;</title><a href='?x=1&amp;y'>c &lt; d</a>"
    values = lambda doc: [n.text for n in doc.descendants() if n.kind == "text"] + [n.attrs["href"] for n in doc.descendants() if n.name == "a"]
    assert values(parse(text, "html")) == ['a "b"', "c < d", "?x=1&y"]
    assert values(parse(text, "html", "raw")) == ["a &quot;b&quot;", "c &lt; d", "?x=1&amp;y"]


@pytest.mark.parametrize("name", ["html_text_test", "html_title_value"])
def test_titles_equal_their_sql(spark, tmp_path, name):
    pages = [(k, f"https://example.com/{k}.html", f"<html><head><title>{t}</title></head><body><p>a &lt; b</p></body></html>") for k, t in enumerate(TITLES)]
    spark.createDataFrame(pages, "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert_same(spark, str(tmp_path), queries.QUERIES[name], queries.ORACLES[name])
