"""Hand-made pages through the HTML reader."""

import pytest
from statuta.sources import html

N = '<span class="article-number">{}</span>'
BODY = '<div class="article-content">{}</div>'

#: (page, articles as (number, title, content)).
PAGES = [
    ("", []),
    ("no markup", []),
    ('<div class="article">' + N.format(" 제1조 ") + BODY.format(" text ") + "</div>", [("제1조", None, "text")]),
    ("<div class='article'>" + N.format("1") + "</div>", [("1", None, "")]),
    ('<div class="main article last">' + N.format("1") + "</div>", [("1", None, "")]),
    ('<div class="articles">' + N.format("1") + "</div>", []),
    ('<div class="article">' + BODY.format("no number") + "</div>", []),
    ('<div class="article">' + N.format("") + BODY.format("x") + "</div>", [("", None, "x")]),
    ('<DIV CLASS="article">' + N.format("1").upper().replace("CLASS=\"ARTICLE-NUMBER\"", 'CLASS="article-number"') + "</DIV>", [("1", None, "")]),
    ('<div class="article">' + N.format("1") + '<span class="article-title"><b>A &amp; B</b></span>' + BODY.format("x &lt; y") + "</div>", [("1", "A & B", "x < y")]),
    ('<div class="article">' + N.format("1") + BODY.format("x &lt; y<div>inner</div>tail") + "</div>", [("1", None, "x < yinnertail")]),
    ('<div class="article">' + N.format("1") + BODY.format("a<script>var d = '</p><div>';</script><!-- c --><style>p{}</style>b") + "</div>", [("1", None, "ab")]),
    ('<div class="article">' + N.format("1") + BODY.format("one") + BODY.format("two") + "</div>", [("1", None, "one")]),
    ('<div class="article">' + N.format("1") + BODY.format("one") + '</div><div class="article">' + N.format("2") + BODY.format("two") + "</div>", [("1", None, "one"), ("2", None, "two")]),
    ('<div class="article">' + N.format("1") + '<div class="article">' + N.format("2") + BODY.format("in") + "</div>" + BODY.format("out") + "</div>", [("1", None, "in"), ("2", None, "in")]),
    ('<div class="article"><p>' + N.format("1") + "<p>para" + BODY.format("x<br>y<br/>z<img src=a>") + "</div>", [("1", None, "xyz")]),
    ('<div class="article">' + N.format("1") + BODY.format("<ul><li>a<li>b</ul>c</i></td>d"), [("1", None, "abcd")]),
    ('<div class="article"/>' + N.format("1") + BODY.format("outside"), []),
    ('<div class=article data-x="a > b">' + N.format("&#51228;&#x31;조&nbsp;") + BODY.format("&copy; &unknown; 100% & more") + "</div>", [("제1조", None, "© &unknown; 100% & more")]),
    ('<div class="article">' + N.format("1") + '<div class="article-content">cut off in the mid', [("1", None, "cut off in the mid")]),
    ('<html><body><table><tr><td><div class="article">' + N.format("1") + BODY.format("in a cell<table><tr><td>x<td>y</table>z") + "</div><td>w</table>", [("1", None, "in a cellxyz")]),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_pages(page, want):
    parts = {k: html.STATUTE[k] for k in ("number", "title", "content")}
    got = [(one["number"], one.get("title"), one.get("content", "")) for _, one in html.read_page(page, html.STATUTE["block"], parts)]
    assert got == want


def test_paragraphs_of_a_content():
    assert html.paragraphs_of("lead\n① one\n  more \n\n②two\n⑯ no marker") == [("①", "one more"), ("②", "two ⑯ no marker")]
    assert html.paragraphs_of("") == []


def test_frame(spark):
    rows = [(i, p) for i, (p, _) in enumerate(PAGES)] + [(100, None), (None, PAGES[2][0]), (3, PAGES[3][0])]
    df = spark.createDataFrame(rows, "title long, html string").selectExpr("*", "1 AS number", "2 AS at")
    got = html.law_pages(df.withColumnRenamed("title", "page"), "page").collect()
    want = [(i, *a) for i, (_, own) in enumerate(PAGES) for a in own] + [(None, *PAGES[2][1][0]), (3, *PAGES[3][1][0])]
    assert sorted(map(str, ((r.page, r.number, r.title, r.content) for r in got))) == sorted(map(str, want))
    assert html.law_pages(df.limit(0).withColumnRenamed("title", "page"), "page").count() == 0
    long = spark.createDataFrame([(1, '<div class="article">' + N.format("1") + BODY.format("<b>x</b>① y\n" * 60_000) + "</div>")], "page long, html string")
    one = html.law_pages(long, "page").first()
    assert len(one.content) > 200_000 and len(one.paragraphs) == 0


def test_joiner_and_other_selectors(spark):
    df = spark.createDataFrame([("a", "<article><h1>T <i>u</i></h1><p>x<p>y</article><article>no head</article>")], "page string, html string")
    got = html.law_pages(df, "page", block=("body", None), number=("h1", None), title=None, content=("p", None)).collect()
    assert got == []
    row = html.law_pages(df, "page", block=("article", None), number=("h1", None), title=("i", None), content=("p", None), joiner=" ").first()
    assert (row.number, row.title, row.content) == ("T u", "u", "x")


def test_sql_takes_references_as_the_parser_does(spark, tmp_path):
    """A title cut within a reference: as in HTML, a named one needs no semicolon."""
    import duckdb
    from statuta.plans import registry

    cut = ["a &amp", "a &am", "a &lt", "&quot", "a &#x27", "a &#x2", "a &#x", "&amp;lt;", "&amp;amp", "b"]
    pages = [(i, f"<html><body><h1>{x}</h1><article><h1>{x}</h1>p; q &amp; {x}<p>27; &amp;gt</p></article></body></html>") for i, x in enumerate(cut)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, registry.queries()["read_law_html"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracles()["read_law_html"]).fetchall())
    assert [n for _, n, _ in got][:3] == ["a &", "a &am", "a <"]
