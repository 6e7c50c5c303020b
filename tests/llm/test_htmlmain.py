import html
import re

import pytest

from groundshift.llm import htmlmain

from .helpers import SF

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><div class="cookie-notice">We use cookies
to give you the best experience.</div><div class=wrap><article><h1>My title</h1><p>First para with   spaces &amp; such.</p><div class="ad">Buy stuff
now</div><p>Second <i>para</i>.</p><aside>See also other things here.</aside><form><label>Your name</label><input></form><script>var t="</p>";</script></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I think this is a really good article, thanks for writing. It helps.</p></div></section>
</div><footer>&copy; me</footer></body>"""


def article(page):
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    lines = re.sub(r"<[^>]+>", "\n", inner).split("\n")
    return "\n".join(x for line in lines if (x := " ".join(html.unescape(line).split())))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def forest(tables):
    return htmlmain.learn(*tables, most=100)


def shown(page, forest):
    p = htmlmain.describe(page)
    return htmlmain.decode(p, forest.odds(p.features))


def test_held_out_pages(tables, forest):
    pages, docs = tables
    trained = {h for h, _ in htmlmain.training_pages(pages, docs, 100)}
    rest = [r.html for r in pages.collect() if r.html not in trained]
    assert len(trained) == 100 and len(rest) > 100
    assert sum(shown(h, forest) == article(h) for h in rest) >= 0.98 * len(rest)


def test_held_out_layouts(forest):
    rest = htmlmain.made_up_pages(500)[htmlmain.MADE_UP:]
    assert sum(shown(h, forest) == t for h, t in rest) >= 0.9 * len(rest)


def test_clutter_goes(forest):
    assert shown(PAGE, forest) == "My title\nFirst para with spaces & such.\nSecond para."


def test_nothing_below_a_dropped_node(forest):
    page = htmlmain.describe(PAGE)
    odds = forest.odds(page.features)
    i = next(k for k, n in enumerate(page.nodes) if n.tag == "article")
    odds[i:] = -5
    for k, n in enumerate(page.nodes):
        if page.parents[k] == i and n.tag == "p":
            odds[k] = 0.01
    assert "Second" not in htmlmain.decode(page, odds)


def test_odd_pages(spark, tables, forest):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<"), (4, "u", "just text &amp; more of it, with a stop."), (None, "u", "<p>x<p>y"), (4, "u", "<!-- <p>"),
            (5, "u", "<div>" * 3000 + "deep"), (6, "u", "<script>never closed <p>x"), (7, "u", "</p></div><b>"), (8, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = htmlmain.extract(pages, tables[1], forest).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.text) for r in got}
    assert {(1, ""), (2, ""), (8, "My title\nFirst para with spaces & such.\nSecond para.")} <= by
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmlmain.extract(pages.limit(0), tables[1], forest).count() == 0


def test_without_known_documents(spark, tables):
    pages = spark.createDataFrame([(8, "http://a/1", PAGE)], "page_id long, url string, html string")
    assert "Second para." in htmlmain.extract(pages, tables[1].limit(0)).first().text


def test_query_columns(spark):
    from groundshift.llm import queries

    df = queries.op9_html_main_text(spark, SF)
    assert df.columns == ["page_id", "url", "text", "n_chars"] and df.count() == 50
