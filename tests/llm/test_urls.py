import re

from groundshift.llm import urls

from .helpers import SF


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, domain, start in urls.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start) and (best is None or len(domain + start) > len(best[0])):
            best = (domain + start, verdict)
    return host, path, best


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_rules(spark):
    odd = [None, "", "nope", "HTTP://EXAMPLE.Org", "a://b://c/d?x://", "http://x.com?q/#", "x:///p/1", "http://example.org/es/\n/x", "https://é.com/fr/ü",
           "http://notexample.org/es/1", "http://a.example.org/en/1#f", "http://org/"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(None, "http://a.com/de/1"), (0, None)]
    rows += [(100 + r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'x' AS raw", "'x' AS template")
    got = sorted(urls.judge(pages, spark.read.parquet(f"{SF}/labels.parquet")).collect(), key=lambda r: (str(r.page_id), r.host, r.path))
    want = sorted(((i, *plain(u)) for i, u in rows), key=lambda r: (str(r[0]), r[1], r[2]))
    assert [(r.page_id, r.host, r.path, r.rule) for r in got] == [(i, h, p, b[0] if b else None) for i, h, p, b in want]
    assert all(r.verdict == b[1] if b else r.verdict in ("allow", "block") for r, (*_, b) in zip(got, want))


def test_branches_are_merged_and_rejected(spark):
    rows = [(i, f"http://h.net/{'spam' if i % 4 == 0 else 'good' + str(i % 3)}/{i}.html") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(pages, labels(spark, [(i, 0 if i % 4 == 0 else 1, 0) for i in range(800)]))
    assert {tuple(r) for r in got.groupBy("template", "verdict").count().collect()} == {
        ("/spam/*.html", "block", 200), ("/good0|good1|good2/*.html", "allow", 600)}


def test_rare_literals_become_wildcards(spark):
    rows = [(i, f"http://h.net/user-{chr(97 + i % 26)}{chr(97 + i // 26)}/profile") for i in range(200)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels(spark, []))
    assert {r.template for r in got.collect()} == {"/*/profile"}


def test_few_bad_labels_do_not_reject(spark):
    rows = [(i, f"http://h{i % 50}.net/a/{i}") for i in range(500)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels(spark, [(0, 0, 0), *((i, 1, 0) for i in range(100, 300))]))
    assert {r.verdict for r in got.collect()} == {"allow"}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/b")], "page_id long, url string")
    assert urls.judge(pages.limit(0), labels(spark, [])).count() == 0
    assert urls.judge(pages, labels(spark, [])).first().verdict == "allow"
