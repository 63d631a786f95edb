"""URL rules, redirects and canonical links."""

import random

import duckdb
from pyspark.sql import functions as F

from quillrec.llm.url_filter import ORACLE, RULES, judge, resolved

LINK = '<html><head><LINK rel="canonical" href="{}"></head></html>'
JUMP = """<meta http-equiv='refresh' content='0; url={}'>"""


def verdicts(spark, rows, rules=RULES):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, verdict int")
    return {r.page_id: (r.rule, r.verdict) for r in judge(df, rules).collect()}


def test_rules(spark):
    rows = [
        (1, "https://WWW.Example.COM/en/x?q#f", None), (2, "http://a.example.com/en/", ""), (3, "http://example.com/en", ""), (4, "http://notexample.com/en/a", ""),
        (5, "http://x.net/es/1", ""), (6, "http://x.net/de/1", ""), (7, "example.com/en/", ""), (8, None, ""), (9, "http://example.com", ""), (10, "a://b://com/en/", ""),
        (11, "http://x.com/fr/://net/es/", ""), (12, "http://net/fr/", ""), (13, "", ""),
    ]
    assert verdicts(spark, rows) == {
        1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("com/", "allow"), 4: ("com/", "allow"), 5: ("net/es/", "block"), 6: (None, "allow"),
        7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: ("com/", "allow"), 12: ("net/fr/", "block"), 13: (None, "allow"),
    }


def test_parts_of_urls(spark):
    df = spark.createDataFrame([(1, "ftp://ÀB.Com:80/P/a?x=/y#z", ""), (2, "x://h?q/w", ""), (3, "x://h#/w", ""), (4, None, "")], "page_id long, url string, html string")
    assert {r.page_id: (r.host, r.path) for r in judge(df).collect()} == {1: ("Àb.com:80", "/P/a"), 2: ("h", ""), 3: ("h", ""), 4: ("", "")}


def test_decisions_reach_aliases(spark):
    rows = [
        (1, "http://bad.net/es/1", JUMP.format("http://a.org/1")), (2, "https://a.org/1/?utm_source=f#top", ""), (3, "http://b.org/2", LINK.format("//a.org/1?ref=z")),
        (4, "http://c.org/3", LINK.format("http://b.org/2")), (5, "http://c.org/x/4", LINK.format("/3")), (6, "http://c.org/x/5", LINK.format("4")), (7, "http://d.org/1", ""),
        (8, "http://good.com/1", LINK.format("http://e.org/1")), (9, "http://e.org/1", JUMP.format("http://z.net/fr/1")), (10, "http://z.net/fr/1", ""), (11, "http://good.com/2", LINK.format("http://a.org/1")),
        (12, "http://f.org/", '<link rel="stylesheet" href="http://bad.net/es/1">'),
    ]
    got = verdicts(spark, [r for r in rows if r[0] != 11])
    assert {i for i, v in got.items() if v[1] == "block"} == {1, 2, 3, 4, 5, 6, 10}
    # an explicit allow anywhere among the aliases goes before the blocks that reach them, but not before a page's own rule
    assert {i for i, v in verdicts(spark, rows).items() if v[1] == "block"} == {1, 10}


def test_rules_reach_targets_that_are_no_rows(spark):
    rows = [
        (1, "http://a.org/1", LINK.format("http://x.net/es/1")), (2, "http://b.org/1", JUMP.format("http://y.net/fr/2")), (3, "http://b.org/3", LINK.format("/1")),
        (4, "http://p.net/es/9", LINK.format("http://c.org/1")), (5, "http://c.org/1", LINK.format("http://uncrawled.com/1")), (6, "http://d.org/1", LINK.format("http://x.net/de/1")),
        (7, "http://net/es", LINK.format("//NET/es/")),
    ]
    got = verdicts(spark, rows)
    assert {i for i, v in got.items() if v[1] == "block"} == {1, 2, 3, 4, 7} and {i for i, v in got.items() if v[0]} == {4}


def test_relative_targets(spark):
    base = "http://a.org/b/c/d;p?q#f"
    want = {
        "g": "http://a.org/b/c/g", "./g": "http://a.org/b/c/g", "/g": "http://a.org/g", "//g": "http://g", "?y&amp;z": "http://a.org/b/c/d;p?y&z", "g?y/./x": "http://a.org/b/c/g?y/./x",
        "#s": "http://a.org/b/c/d;p?q#s", "g#s/../x": "http://a.org/b/c/g#s/../x", "../g": "http://a.org/b/g", "../../../g": "http://a.org/g", "g/./h/../i": "http://a.org/b/c/g/i",
        "x:y://z": "http://a.org/b/c/x:y://z", "?u=http://x.net/es/": "http://a.org/b/c/d;p?u=http://x.net/es/", "https://h/./a": "https://h/./a",
    }
    df = spark.createDataFrame([(t, base) for t in want], "t string, url string")
    assert {r.t: r.to for r in df.select("t", resolved(F.col("t"), F.col("url")).alias("to")).collect()} == want


def test_the_sql_says_the_same(spark):
    """Random pages whose links are absolute, relative, folded, or lead to pages that were never fetched."""
    rng = random.Random(21)
    hosts = ("a.org", "b.org", "x.net", "Shop.com", "www.example.com", "c.org")
    paths = ("/", "/es/1", "/en/x", "/fr/../es/2", "/p/q/r", "", "/p/q/")
    links = ("../es/1", "/es/2", "./x", "?a=1&amp;b=2", "#top", "//x.net/fr/3", "http://never.net/es/7", "http://never.org/1", "q", "/p/./q/r", "https://Shop.com/1", "../../../es/1")
    rows = []
    for i in range(160):
        html = rng.choice((LINK, JUMP)).format(rng.choice(links) if rng.random() < 0.7 else f"http://{rng.choice(hosts)}{rng.choice(paths)}") if rng.random() < 0.6 else None
        rows.append((i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(('', '?k=' + str(i)))}" if i % 20 else rng.choice((None, "no scheme")), html))
    got = sorted((tuple(r) for r in judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(ORACLE).fetchall(), key=str)
    assert 10 < sum(v == "block" for *_, v in got) < 150


def test_long_chains_and_odd_rows(spark):
    rows = [(i, f"http://h{i}.org/", LINK.format(f"http://h{i + 1}.org/")) for i in range(70)] + [(70, "http://h70.org/", JUMP.format("http://q.net/es/1")), (71, "http://q.net/es/1", None), (71, "http://q.net/es/1", None), (None, "http://h3.org", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = judge(df).collect()
    assert len(got) == 74 and all(r.verdict == "block" for r in got)
    assert judge(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert "Python" not in judge(pages)._jdf.queryExecution().executedPlan().toString()
