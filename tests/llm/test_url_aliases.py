"""Redirects and canonical links planted in pages: resolution against the standard library, verdicts against SQL."""

from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from sparkveil.llm import oracles, url_filter

BASES = ["http://h.com/a/b/c?x=1", "https://h.com/a/", "http://h.com", "http://h.com/f"]
REFERENCES = ["../x", "./x", ".", "..", "../", "../../../x", "x/./y/../z", "?q=1", "/r/../s", "//k.com/a/./b", "http://k.com/a/../b?p=../q", "x?y=../z", "x#f", "/", "e.html", "..x", "x..", "a/.../b"]


def resolved(base, ref):
    """The standard library leaves the dots of a reference that names a host; they go in a second step."""
    at = urlsplit(urljoin(base, ref))
    return urljoin(f"{at.scheme}://{at.netloc}", at.path + ("?" + at.query if at.query else ""))


def test_references_resolve_as_the_standard_library_does(spark):
    rows = [(b, r, resolved(b, r)) for b in BASES for r in REFERENCES]
    # The library drops empty segments, against RFC 3986.
    rows += [("http://h.com/a//b/d", "../x", "http://h.com/a//x"), ("http://h.com/a//b/d", "..", "http://h.com/a//"), ("http://h.com/a//b/d", "x/./y/../z", "http://h.com/a//b/x/z")]
    got = spark.createDataFrame(rows, "url string, ref string, want string").select("*", url_filter.target(F.col("url"), F.col("ref")).alias("got")).collect()
    assert not [r for r in got if r.got != r.want]
    none = spark.createDataFrame([("http://h.com/a", r) for r in ("#top", "mailto:x@y.z", "javascript:f()")], "url string, ref string")
    assert {r[0] for r in none.select(url_filter.target(F.col("url"), F.col("ref"))).collect()} == {None}


def _pages():
    canonical = lambda to, rel='rel="canonical"': f"<head><link {rel} href='{to}'></head>"
    rows = [
        ("http://a.com/p/q", canonical("../bad")), ("http://a.com/bad", canonical("https://x.net/")), ("http://b.com/1", canonical("?v=2", 'rel="shortlink canonical"')), ("http://b.com/1?v=2", canonical("https://x.net/", "rel=canonical")),
        ("http://c.com/1", canonical("https://x.net/", 'rel="canonical-ish"')), ("http://c.com/2", canonical("https://x.net/", 'rel="not" title="canonical"')), ("http://d.com/1", canonical("#top")), ("http://d.com/", canonical("https://x.net/")),
        ("http://e.com/1", '<meta http-equiv="refresh" content="0;url=./2;k=1?a=1&amp;b=2">'), ("http://e.com/2;k=1?a=1&b=2", canonical("//x.net/y")), ("http://y.example.net/en/1", canonical("https://x.net/")), ("http://f.com/1", canonical("http://y.example.net/en/1")),
        ("http://g.com/1", canonical("http://g.com/2") + canonical("http://g.com/3")), ("http://g.com/3", canonical("mailto:x")), (None, canonical("http://x.net/")), ("no", canonical("http://x.net/")), ("http://g.com/3", None),
    ]
    chain = [(f"http://k.com/{i}", canonical(f"{i + 1}")) for i in range(150)] + [("http://k.com/150", canonical("http://www.example.com/de/x"))]
    hub = [(f"http://m.com/{i}", canonical("/hub")) for i in range(200)]
    return [(i, u, h) for i, (u, h) in enumerate(rows + chain + hub)]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame(_pages(), "page_id long, url string, html string").repartition(5)
    return url_filter.judge(df).collect()


def test_verdicts_equal_sql_where_links_are_planted(judged):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(_pages(), columns=["page_id", "url", "html"]))
    want = con.execute("SELECT page_id, host, path, rule, verdict FROM (" + oracles.OP10 + ")").fetchall()
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in judged)


def test_blocks_reach_aliases_and_no_others(judged):
    verdict = {r.page_id: r.verdict for r in judged}
    assert [i for i in range(17) if verdict[i] == "block"] == [0, 1, 2, 3, 7, 8, 9, 11]
    assert {verdict[i] for i in range(17, 168)} == {"block"} and {verdict[i] for i in range(168, 368)} == {"allow"}
