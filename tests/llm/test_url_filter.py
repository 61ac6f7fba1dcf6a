import re

from pathweave.llm.url_filter import RULES, judge_urls, op8_url_filter
from pathweave.llm import url_filter
from tests.llm.conftest import as_dir

URLS = [None, "", "no scheme", "http://", "http://com/en/", "HTTPS://A.Example.COM/en/7x", "http://example.com/en/6", "http://xexample.com/en/7", "http://net/de/8", "http://www.example.net/de/81?x=/", "http://example.net?/de/8", "x://a.org/es/#y", "x://a.org/es?", "x://a.org/ES/", "http://a://b.com/en/", "http://a.com:80/en/", "http://example.com/en/", "a\nb://q.com/en/\nz?u", "http://..com/en/"] * 2


def brute(url):
    _, sep, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if sep else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if sep else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_query_matches_brute_force(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = op8_url_filter(spark, as_dir(pages, tmp_path, "pages")).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id]), URLS[r.page_id]


def test_long_lists_and_false_hits(spark, monkeypatch):
    """A filter of 16 blocks lets nearly all through; the exact join still decides."""
    from pathweave.llm import url_filter

    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 16)
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", 10)
    listed = spark.range(2000).selectExpr("'block' AS verdict", "concat('h', id, '.example') AS host", "'/' AS path")
    urls = spark.range(4000).selectExpr("concat('http://www.h', id, '.example/x') AS url", "id AS host")
    out = judge_urls(urls, listed)
    assert out.where("verdict = 'block'").count() == 2000
    assert out.where("verdict = 'block' AND _row.host >= 2000").count() == 0


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert judge_urls(pages, none).first().verdict == "allow"
    listed = spark.createDataFrame([(None, "com", "/"), ("block", None, "/"), ("block", "com", "/en/"), ("block", "com", "/en/")], "verdict string, host string, path string")
    assert judge_urls(pages, listed).count() == 1 and judge_urls(pages, listed).first().verdict == "block"
    assert judge_urls(pages.limit(0), listed).count() == 0


def test_very_long_hosts_and_urls(spark):
    host = "a." * 50_000 + "example.com"
    rows = [(1, f"http://{host}/en/1"), (2, f"http://{host}/en/7"), (3, "http://example.com/en/" + "x" * 1_000_000), *[(4 + i, None) for i in range(50)]]
    listed = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = {r["_row"].page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), listed).collect()}
    assert len(got) == 53 and got[1] == got[3] == ("com/en/", "block") and got[2] == ("example.com/en/7", "allow")
    assert all(got[4 + i] == (None, "allow") for i in range(50))
