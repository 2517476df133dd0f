import numpy as np
import pytest
from fixtures import rows

from evtide.llm import url_filter as uf
from evtide.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host, path = uf.split_url(url)
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, v)
    return (host, path, *(best or (None, default)))


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/en/12?x#y", "http://example.org",
        "https://a.b.example.org/es/1", "https://notexample.org/es/1", "ftp://x.com/fr/",
        "x://y.com/de/#f", "http://com/fr/a", "http://é.org/", "http://org?x=/", "a://b://c.org/",
        "http://org/" + "p" * 100_000, "http://" + "a." * 5000 + "org/"]


def test_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate(URLS * 2)],
                                  "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in uf.filter_urls(pages, URL_RULES).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(URLS * 2)}


def test_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert rows(uf.filter_urls(pages, URL_RULES)) == []
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert rows(uf.filter_urls(one, [])) == [(1, "http://a.org/", "a.org", "/", None, "allow")]


def test_two_verdicts_are_refused():
    with pytest.raises(ValueError):
        uf.build_index([("a", "/", "allow"), ("a", "/", "block")])


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(uf, "_keys", lambda s: np.zeros(len(s), np.uint64))
    path = tmp_path / "index"
    path.write_bytes(uf.build_index(URL_RULES))
    index = uf.DigestIndex(str(path))
    urls = [uf.split_url(u) for u in URLS[:-2]]
    assert [g[0] for g in index.judge(urls)] == [brute(u, URL_RULES)[2] for u in URLS[:-2]]
