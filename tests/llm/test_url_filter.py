import itertools
import time

from tagweave.llm.queries import URL_RULES
from tagweave.llm.url_filter import Rule, RuleTrie, judge_urls

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/1",
    "http://a.example.com/en", "http://example.com/en/", "https://x.net/es/", "https://net/fr/a", "http://x.net/de/",
    "http://xnet/es/", "ftp://example.com:80/en/", "http://example.com?x=/en/", "a://b://c.com/", "http://Ünï.com/",
]


def brute(rules, host, path):
    fit = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    depth = lambda r: len(r.host.split(".")) if r.host else 0
    return max(fit, key=lambda r: (depth(r), len(r.path), r.verdict == "block"), default=None)


def test_trie_matches_a_scan_of_all_rules():
    hosts = ["", "com", "b.com", "a.b.com", "c.com", "bcom", "b..com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "//"]
    rules = [Rule(h, p, v) for h, p, v in itertools.product(hosts[:4], paths, ("allow", "block"))][::3]
    trie = RuleTrie(rules)
    for host, path in itertools.product(hosts, paths):
        assert trie.match(host, path) == brute(rules, host, path), (host, path)


def test_many_rules_under_one_host():
    rules = [Rule("a.com", f"/x{i}", "block") for i in range(100_000)] + [Rule("a.com", "/x", "allow")]
    began = time.process_time()
    trie = RuleTrie(rules)
    for i in range(0, 100_000, 7):
        assert trie.match("b.a.com", f"/x{i}").path == f"/x{i}"
    assert trie.match("a.com", "/xy").verdict == "allow" and trie.match("a.com", "/y") is None
    assert trie.match("a.com", "/x99999zz/t").path == "/x99999"
    assert time.process_time() - began < 20


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(URLS)], "page_id INT, url STRING, html STRING, host STRING")
    rows = {r["page_id"]: r for r in judge_urls(pages, URL_RULES).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        r = rows[i]
        want = brute(URL_RULES, r["host"], r["path"])
        assert (r["rule"], r["verdict"]) == ((str(want), want.verdict) if want else (None, "allow"))
        if not url or "://" not in url:
            assert (r["host"], r["path"]) == ("", "")
    assert (rows[6]["host"], rows[6]["path"], rows[6]["rule"]) == ("www.example.com", "/en/x", "www.example.com/en/")
    assert rows[8]["rule"] == "com/" and rows[9]["verdict"] == "block" and rows[15]["path"] == ""


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id INT, url STRING")
    assert judge_urls(empty, URL_RULES).collect() == []
