import random
import time

import numpy as np

from ledgerlens.llm import url_filter as module
from ledgerlens.llm.bloom import BlockedBloom, places
from ledgerlens.llm.queries import URL_RULES
from ledgerlens.llm.url_filter import candidates, canonical, url_filter
from llm.conftest import lower_ascii

URLS = [None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://example.com",
        "http://example.com/en", "http://notexample.com/en/1", "http://a.b.example.com/en/1", "http://com/", "http://x.net/fr/",
        "http://x.net/frog", "ftp://net/es/?a://b", "http://example.com?x=/en/", "http://example.com#/en/", "http://É.com/A/É",
        "x://y://z/en/", "http://www.example.com/en/a", "http://sub.www.example.com/en/a", "http://example.com./en/",
        "http://" + "a." * 300 + "com/" + "p" * 5000]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = lower_ascii(rest[:cut]), rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best[0] if best else None, best[1] if best else default


def run(spark, pages, rules):
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    return sorted((repr(r["id"]), r["host"], r["path"], repr(r["rule"]), r["verdict"]) for r in url_filter(pages, table).collect())


def test_rules_of_the_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted((repr(r["page_id"]), h, p, repr(x), v) for r in pages.collect()
                  for h, p, x, v in [brute(r["url"], URL_RULES)])
    assert run(spark, pages, URL_RULES) == want


def test_odd_urls_and_repeated_rows(spark):
    rows = [(i if i % 5 else None, u, "h", "r") for i, u in enumerate(URLS * 2)] + [(1, URLS[4], "h", "r")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    want = sorted((repr(i), h, p, repr(x), v) for i, u, _, _ in rows for h, p, x, v in [brute(u, URL_RULES)])
    assert run(spark, pages, URL_RULES) == want
    assert run(spark, pages.where("false"), URL_RULES) == []
    assert {r[-1] for r in run(spark, pages, ())} == {"allow"}


def test_many_rules(spark, monkeypatch):
    rng = random.Random(2)
    rules = {(f"h{rng.randrange(40)}.net", f"/{rng.randrange(5)}" * rng.randrange(3)): rng.choice(["allow", "block"])
             for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(i, f"http://{'w.' * rng.randrange(3)}h{rng.randrange(60)}.net/{rng.randrange(6)}/{rng.randrange(6)}x") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted((repr(i), h, p, repr(x), v) for i, u in rows for h, p, x, v in [brute(u, rules)])
    assert run(spark, pages, rules) == want
    # a filter that passes everything changes nothing: the join is exact
    monkeypatch.setattr(module, "BlockedBloom", lambda words: BlockedBloom(np.full_like(words, 2**64 - 1)))
    assert run(spark, pages, rules) == want


def test_a_very_long_host_is_linear():
    """Only parent domains of a listed length are built."""
    host = "a." * 2_500_000 + "example.com"
    begun = time.perf_counter()
    assert candidates(host, "/en/" + "x" * 1000, [(3, 1), (11, 4), (15, 4), (10, 1)]) == ["a.a.example.com/en/", "example.com/en/", "com/"]
    assert time.perf_counter() - begun < 1 and candidates("", "/", [(3, 1)]) == []


def test_hot_equal_rows(spark, monkeypatch):
    """Equal rows come out as many as they are, from arrays of a bounded length."""
    monkeypatch.setattr(module, "HEAP", 7)
    pages = spark.createDataFrame([(None, "http://example.com/en/")] * 50 + [(None, None)] * 15 + [(1, None)], "page_id long, url string")
    got = run(spark, pages, URL_RULES)
    assert len(got) == 66 and got.count(("None", "example.com", "/en/", "'example.com/en/'", "block")) == 50


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    words = np.zeros((200, 8), np.uint64)
    block, bits = places(keys, 200)
    np.bitwise_or.at(words, block, bits)
    bloom = BlockedBloom(words)
    assert bloom.hits(keys).all()
    assert bloom.hits(rng.integers(0, 2**63, 20000, dtype=np.uint64)).mean() < 0.05


def test_canonical():
    assert canonical("HTTP://A.B/C?d#e") == ("a.b", "/C") and canonical("a#b://c/d") == ("c", "/d")
