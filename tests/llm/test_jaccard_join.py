import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import grouped
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.jaccard_join import band_limits, jaccard_components, part_keys
from ledgerlens.llm.words import shingle_set
from llm.conftest import ODD_TEXTS


def brute_components(texts, k, percent):
    """id -> (set size, smallest id reachable), over all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc"]: (r["n_shingles"], r["component"]) for r in jaccard_components(docs, 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_odd_rows(odd, empty):
    got = jaccard_components(odd, 4, 85).collect()
    assert len(got) == len(ODD_TEXTS)
    by_id = {r["doc"]: (r["n_shingles"], r["component"]) for r in got if r["doc"] is not None}
    assert by_id[2] == (9, 1) and by_id[9] == (10, 1) and by_id[12] == (11, 12)
    assert by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (0, 5)
    assert by_id[8] == (1, 7) and by_id[10] == (1, 10)
    assert sorted((r["n_shingles"], r["component"] or -1) for r in got if r["doc"] is None) == [(0, -1), (1, 7)]
    assert jaccard_components(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_similar_sets_share_a_key(percent):
    """The pigeonhole argument, on random sets of all sizes at the threshold."""
    rng = np.random.default_rng(3)
    limits = band_limits(percent)
    for n in [1, 2, 3, 5, 7, 8, 10, 13, 17, 20, 33, 47, 64, 100, 333, 1500]:
        for _ in range(40):
            union = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            odd = int((100 - percent) * len(union) // 100)
            gone = rng.permutation(len(union))[:odd]
            left = rng.integers(0, odd + 1)
            x = np.delete(union, gone[:left])
            y = np.delete(union, gone[left:])
            assert 100 * len(np.intersect1d(x, y)) >= percent * len(union)
            if len(x) and len(y):
                assert len(np.intersect1d(part_keys(x, percent, limits), part_keys(y, percent, limits)))


def near_copies(count, apart, seed=7):
    """Near copies of one text, of which every ``apart``-th is of a neighbour
    group that links to some of them but not to the first."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(count):
        words = list(base)
        if apart and i and i % apart == 0:
            for j in range(30, 36):  # too far from the first document
                words[j] = f"x{j}"
        words[rng.randrange(20)] = f"y{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("apart", [0, 9, 2])
def test_large_groups_meet_their_first_member(spark, monkeypatch, apart):
    """Blocks of ten: members unlike the first one still meet all others."""
    monkeypatch.setattr(grouped, "BLOCK_MEMBERS", 10)
    rows = near_copies(150, apart)
    chain = " ".join(f"w{i}" if not 30 <= i < 36 or i < 33 else f"x{i}" for i in range(60))
    rows += [(1000, chain), (1001, chain + " end"), (None, chain), (1001, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc"]: r["component"] for r in jaccard_components(docs, 2, 80).collect() if r["doc"] not in (None, 1001)}
    want = brute_components(dict(r for r in rows if r[0] not in (None, 1001)), 2, 80)
    assert got == {i: c for i, (_, c) in want.items()}


def test_near_copies_are_dealt_once(spark):
    """3,000 near copies: each text goes to one block, the first to all."""
    members = spark.range(3000).selectExpr("0L AS pivot", "id AS doc")
    large = spark.createDataFrame([(0, 0, 12)], "p long, head long, blocks int")
    deal = grouped.first_deal(members, large)
    assert deal.count() == 2999 + 12 and deal.where("side = 2").select("j").distinct().count() == 12
    left = members.where("doc > 2990")
    n = members.select("doc", F.lit(50).alias("n"))
    assert grouped.second_deal(members, left, large, n).count() == 3000 + 9 * 12


def test_shingles_of_words():
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"a b c d e", 4)) == 2
    assert len(shingle_set(b"a a a a a a a", 4)) == 1 and len(shingle_set(b" \t", 4)) == 0
    assert shingle_set(b"A b C d", 4) == shingle_set(b"a  B\nc\x0bD", 4)
    assert len(shingle_set(None, 4)) == 0
    assert shingle_set("x y".encode(), 1).size == 1  # not an ASCII white space


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links += [(0, None), (500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(root)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
