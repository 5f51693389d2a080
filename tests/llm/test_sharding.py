import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import ranks
from ledgerlens.llm.sharding import balanced_shards, capacities, grant, shard_documents
from llm.conftest import ODD_TEXTS


def checked(rows, texts, shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts)
    assert [counts[s] for s in range(shards)] == capacities(len(rows), shards).tolist()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r["doc"], r["size"], r["text_crc32"]) for r in rows) == want


def spread_of(rows):
    where = defaultdict(set)
    for r in rows:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    return where


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shard_documents(docs).collect()
    checked(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 16)
    assert all(len(s) == 1 for s in spread_of(rows).values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, shard_documents(docs.repartition(5)).collect()))


def test_odd_rows(odd, empty):
    checked(shard_documents(odd, 4).collect(), ODD_TEXTS, 4)
    assert shard_documents(empty).collect() == []


@pytest.mark.parametrize("hot, n", [(70, 200), (200, 200), (3, 7)])
def test_group_larger_than_a_shard(spark, hot, n):
    texts = [(i, "same" if i < hot else f"text {i // 2}") for i in range(n)]
    rows = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), 8).collect()
    checked(rows, texts, 8)
    # most copies are in as few shards as they need, most pairs together
    used = Counter(r["shard"] for r in rows if r["size"] == 5)
    fewest = -(-hot // -(-n // 8))
    assert sum(c for _, c in used.most_common(fewest)) >= 0.5 * hot
    pairs = [s for (size, _), s in spread_of(rows).items() if size != 5]
    assert sum(len(s) > 1 for s in pairs) <= 2 + len(pairs) // 4


def test_only_linked_rows_swap(spark):
    """No free places at all: only swaps can move anything."""
    rows = spark.createDataFrame([(i, i % 40) for i in range(160)], "doc long, g long")
    out = balanced_shards(rows, F.col("g"), [F.col("doc")], 4).collect()
    assert Counter(Counter(r["shard"] for r in out).values()) == {40: 4}
    where = defaultdict(Counter)
    for r in out:
        where[r["g"]][r["shard"]] += 1
    kept = sum(max(c.values()) for c in where.values())
    start = 160 / 4 + 40  # a group of four dealt at random has a bit more than one together
    assert kept > start


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 2)], "doc long, slot long")
    with pytest.raises(ValueError, match="slot"):
        balanced_shards(rows, F.col("doc"), [F.col("doc")])


def test_grants_never_overfill():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = int(rng.integers(2, 6))
        wishes = rng.integers(0, 4, (s, s, 16)) * rng.integers(0, 2, (s, s, 1))
        wishes[np.arange(s), np.arange(s)] = 0
        room = rng.integers(0, 20, s)
        steps = grant(wishes, room)
        moved = np.array([[wishes[i, j, :steps[i, j]].sum() for j in range(s)] for i in range(s)])
        assert (moved.sum(axis=0) - moved.sum(axis=1) <= room).all()


@pytest.mark.parametrize("buckets", [1, 7])
def test_ranks_are_gapless(spark, buckets):
    rows = spark.createDataFrame([(i, i % 3 or None) for i in range(200)], "a long, k long")
    out = ranks.add_rank(rows, "rank", ["k"], [F.col("a")], ranks.dealt(F.xxhash64("a"), F.lit(buckets))).collect()
    by = defaultdict(list)
    for r in out:
        by[r["k"]].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(out) == 200
    ordered = ranks.add_rank(rows, "rank", ["k"], [F.col("a")], F.expr("a div 16")).collect()
    for k in by:
        own = sorted((r["a"], r["rank"]) for r in ordered if r["k"] == k)
        assert [x[1] for x in own] == list(range(len(own)))
