import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.mixing import fit_budget, mix, word_count
from llm.conftest import ODD_TEXTS


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by name, sharing the excess again until none is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda x: x.encode()) + ([None] if None in sizes else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, out, open_ = sum(sizes.values()) * share, {}, set(names)
    while open_:
        left = total - sum(out.values())
        held = sum(weight[k] for k in open_)
        full = {k for k in open_ if left * weight[k] / held > most * sizes[k]}
        if not full:
            out.update({k: left * weight[k] / held for k in open_})
            break
        out.update({k: most * sizes[k] for k in full})
        open_ -= full
    return out


def run(docs, **more):
    return mix(docs, word_count(F.col("text")), **more).collect()


def checked(rows, docs, near=1.0):
    """``near``: words that a source's taken words may miss its target by;
    None: as few as any choice of its documents does."""
    want = Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs)
    assert Counter((r["doc"], r["source"], r["size"]) for r in rows) == want
    sizes = defaultdict(int)
    for (_, s, n), c in want.items():
        sizes[s] += n * c
    goal = targets(sizes)
    took = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        took[r["source"]] += r["taken"]
    for s in sizes:
        may = near
        if may is None:
            whole = int(goal[s] // sizes[s]) * sizes[s]
            own = Counter(n for (_, x, n), c in want.items() if x == s for _ in range(c))
            may = min(abs(whole + x - goal[s]) for x in best_sums(list(own), list(own.values()))) + 1
        assert abs(took[s] - goal[s]) <= may


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = run(docs)
    checked(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], near=None)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, run(docs.repartition(7))))


def test_many_short_documents_meet_targets(spark, monkeypatch):
    monkeypatch.setattr("ledgerlens.llm.mixing.ROW_GROUP", 10)
    rng = random.Random(4)
    docs = [(i, "w " * rng.randrange(0, 40), rng.choice(["é", "a", "Z", None, "z"])) for i in range(600)]
    docs += [(1000 + i, "same words here", "a") for i in range(300)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = run(table)
    checked(rows, docs)
    assert sorted(map(repr, rows)) != sorted(map(repr, run(table, seed=1)))


def test_odd_rows(spark, odd, empty):
    rows = run(odd)
    assert len(rows) == len(ODD_TEXTS)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert run(empty) == []
    no_words = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in run(no_words)] == [(0, 0.0)] * 2


def best_sums(lengths, counts):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    return sums


def test_fit_is_the_best_sum():
    rng = random.Random(0)
    for _ in range(300):
        lengths = rng.sample(range(0, 30), rng.randrange(1, 6))
        counts = [rng.randrange(0, 4) for _ in lengths]
        budget = rng.randrange(0, 120)
        took = fit_budget(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(took, counts, strict=True))
        got = sum(n * k for n, k in zip(lengths, took, strict=True))
        assert abs(got - budget) == min(abs(s - budget) for s in best_sums(lengths, counts))
    assert sum(n * k for n, k in zip([1, 50], fit_budget([1, 50], [200, 10], 333, last=40), strict=True)) == 333


def test_large_counts_meet_a_large_budget():
    lengths, counts = list(range(1, 2000)), [10**6] * 1999
    budget = 7 * 10**11 + 13
    assert sum(n * k for n, k in zip(lengths, fit_budget(lengths, counts, budget), strict=True)) == budget
