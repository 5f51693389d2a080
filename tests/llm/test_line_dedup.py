import hashlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import line_dedup as module
from ledgerlens.llm.bitmaps import Lookup, build, pack
from ledgerlens.llm.line_dedup import line_dedup
from llm.conftest import ODD_TEXTS, lower_ascii

WHITE = " \t\n\r\x0b\x0c"


def brute(rows):
    owners = defaultdict(set)
    parts = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keys = [lower_ascii(x.strip(WHITE)) for x in lines]
        parts.append((i, lines, keys))
        for k in keys:
            if len(k) >= 10:
                owners[k].add(2**63 if i is None else i)
    out = []
    for i, lines, keys in parts:
        me = 2**63 if i is None else i
        left = [x for x, k in zip(lines, keys, strict=True)
                if len(k) < 10 or len(owners[k]) < 2 or min(owners[k]) == me]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def result(docs, **more):
    rows = line_dedup(docs, **more).collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    return sorted((-1 if r["doc"] is None else r["doc"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows)


def test_equals_brute_force(spark, sf, odd, empty):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        assert result(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert result(empty) == []


@pytest.mark.parametrize("probes", [1, 1000])
def test_frequent_line_in_many_slices(spark, probes, monkeypatch):
    monkeypatch.setattr(module, "SLICE_PROBES", probes)
    rows = [(i, f"A common line here\nown line number {i}\n  a COMMON line here\r\nshort") for i in range(40, 0, -1)]
    docs = spark.createDataFrame(rows + ODD_TEXTS, "doc_id long, text string")
    assert result(docs, shards=2) == brute(rows + ODD_TEXTS)


def test_ten_code_points():
    assert [h is not None for h in module.line_hashes("ééééééééé\néééééééééé\n123456789 \n1234567890".encode(), 10)] == [
        False, True, False, True]


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        h1, h2 = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        h1[: n // 3] = 7  # keys that differ in their second half only
        at = Lookup(*pack(build(h1, h2)))(h1, h2)
        assert sorted(at.tolist()) == list(range(n))
