import random
import re
from collections import Counter

import numpy as np
import pytest

import ledgerlens.llm.collocations as module
from llm.conftest import lower_ascii
from ledgerlens.llm.bloom import BlockedBloom
from ledgerlens.llm.collocations import best_phrases, candidates, count_phrases


def brute_force(rows, longest=3, least=10, percent=50):
    """``{(lang, phrase): (a, l, r, n, score, kept)}`` from all phrases of all texts."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    out = {}
    found = {k: c for k, c in f.items() if len(k[1]) >= 2 and c >= least}
    for (lang, p), a in found.items():
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        kept = not any(o == lang and len(q) > len(p) and 100 * c >= percent * a and
                       any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), c in found.items())
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score, kept)
    return out


def found(df):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"], r["kept"]) for r in df.collect()}


def texts(count=400, seed=3):
    """Few words, so that phrases repeat; one pair holds a third of all rows."""
    rng = random.Random(seed)
    words = ["a", "b", "B", "c", "d", "e\x01", "é", "É", "f\xa0g", "\x00", "hot", "pair"]
    rows = []
    for i in range(count):
        n = rng.choice([0, 1, 2, 3, 30])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",,"]) for _ in range(n))
        rows.append((rng.choice(["x", "y", None, "und", "a\tb"]), "Hot pair hot pair of" if i % 3 == 0 else text))
    return [*rows, ("x", None), (None, None), ("z", ""), ("z", " \t\n"), *rows[:5]]


@pytest.mark.parametrize("longest,least,percent", [(3, 10, 50), (2, 3, 50), (4, 5, 80), (3, 1, 0)])
def test_equals_brute_force(spark, longest, least, percent):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute_force(rows, longest, least, percent)
    assert want and found(candidates(docs, longest, least, percent)) == want


def test_ranges_cut_inside_a_hot_word(spark):
    """All phrases begin and end with one word, over more ranges than words:
    open phrases and extensions cross the ranges."""
    rng = random.Random(5)
    rows = [("x", f"w {rng.randrange(40)} w {rng.randrange(40)} w") for _ in range(300)] + [("y", "w w w w")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(candidates(docs, 3, 1, 30))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_force(rows, 3, 1, 30)


def test_small_buffers_and_long_texts(spark, monkeypatch):
    """Counts don't depend on where buffers end; a text of many buffers is whole."""
    raw = [b"a b c. a b c d! " * 500, b"a", b"", b"a b c"]

    def counts(length):
        out = Counter()
        for table in count_phrases(raw, length):
            for key, f in zip(table.column("key").to_pylist(), table.column("f").to_pylist(), strict=True):
                out[key] += f
        return out
    want = [counts(n) for n in (1, 2, 3)]
    assert want[0][b""] == 500 * 7 + 4 and want[2][b"a\tb\tc\t"] == 1001
    monkeypatch.setattr(module, "WORDS", 7)
    assert [counts(n) for n in (1, 2, 3)] == want
    pieces = list(module.words_and_cuts(raw[0], at_once=5))
    assert len(pieces) > 100 and sum(pieces, []) == sum(module.words_and_cuts(raw[0]), [])


def test_phrases_with_rare_parts_are_left_out(spark, monkeypatch):
    """Only work is saved: a filter that holds everything changes nothing."""
    rows = texts(200)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = found(candidates(docs, 3, 4))
    few = module.frequent_phrases(docs, 3, 4).count()
    monkeypatch.setattr(module, "build", lambda *a: BlockedBloom(np.full((1, 8), 2**64 - 1, np.uint64)))
    assert found(candidates(docs, 3, 4)) == want == brute_force(rows, 3, 4)
    assert module.frequent_phrases(docs, 3, 4).count() == few


def test_products_past_64_bits():
    row = ("x", b"b\ta\t", 4 * 10**18, [5 * 10**18], 0, 10**19)
    header = [("x", b"", 9, [], 0, 9), ("x", b"b\t", 6 * 10**18, [], 0, 9), row]
    (out,) = module._scored(module._walk(header, [], {}), 10, 50)
    assert out[2:] == (4 * 10**18, 5 * 10**18, 6 * 10**18, 10**19, 1_000_000 * 16 // 30, True) and out[1] == "a b"


def test_first_ranks_and_ties(spark):
    rows = [("x", f"p{i:03} q{i:03}") for i in range(30) for _ in range(2)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    out = best_phrases(candidates(docs, 3, 2), top=7).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in out] == [(i + 1, f"p{i:03} q{i:03}", 1_000_000) for i in range(7)]


def test_odd_and_empty(odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    got = found(candidates(odd))
    assert got == brute_force(rows) and got["en", "word word word"][0] == 29_998
    assert candidates(empty).count() == 0 and best_phrases(candidates(empty)).count() == 0
