import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.decontaminate import contamination, is_contaminated, without_spans, word_list
from llm.conftest import ODD_TEXTS, lower_ascii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower_ascii(text or ""))


def brute(docs, items, size=13):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("null" if i is None else str(i))
    lengths = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[k:k + n]))
                if items_here:
                    hit.update(range(k, k + n))
                    found |= items_here
        out.append((repr(i), len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def run(docs, items, **more):
    return sorted((repr(r["doc"]), r["n_words"], r["n_hit"], tuple(r["items"])) for r in contamination(docs, items, **more).collect())


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("more", [{}, {"max_broadcast": 0}])
def test_equals_brute_force(spark, sf, more):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert run(docs, items, **more) == want and any(x[2] for x in want)


def test_short_items_ties_and_nulls(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "lazy, DOG"), (10, "lazy dog"), (2, "fox"), (None, "two three"), (3, None), (4, ""), (5, "...!"), (6, "wörds"),
         (7, "é É ß x Ünïcode"), (8, "brown fox jumps over the lazy dog again and again the quick brown fox"),
         (9, "word " * 20)], "item_id long, text string").withColumn("words", F.lit("clash")).withColumn("len", F.lit(1))
    assert run(odd, items) == brute(ODD_TEXTS, pairs(items, "item_id"))
    assert run(odd, items.where("false")) == brute(ODD_TEXTS, [])
    assert run(empty, items) == []


def test_words(spark):
    texts = ["A-b_c'd É1e\x7ff", "", None, " x", "ABC", "`{z}~", "日本 x\u2003y"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(word_list(F.col("text")).alias("w")).collect()
    assert [r["w"] for r in rows] == [words(t) for t in texts]


def test_threshold(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (1, 20), (1, 21), (13, 260)], "h long, n long")
    assert [r[0] for r in rows.select(is_contaminated(F.col("h"), F.col("n"))).collect()] == [False, False, True, False, True]


def test_spans_are_cut_out(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A, b; c d y a b"), (2, "nothing here"), (3, None), (1, "a b c"), (None, "z c d")],
                                 "doc_id long, text string")
    got = sorted((repr(r["doc"]), repr(r["text"])) for r in without_spans(docs, items).collect())
    assert got == sorted([("1", "'x  y a b'"), ("2", "'nothing here'"), ("3", "None"), ("1", "''"), ("None", "'z '")])
    lead = spark.createDataFrame([(1, "  a b c!a b c--d e")], "doc_id long, text string")
    assert [r["text"] for r in without_spans(lead, items).collect()] == ["   e"]


def test_shuffled_windows_travel_without_words(spark, odd):
    """No join of windows carries a text's words; results are the broadcast form's."""
    items = spark.createDataFrame(
        [(1, "lazy, DOG"), (None, "two three"), (5, "...!"), (7, "é É ß x Ünïcode"), (9, "word " * 20)], "item_id long, text string")
    judged = contamination(odd, items, max_broadcast=0)

    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    joins = [n for n in nodes(judged._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    sides = [{side.output().apply(i).name() for i in range(side.output().size())}
             for n in joins for side in (n.left(), n.right())]
    assert any("start" in names for names in sides) and not any({"start", "words"} <= names for names in sides)
    assert run(odd, items, max_broadcast=0) == brute(ODD_TEXTS, pairs(items, "item_id"))
    short = odd.where("doc_id IS NULL OR doc_id != 10")
    spans = [sorted(map(repr, without_spans(short, items, **more).collect())) for more in ({}, {"max_broadcast": 0})]
    assert spans[0] == spans[1]
