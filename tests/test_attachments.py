"""Attachment listing, typing and main choice."""

import datetime as dt
import functools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.text import classify_mime
from ledgerlens.operators.paging import SortKey, ordered_slice, sort_columns
from ledgerlens.plans.attachments import attachments_main, attachments_page, attachments_typed
from micro import day, tables

ROWS = [
    (1, 1, "application/pdf", day("2024-01-01"), False),
    (2, 1, "image/png", day("2024-01-03"), False),
    (3, 1, None, day("2024-01-04"), False),
    (4, 1, "text/plain", day("2024-01-05"), False),
    (5, 1, "image/x-pdf", day("2024-01-02"), None),
    (6, 2, "application/pdf", None, True),
    (7, 2, "image/jpeg", day("2024-01-02"), False),
    (8, 2, "image/gif", day("2024-01-02"), True),
]


RECORD = ("res_id",)


def att(spark):
    return tables(spark, ir_attachment=ROWS)["ir_attachment"]


def test_classify_leftmost_match(spark):
    df = spark.createDataFrame([("image/x-pdf",), ("application/pdf",), ("text/plain",)], "m string")
    assert [r.t for r in df.select(classify_mime(F.col("m")).alias("t")).collect()] == \
        ["image", "pdf", ""]


def test_typed_order(spark):
    a = att(spark)
    asc = [(r.res_id, r.id, r.type) for r in attachments_typed(a, RECORD).collect()]
    assert asc == [(1, 1, "pdf"), (1, 5, "image"), (1, 2, "image"),
                   (2, 7, "image"), (2, 8, "image"), (2, 6, "pdf")]  # null date last
    desc = [r.id for r in attachments_typed(a, RECORD, order="desc").collect()]
    assert desc == [2, 5, 1, 6, 8, 7]                                  # null date first


def test_main_choice(spark):
    a = att(spark)
    got = {r.res_id: r for r in attachments_main(a, RECORD).collect()}
    assert got[1].id == 1 and got[1].newly_chosen                  # none flagged: first
    assert got[2].id == 8 and not got[2].newly_chosen              # first flagged in list order
    got_desc = {r.res_id: r.id for r in attachments_main(a, RECORD, order="desc").collect()}
    assert got_desc == {1: 2, 2: 6}
    only_pdf = {r.res_id: r.id for r in attachments_main(a, RECORD, types=("pdf",)).collect()}
    assert only_pdf == {1: 1, 2: 6}


def test_page_default_order(spark):
    a = att(spark)
    ids = [r.id for r in attachments_page(a, offset=1, limit=3).collect()]
    assert ids == [4, 3, 2]  # after 6 (null date first), create_date desc, id desc
    assert [r.id for r in attachments_page(a, where=F.col("res_id") == 2,
                                           columns=["id"]).collect()] == [6, 8, 7]
    explicit = [r.id for r in attachments_page(a, order=["id"], limit=2).collect()]
    assert explicit == [1, 2]


def test_records_of_two_models_with_one_id(spark):
    a = att(spark).withColumn("res_model", F.when(F.col("id") % 2 == 0, "x").otherwise("y")).withColumn("res_id", F.lit(1))
    got = {(r.res_model, r.res_id): r.id for r in attachments_main(a, ("res_model", "res_id")).collect()}
    assert got == {("x", 1): 8, ("y", 1): 1}


def place_of(rows, keys):
    """Rows sorted in Python by sort keys over (value or None) tuples."""
    def compare(a, b):
        for i, k in enumerate(keys):
            x, y = a[i], b[i]
            if x == y:
                continue
            if x is None or y is None:
                return -1 if (x is None) == k.nulls_first else 1
            return (-1 if x < y else 1) * (-1 if k.descending else 1)
        return 0
    return sorted(rows, key=functools.cmp_to_key(compare))


@pytest.mark.parametrize("order", [("g DESC", "s ASC NULLS LAST", "id"), ("s DESC NULLS FIRST", "id DESC"),
                                   ("d", "id"), ("g + 1 desc nulls first", "id asc")])
def test_positions_of_every_kind_of_key(spark, order):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "", "a", "B", "é"]),
             rnd.choice([None, dt.date(2024, 1, 1), dt.date(2023, 5, 5)]), i, "x" * (i % 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g int, s string, d date, id int, other string").repartition(5)
    keys = [SortKey.parse(k) for k in order]
    at = {"g": 0, "s": 1, "d": 2, "id": 3, "g + 1": 0}
    want = [r[-1] for r in place_of([(*[r[at[k.expression]] for k in keys], r[3]) for r in rows], keys)]
    got = ordered_slice(df, order, position="p").collect()
    assert [r.id for r in got] == want and [r.p for r in got] == list(range(700))
    assert [r.id for r in df.orderBy(*sort_columns(order)).collect()] == want
    for offset, limit in [(0, 3), (350, None), (690, 50), (700, 5), (99, 1), (1, 698), (10, 0)]:
        stop = None if limit is None else offset + limit
        for heap in (0, 100_000):
            assert [r.id for r in ordered_slice(df, order, offset, limit, heap_rows=heap).collect()] == want[offset:stop]
    assert ordered_slice(df.where("false"), order, 1).collect() == []


@pytest.mark.parametrize("partitions", [8, 200])
def test_deep_offsets_of_a_million_rows(spark, partitions):
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.date_add(
        F.lit(dt.date(2024, 1, 1)), (F.col("id") * 7919 % n % 37).cast("int")).alias("create_date"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("other"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        whole = sorted(range(n), key=lambda i: (-(i % 37), -i))
        for offset in (n // 4, n // 2, 3 * n // 4):
            assert [r.id for r in attachments_page(df, offset=offset, limit=1000).collect()] == whole[offset:offset + 1000]
            assert attachments_page(df, offset=offset).count() == n - offset
        tail = attachments_page(df, offset=3 * n // 4).select("id").toPandas()["id"].tolist()
        assert tail == whole[3 * n // 4:]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
