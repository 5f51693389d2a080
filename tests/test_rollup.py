"""Declared roll-ups: levels, ranges, split groups; against plain aggregations."""

import os

import pytest
from pyspark.sql import functions as F

import ledgerlens.operators.ranges as ranges
from harness import compare, duck
from ledgerlens.operators.paging import Pages
from ledgerlens.operators.ranges import CutPoint, SortKey, align, range_of, split_groups
from ledgerlens.operators.rollup import GroupLevel, Rollup, group_rows, hierarchy
from ledgerlens.oracle import ORACLE_SQL
from ledgerlens.plans import undelivered_lines, undelivered_report
from ledgerlens.queries import BY_COMPANY, QUERIES, portable
from ledgerlens.plans.spec import run_report
from ledgerlens.sources import fixture_tables

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

SPEC = Rollup(levels=(GroupLevel(("region",), ("region DESC NULLS LAST",)),
                      GroupLevel(("shop",), ("name ASC NULLS LAST", "shop"), ("name",))),
              operators={"paid": "sum", "best": "max", "low": "min", "note": "max", "seen": "count", "name": "max"},
              line_order=("day DESC", "id"))
SCHEMA = "id long, region string, shop long, name string, day date, paid decimal(10,2), best double, low int, note string, seen string"


def sales(spark, count=3000, hot=0.4):
    rows = spark.range(count).select(
        "id", F.when(F.col("id") < count * hot, "hot").when(F.col("id") % 17 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("r"), F.col("id") % 7)).alias("region"),
        F.when(F.col("id") < count * hot, 5).when(F.col("id") % 29 == 0, F.lit(None)).otherwise(F.col("id") % 60).alias("shop"))
    return rows.select(
        "id", "region", "shop", F.when(F.col("shop") % 9 > 0, F.concat(F.lit("n"), F.col("shop") % 9)).alias("name"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 100).cast("decimal(10,2)").alias("paid"), (F.col("id") % 97).cast("double").alias("best"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("int")).alias("low"), (F.col("id") % 31).cast("string").alias("note"),
        F.when(F.col("id") % 2 == 0, "x").alias("seen"))


def expected(lines):
    """All levels from plain aggregations, in order."""
    folds = [F.sum("paid").alias("paid"), F.max("best").alias("best"), F.min("low").alias("low"), F.max("note").alias("note"),
             F.count("seen").alias("seen")]
    null = F.lit(None)
    top = lines.groupBy("region").agg(*folds, F.max("name").alias("name")).select(F.lit(0).alias("level"), null.cast("long").alias("id"), "region",
                                                     null.cast("long").alias("shop"), "name",
                                                     null.cast("date").alias("day"), "paid", "best", "low", "note", "seen")
    low = lines.groupBy("region", "shop", "name").agg(*folds).select(
        F.lit(1).alias("level"), null.cast("long").alias("id"), "region", "shop", "name", null.cast("date").alias("day"),
        "paid", "best", "low", "note", "seen")
    own = lines.select(F.lit(2).alias("level"), "id", "region", "shop", "name", "day", "paid", "best", "low", "note",
                       F.col("seen").isNotNull().cast("long").alias("seen"))
    return [tuple(r) for r in top.union(low).union(own).orderBy(
        F.desc_nulls_last("region"), F.col("level") > 0, F.asc_nulls_last("name"), "shop", F.col("level") > 1,
        F.desc_nulls_last("day"), "id").collect()]


COLUMNS = ["id", "region", "shop", "name", "day", "paid", "best", "low", "note", "seen"]


@pytest.mark.parametrize("rows_a_range,hot", [(10**9, 0.4), (100, 0.4), (7, 1.0)])
def test_hierarchy_equals_plain_aggregations(spark, monkeypatch, rows_a_range, hot):
    """One range, many, and more than groups; a region and a shop with most
    rows are split over ranges."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", rows_a_range)
    lines = sales(spark, hot=hot)
    out = hierarchy(lines, SPEC, COLUMNS, ranges=12)
    got = [tuple(r) for r in out.collect()]
    assert got == expected(lines)
    if rows_a_range < 1000:
        parts = out.where("region = 'hot' AND shop = 5 AND level = 2").select(F.spark_partition_id()).distinct().count()
        assert parts > 3
    assert out.schema["paid"].dataType.simpleString() == "decimal(20,2)"


def test_empty_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 5)
    lines = sales(spark, 40)
    assert hierarchy(lines.where("false"), SPEC, COLUMNS).collect() == []
    twice = lines.union(lines)
    assert [tuple(r) for r in hierarchy(twice, SPEC, COLUMNS, ranges=8).collect()] == expected(twice)


def test_group_rows_of_each_level(spark):
    lines = sales(spark)
    want = expected(lines)
    for depth in (1, 2):
        assert group_rows(lines, SPEC, depth).count() == sum(1 for r in want if r[0] == depth - 1)
    one = group_rows(lines, SPEC, 1).where("region = 'hot'").first()
    assert tuple(one[c] for c in ("paid", "best", "low", "note", "seen")) == next(r[6:] for r in want if r[0] == 0 and r[2] == "hot")
    with pytest.raises(ValueError):
        Rollup((GroupLevel(("a",)),), {"b": "median"})


def test_bounds_lie_between_groups():
    cuts = align([("a", 1, 5), ("b", 1, 3), ("b", 1, 9), ("b", 2, 1), ("c", 1, 1)], (1, 2))
    assert [c.length for c in cuts] == [1, 1, 3, 2, 1]
    assert split_groups(cuts, 1) == {("b",): 2} and split_groups(cuts, 2) == {("b", 1): 2}


def test_range_of_rows(spark):
    keys = [SortKey.parse(k) for k in ("a DESC NULLS LAST", "b")]
    cuts = [CutPoint((5, 3), 1), CutPoint((5, 7), 2), CutPoint((None, 0), 1)]
    rows = spark.createDataFrame([(9, 1), (5, None), (5, 1), (5, 7), (5, 8), (4, 0), (None, None), (None, 4)], "a int, b int")
    assert [r[0] for r in rows.select(range_of(keys, cuts)).collect()] == [0, 1, 1, 2, 2, 2, 3, 3]


def test_range_of_rows_by_one_comparison(spark):
    """With the keys' types, one struct comparison a step finds the same ranges:
    nulls on either side, falling numbers, cut points of a group's start."""
    for order in (("a DESC NULLS LAST", "s", "b DESC NULLS FIRST"), ("a", "s ASC NULLS LAST", "b DESC"), ("s DESC", "a", "b")):
        keys = [SortKey.parse(k) for k in order]
        values = [(a, s, b) for a in (1, 5, None) for s in ("", "\u00e9", "z", None) for b in (-(2**63), 7, None)]
        rows = spark.createDataFrame(values, "a int, s string, b long")
        kinds = [rows.schema[k.expression].dataType for k in keys]
        ordered = [tuple(r[k.expression] for k in keys) for r in rows.orderBy(*[k.column for k in keys]).collect()]
        cuts = align(ordered[2::3], (1, 2))
        plain, typed = range_of(keys, cuts), range_of(keys, cuts, kinds)
        found = rows.select(plain.alias("plain"), typed.alias("typed")).collect()
        assert [r["typed"] for r in found] == [r["plain"] for r in found] and len({r["typed"] for r in found}) > 3


@needs_data
def test_three_declared_levels_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 300)
    r = compare(QUERIES["undelivered_by_company"](spark, SF), duck(SF), ORACLE_SQL["undelivered_by_company"])
    assert r["values_match"], r
    by_company = run_report(BY_COMPANY, fixture_tables(spark, SF), level="company_id")
    assert by_company.count() == 3 and "quantity" in by_company.columns


@needs_data
def test_report_reads_each_table_once(spark, monkeypatch):
    """No second run of the joins for the order rows, and no second sort by a range exchange."""
    report = undelivered_report(undelivered_lines(fixture_tables(spark, SF)))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") + plan.count("Relation [l_orderkey") == 1, plan
    physical = report._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in physical and physical.count("Window") == 1


@needs_data
def test_split_order_rows_equal_sql(spark, monkeypatch):
    """One order with a third of all lines is cut inside."""
    monkeypatch.setattr(ranges, "RANGE_ROWS", 1)
    hot = F.when(F.col("id") % 3 == 0, 7)
    lines = undelivered_lines(fixture_tables(spark, SF)).withColumns({
        "order_id": F.coalesce(hot, "order_id"), "order_no": F.when(hot.isNotNull(), "SO7").otherwise(F.col("order_no")),
        "partner_name": F.when(hot.isNotNull(), "P").otherwise(F.col("partner_name")),
        "english_name": F.when(hot.isNotNull(), "P").otherwise(F.col("english_name"))}).cache()
    from ledgerlens.plans.undelivered import REPORT_COLUMNS, UNDELIVERED_ROLLUP
    columns = [c for c in REPORT_COLUMNS if c not in ("level", "name")]
    out = hierarchy(lines, UNDELIVERED_ROLLUP, columns, ranges=60)
    want = sorted((r.order_id, r.partner_name, r.quantity) for r in group_rows(lines, UNDELIVERED_ROLLUP).collect())
    both = out.select("level", "order_id", "partner_name", "quantity", F.spark_partition_id().alias("part")).collect()
    lines.unpersist()
    assert sorted((r.order_id, r.partner_name, r.quantity) for r in both if r.level == 0) == want
    assert len({r.part for r in both if r.level == 1 and r.order_id == 7 and r.partner_name == "P"}) > 5


def test_pages_of_a_kept_list(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("g"))
    pages = Pages(df.repartition(7), ("g DESC NULLS FIRST", "k"))
    whole = [r.k for r in df.orderBy(F.desc_nulls_first("g"), "k").collect()]
    assert pages.rows == 1000 and [r.k for r in pages.page().collect()] == whole
    for offset, limit in ((0, 10), (250, 50), (990, 50), (1000, 5), (500, None), (5, 0)):
        page = pages.page(offset, limit, "p").collect()
        stop = len(whole) if limit is None else offset + limit
        assert [r.k for r in page] == whole[offset:stop] and [r.p for r in page] == list(range(offset, min(stop, 1000)))
    assert Pages(df.where("false"), ("id",)).page(position="p").collect() == []
