"""The range join at any number of periods."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import periods
from ledgerlens.operators.periods import period_join

DAY = dt.date(1995, 1, 1)
SCHEMA = "date_start date, date_stop date, period_index int"


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def both(spark, monkeypatch, rows, dates):
    lines = spark.createDataFrame([(i, day(n)) for i, n in enumerate(dates)], "id int, report_date date")
    table = spark.createDataFrame([(day(u), day(lo), i) for i, (u, lo) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(periods, "MAX_PERIODS", 0)
    large = period_join(lines, table)
    assert "NestedLoop" not in large._jdf.queryExecution().executedPlan().toString()
    assert large.columns == ["id", "report_date", "period_index"]
    return sorted((r.id, r.period_index) for r in large.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_range_join(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, rng.randrange(400)]), rng.choice([None, rng.randrange(400)])) for _ in range(150)]
    rows += [(None, None), (5, 5), (4, 6), (3, 9), (0, 400)]
    dates = [rng.choice([None, *range(-3, 405)]) for _ in range(200)] + [0, 5, 400, None]
    want = sorted((i, j) for i, d in enumerate(dates) for j, (u, lo) in enumerate(rows)
                  if (u is None or (d is not None and d <= u)) and (lo is None or (d is not None and d >= lo)))
    assert both(spark, monkeypatch, rows, dates) == want


def test_edges_of_the_calendar(spark, monkeypatch):
    monkeypatch.setattr(periods, "MAX_PERIODS", 0)
    lines = spark.sql("SELECT date'0001-01-01' AS report_date UNION ALL SELECT date'9999-12-31'")
    table = spark.sql("SELECT date'9999-12-31' AS date_start, date'0001-01-01' AS date_stop, 1 AS period_index "
                      "UNION ALL SELECT null, date'9999-12-31', 2 UNION ALL SELECT date'0001-01-01', null, 3")
    assert sorted((str(r.report_date), r.period_index) for r in period_join(lines, table).collect()) == [
        ("0001-01-01", 1), ("0001-01-01", 3), ("9999-12-31", 1), ("9999-12-31", 2)]
    assert period_join(lines, table.where("false")).count() == 0


def test_a_hundred_thousand_periods(spark):
    """More than one broadcast is made for; counts against plain arithmetic."""
    table = spark.range(100_000).select(
        F.date_add(F.lit(DAY), (F.col("id") % 3000 + F.col("id") % 20).cast("int")).alias("date_start"),
        F.date_add(F.lit(DAY), (F.col("id") % 3000).cast("int")).alias("date_stop"), F.col("id").cast("int").alias("period_index"))
    lines = spark.range(500).select("id", F.date_add(F.lit(DAY), (F.col("id") * 6).cast("int")).alias("report_date"))
    out = period_join(lines, table)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r["count"] for r in out.groupBy("id").count().collect()}
    spans = [(i % 3000, i % 3000 + i % 20) for i in range(100_000)]
    delta = [0] * 3100
    for lo, hi in spans:
        delta[lo] += 1
        delta[hi + 1] -= 1
    total, at = 0, {}
    for d, n in enumerate(delta):
        total += n
        at[d] = total
    assert got == {i: at[6 * i] for i in range(500) if at[6 * i]}
