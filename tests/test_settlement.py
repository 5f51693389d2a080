"""Per-side aggregates reproduce the naive double left join exactly."""

import datetime as dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators.settlement import partial_residual, settled_at, settlement_deltas
from micro import SCHEMAS

DATE_TO = dt.date(2000, 1, 31)
amounts = st.one_of(st.none(), st.integers(-500, 500).map(lambda c: Decimal(c) / 4))
dates = st.sampled_from([dt.date(2000, 1, 1), dt.date(2000, 1, 31), dt.date(2000, 2, 1), None])
part = st.tuples(st.one_of(st.none(), st.integers(1, 4)), st.one_of(st.none(), st.integers(1, 4)),
                 amounts, dates)


def naive(spark, parts):
    p = spark.createDataFrame(parts, SCHEMAS["account_partial_reconcile"]) \
        .filter(F.col("max_date") <= F.lit(DATE_TO))
    lines = spark.range(1, 5).select(F.col("id"))
    d = p.select(F.col("debit_move_id").alias("d_id"), F.col("amount").alias("d_amt"))
    c = p.select(F.col("credit_move_id").alias("c_id"), F.col("amount").alias("c_amt"))
    j = (lines.join(d, lines.id == d.d_id, "left").join(c, lines.id == c.c_id, "left")
         .groupBy("id").agg(F.coalesce(F.sum("d_amt"), F.lit(0)).alias("d"),
                            F.coalesce(F.sum("c_amt"), F.lit(0)).alias("c"),
                            F.count("d_id").alias("nd"), F.count("c_id").alias("nc")))
    return {r.id: (r.d, r.c) for r in j.collect() if r.nd or r.nc}


@settings(max_examples=12, deadline=None)
@given(st.lists(part, max_size=12))
def test_fanout_rewrite(spark, parts):
    parts = [(a, b, c, d) for a, b, c, d in parts]
    got = {r.line_id: (r.debit_amount, r.credit_amount)
           for r in partial_residual(spark.createDataFrame(
               parts, SCHEMAS["account_partial_reconcile"]), DATE_TO).collect()}
    assert got == naive(spark, parts)


many_dates = st.sampled_from([dt.date(2000, m, d) for m in range(1, 13) for d in (1, 28)] + [None])
dated = st.tuples(st.one_of(st.none(), st.integers(1, 4)), st.one_of(st.none(), st.integers(1, 4)), amounts, many_dates)
MONTHS = [dt.date(2000, m, 28) for m in range(1, 13)]


@settings(max_examples=4, deadline=None)
@given(st.lists(dated, max_size=25))
def test_twelve_month_ends_equal_twelve_runs(spark, parts):
    p = spark.createDataFrame(parts, SCHEMAS["account_partial_reconcile"])
    got = {}
    for r in settled_at(settlement_deltas(p), [MONTHS[3], *MONTHS, "2000-02-28"]).collect():
        got.setdefault(r.as_of, set()).add(tuple(r)[1:])
    for day in MONTHS:
        assert got.get(day, set()) == {tuple(r) for r in partial_residual(p, day).collect()}


def test_decimals_of_the_partials(spark):
    """Amounts of three, and of decimal(38,18), keep their decimals through the fan-out."""
    rows = [(1, 2, Decimal("1.235"), DATE_TO), (1, 2, Decimal("0.001"), DATE_TO), (3, 1, Decimal("7"), DATE_TO)]
    for kind in ("decimal(18,3)", "decimal(38,18)"):
        p = spark.createDataFrame(rows, "debit_move_id long, credit_move_id long, amount decimal(18,3), max_date date")
        got = {r.line_id: (r.debit_amount, r.credit_amount) for r in partial_residual(
            p.withColumn("amount", F.col("amount").cast(kind)), DATE_TO).collect()}
        assert got == {1: (Decimal("1.236"), Decimal("14")), 2: (0, Decimal("1.236")), 3: (Decimal("7"), 0)}


def test_a_date_reads_the_days_up_to_it(spark):
    deltas = settlement_deltas(spark.createDataFrame([(1, None, Decimal(1), DATE_TO)] * 5, SCHEMAS["account_partial_reconcile"]))
    assert deltas.count() == 1 and settled_at(deltas, ["1999-12-31"]).count() == 0
    assert [r.debit_count for r in settled_at(deltas, [DATE_TO, "2001-01-01"]).orderBy("as_of").collect()] == [5, 5]
