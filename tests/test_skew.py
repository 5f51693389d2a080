"""A hot key (a third of all rows on one order, partner or customer) is split
by AQE, and the result is still whole."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import aged_lines, undelivered_by_order, undelivered_lines
from ledgerlens.sources.fixtures import ACCOUNT_ROWS, CURRENCY_ROWS, JOURNAL_ROWS
from micro import tables

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
}


@pytest.fixture
def skew_conf(spark):
    prev = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in prev.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_order_split_and_whole(spark, skew_conf):
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    n = 300000
    money = "decimal(18,2)"
    sol = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 5000 + 2).alias("order_id"),
        F.lit(100).cast("bigint").alias("product_id"), F.lit(1).alias("company_id"),
        F.lit(5).cast(money).alias("product_uom_qty"), F.lit(3).cast(money).alias("qty_delivered"),
        F.lit(10).cast(money).alias("price_unit"), F.lit(10).cast(money).alias("price_total"),
        F.lit(None).cast("timestamp_ntz").alias("create_date"),
        F.lit(None).cast("timestamp_ntz").alias("write_date"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("display_type"),
        F.lit(None).cast("int").alias("create_uid"), F.lit(None).cast("int").alias("write_uid"))
    so = spark.range(1, 5002).select(
        F.col("id"), F.concat(F.lit("SO"), F.col("id").cast("string")).alias("name"),
        F.lit(10).cast("bigint").alias("partner_id"), F.lit(0).alias("currency_id"),
        F.lit(None).cast("int").alias("analytic_account_id"),
        F.lit(None).cast("timestamp_ntz").alias("create_date"))
    base = tables(spark, res_partner=[{"id": 10, "name": "A", "display_name": "A"}],
                  res_currency=CURRENCY_ROWS,
                  res_currency_rate=[(1, 0, dt.date(1995, 1, 1), Decimal(1))],
                  product_product=[{"id": 100, "product_tmpl_id": 200}],
                  product_template=[{"id": 200, "name": "W"}])
    df = undelivered_by_order(undelivered_lines(base.with_tables(sale_order_line=sol,
                                                                 sale_order=so)))
    rows = {r.order_id: r for r in df.collect()}
    assert len(rows) == 5001
    assert rows[1].line_count == n // 3 and rows[1].quantity == 5 * (n // 3)
    assert sum(r.line_count for r in rows.values()) == n
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"AQEShuffleRead coalesced and skewed", plan)


def skewed_joins(df):
    """Keys of the joins that the executed plan splits."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"SortMergeJoin\(skew=true\) \[([a-z_]+)#", plan)


def test_hot_partner_split_and_whole(spark, skew_conf):
    n = 200000
    money = "decimal(18,2)"
    lines = spark.range(n).select(
        F.col("id"), (F.col("id") % 900 + 1).alias("move_id"),
        F.when(F.col("id") % 3 == 0, F.lit(10)).otherwise(F.col("id") % 4000 + 100).cast("bigint").alias("partner_id"),
        F.lit(0).alias("journal_id"), F.lit(0).alias("account_id"), F.lit(1).alias("company_id"),
        F.lit(None).cast("int").alias("currency_id"), F.lit(dt.date(2000, 1, 1)).alias("date"),
        F.lit(None).cast("date").alias("date_maturity"), F.lit(None).cast("date").alias("expected_pay_date"),
        F.lit(None).cast("bigint").alias("payment_id"), F.lit(10).cast(money).alias("balance"),
        F.lit(10).cast(money).alias("amount_currency"))
    moves = spark.range(1, 901).select(
        F.col("id"), F.concat(F.lit("INV"), F.col("id").cast("string")).alias("name"), F.lit("r").alias("ref"),
        F.lit("out").alias("move_type"), F.lit(1).cast(money).alias("amount_residual"), F.lit(0).alias("currency_id"),
        F.lit(None).cast("bigint").alias("x_studio_source_order"))
    partners = spark.range(0, 4200).select("id", F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"),
                                           F.lit("shown").alias("display_name"))
    trust = spark.range(0, 4200, 2).select(
        "id", F.lit("trust").alias("name"), F.concat(F.lit("res.partner,"), F.col("id").cast("string")).alias("res_id"),
        F.lit(1).alias("company_id"), F.lit("good").alias("value_text"))
    t = tables(spark, account_account=ACCOUNT_ROWS, account_journal=JOURNAL_ROWS,
               res_currency_rate=[(1, 0, dt.date(1995, 1, 1), Decimal(1))]).with_tables(
        account_move_line=lines, account_move=moves, res_partner=partners, ir_property=trust)
    df = aged_lines(t, "2000-01-31", "receivable", [(1, "1", 2)])
    rows = df.collect()
    assert len(rows) == n and sum(r.partner_id == 10 for r in rows) == len(range(0, n, 3))
    assert all(r.partner_trust == ("good" if r.partner_id % 2 == 0 else "normal") for r in rows)
    assert "partner_id" in skewed_joins(df)


def test_hot_customer_split_and_whole(spark, skew_conf):
    n = 200000
    money = "decimal(18,2)"
    orders = spark.range(n).select(
        F.col("id"), F.concat(F.lit("SO"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 3 == 0, F.lit(10)).otherwise(F.col("id") % 4000 + 100).cast("bigint").alias("partner_id"),
        F.lit(0).alias("currency_id"), F.lit(None).cast("int").alias("analytic_account_id"),
        F.lit(None).cast("timestamp_ntz").alias("create_date"))
    sol = spark.range(n).select(
        F.col("id"), F.col("id").alias("order_id"), F.lit(100).cast("bigint").alias("product_id"), F.lit(1).alias("company_id"),
        F.lit(5).cast(money).alias("product_uom_qty"), F.lit(3).cast(money).alias("qty_delivered"),
        F.lit(10).cast(money).alias("price_unit"), F.lit(10).cast(money).alias("price_total"),
        F.lit(None).cast("timestamp_ntz").alias("create_date"), F.lit(None).cast("timestamp_ntz").alias("write_date"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("display_type"),
        F.lit(None).cast("int").alias("create_uid"), F.lit(None).cast("int").alias("write_uid"))
    partners = spark.range(0, 4200).select("id", F.concat(F.lit("P"), F.col("id").cast("string")).alias("name"),
                                           F.lit("shown").alias("display_name"))
    t = tables(spark, res_currency=CURRENCY_ROWS, res_currency_rate=[(1, 0, dt.date(1995, 1, 1), Decimal(1))],
               product_product=[{"id": 100, "product_tmpl_id": 200}],
               product_template=[{"id": 200, "name": "W"}]).with_tables(
        sale_order=orders, sale_order_line=sol, res_partner=partners)
    df = undelivered_lines(t)
    rows = df.collect()
    assert len(rows) == n and sum(r.partner_id == 10 for r in rows) == len(range(0, n, 3))
    assert "partner_id" in skewed_joins(df)
