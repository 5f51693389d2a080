"""Registered queries: one per operator / report of the inventory.

Every query reads the test-data tables of a scale-factor folder through the
fixture views (so its work grows with the data) and returns a DataFrame
whose columns match the SQL twin in :mod:`ledgerlens.oracle`.  The final
:func:`portable` step only changes representation for the cross-engine
comparison: decimals become doubles, dates and timestamps ISO text.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.money import round_by_precision, with_converted
from ledgerlens.operators.latest import latest_rate, latest_rate_named
from ledgerlens.operators.paging import Pages
from ledgerlens.operators.periods import period_join
from ledgerlens.operators.rollup import GroupLevel, Rollup
from ledgerlens.operators.settlement import partial_residual, settled_at, settlement_deltas
from ledgerlens.plans.aged import aged_by_partner, aged_lines, aged_report
from ledgerlens.plans.attachments import attachments_main, attachments_page, attachments_typed, attachments_where
from ledgerlens.plans.spec import ReportSpec, run_report
from ledgerlens.plans.undelivered import (
    undelivered_by_order, undelivered_lines, undelivered_report,
)
from ledgerlens.sources.fixtures import CURRENCY_TABLE_ROWS, FIXTURE_DATE_TO, fixture_tables
from ledgerlens.sources.inline import currency_table, period_rows, period_table

Query = Callable[[SparkSession, str], DataFrame]

ATTACHMENT_COLUMNS = ("id", "res_id", "mimetype", "create_date", "is_main")


def portable(df: DataFrame) -> DataFrame:
    """Decimals as double, dates / timestamps as ISO text (comparison only).

    Written as one ``selectExpr`` so the whole projection is a single call
    into the JVM.
    """
    exprs = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, T.DecimalType):
            exprs.append(f"CAST({name} AS DOUBLE) AS {name}")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            exprs.append(f"CAST({name} AS STRING) AS {name}")
        else:
            exprs.append(name)
    return df.selectExpr(*exprs)


def _tables(spark: SparkSession, sf_dir: str):
    return fixture_tables(spark, sf_dir)


def _ct(spark: SparkSession) -> list[tuple]:
    """The fixture's company currency table, as report parameter rows."""
    return list(CURRENCY_TABLE_ROWS)


def q_latest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rate of each document's currency (left: no rate -> null)."""
    t = _tables(spark, sf_dir)
    rates = latest_rate(t["res_currency_rate"]).select(
        F.col("currency_id").alias("r_currency_id"), F.col("rate").alias("currency_rate"))
    mv = t["account_move"]
    out = mv.join(F.broadcast(rates), mv.currency_id == rates.r_currency_id, "left").select(
        mv.id.alias("move_id"), mv.currency_id, "currency_rate")
    return portable(out)


def q_latest_rate_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest rate with currency name and symbol, per sale order."""
    t = _tables(spark, sf_dir)
    rates = latest_rate_named(t["res_currency_rate"], t["res_currency"]).withColumnRenamed(
        "currency_id", "r_currency_id")
    so = t["sale_order"]
    out = so.join(F.broadcast(rates), so.currency_id == rates.r_currency_id, "left").select(
        so.id.alias("order_id"), so.currency_id, "rate", "currency_name", "currency_symbol")
    return portable(out)


def q_latest_rate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest rate of each currency in a history with a row per order, half
    of them of one currency, with repeated and missing dates."""
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    history = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_custkey") % 50).alias("currency_id"),
        F.when(F.col("o_custkey") % 1000 == 7, None).otherwise(F.col("o_orderdate").cast("date")).alias("name"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("rate"))
    return portable(latest_rate(history))


def q_round_by_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-precision rounding of a signed eighth of each line's balance
    (ties on both signs at precisions 0, 2 and 3)."""
    t = _tables(spark, sf_dir)
    aml = t["account_move_line"]
    ct = currency_table(spark, CURRENCY_TABLE_ROWS).select("company_id", "precision")
    signed = F.when(F.col("id") % 2 == 0, F.col("balance")).otherwise(-F.col("balance"))
    value = (signed * F.lit(Decimal("0.125")).cast(T.DecimalType(18, 6))).cast(T.DecimalType(18, 6))
    out = (aml.join(F.broadcast(ct), "company_id")  # a row per company
           .select("id", "company_id", "precision", value.alias("value"))
           .withColumn("rounded", round_by_precision(F.col("value"), F.col("precision"))))
    return portable(out)


def q_period_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every journal line against the six ageing periods of the fixture date."""
    t = _tables(spark, sf_dir)
    aml = t["account_move_line"].select(
        "id", F.coalesce(F.col("date_maturity"), F.col("date")).alias("report_date"))
    out = period_join(aml, period_table(spark, FIXTURE_DATE_TO), "report_date",
                      known_rows=len(period_rows(FIXTURE_DATE_TO)))
    return portable(out.select("id", "report_date", "period_index"))


def q_period_join_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in each of as many overlapping periods as there are orders, some
    of them open at an end."""
    t = _tables(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    day, customer = F.col("o_orderdate").cast("date"), F.col("o_custkey")
    periods = o.select(
        F.when(customer % 97 != 0, F.date_add(day, (customer % 9).cast("int"))).alias("date_start"),
        F.when(customer % 89 != 0, F.date_sub(day, (customer % 4).cast("int"))).alias("date_stop"),
        F.col("o_orderkey").cast("int").alias("period_index"))
    due = (t["account_move_line"].groupBy(F.coalesce(F.col("date_maturity"), F.col("date")).alias("report_date"))
           .agg(F.count("*").alias("n")))
    found = period_join(due, periods, "report_date")
    return portable(found.groupBy("period_index").agg(
        F.sum("n").alias("lines"), F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date")))


def q_partial_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return portable(partial_residual(t["account_partial_reconcile"], FIXTURE_DATE_TO))


#: Month ends of a year, for settlements as of many dates.
MONTH_ENDS = tuple(dt.date(1997, m, 1) - dt.timedelta(days=1) for m in range(1, 13))


def q_settled_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlement of every line as of twelve month ends, in one run."""
    deltas = settlement_deltas(_tables(spark, sf_dir)["account_partial_reconcile"])
    return portable(settled_at(deltas, MONTH_ENDS))


def q_aged_receivable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return portable(aged_lines(t, FIXTURE_DATE_TO, "receivable", _ct(spark)))


def q_aged_payable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return portable(aged_lines(t, FIXTURE_DATE_TO, "payable", _ct(spark)))


def q_aged_by_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return portable(aged_by_partner(t, FIXTURE_DATE_TO, "receivable", _ct(spark)))


def q_aged_by_partner_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners by amount of the newest period, with their place."""
    return portable(aged_by_partner(_tables(spark, sf_dir), FIXTURE_DATE_TO, "receivable", _ct(spark),
                                    sort_by=("period0 DESC", "partner_id"), position="position"))


def q_aged_by_partner_by_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners by the computed column, their original currency amount."""
    return portable(aged_by_partner(_tables(spark, sf_dir), FIXTURE_DATE_TO, "receivable", _ct(spark),
                                    sort_by=("original_currency_amount DESC", "partner_id"), position="position"))


def q_aged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners, each followed by its open lines."""
    return portable(aged_report(_tables(spark, sf_dir), FIXTURE_DATE_TO, "receivable", _ct(spark)))


def _converted(spark: SparkSession, sf_dir: str, money: str, rate: Column, factor: Column) -> DataFrame:
    """Every line's price at a rate and a factor, at precisions 0 to 11: sign,
    whole part and twelve decimals of the exact result."""
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    key = ((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    rows = li.select(key.alias("id"), F.col("l_extendedprice").cast("decimal(18,2)").cast(money).alias("amount"),
                     (F.col("l_discount") * 1000).cast(money).alias("settled"), rate.alias("rate"), factor.alias("factor"),
                     F.col("l_quantity").cast("int").alias("quantity"),
                     (F.col("l_linenumber") + F.col("l_orderkey") % 6 - 1).cast("int").alias("precision"))
    thousandths = T.DecimalType(18, 3)
    if money != "decimal(18,2)":
        amount = (F.col("amount") + F.col("quantity") * F.lit(Decimal("0.001")).cast(thousandths)).cast(money)
        rows = rows.withColumn("amount", amount)
    out = with_converted(rows, "value", F.col("amount"), F.col("rate"), F.col("amount"), F.col("settled"),
                         F.col("factor"), F.col("precision"))
    size = F.abs("value").cast("decimal(33,12)")
    whole = F.floor(size)
    return out.select("id", "precision", F.signum("value").cast("int").alias("sign"), whole.cast("bigint").alias("whole"),
                      ((size - whole).cast("decimal(12,12)") * F.lit(10**12)).cast("bigint").alias("decimals"))


def q_aged_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts converted at rates without whole reciprocals, at precisions 0
    to 11; sign, whole part and twelve decimals of the exact result."""
    by_part, by_supplier = F.col("l_partkey") % 6, F.col("l_suppkey") % 4
    rate = (F.when(by_part == 0, Decimal("0.3")).when(by_part == 1, Decimal("0.7")).when(by_part == 2, Decimal("6.000001"))
            .when(by_part == 3, Decimal("0.000001")).when(by_part == 4, None).otherwise(0).cast("decimal(18,6)"))
    factor = (F.when(by_supplier == 0, 1).when(by_supplier == 1, Decimal("1500000.000001"))
              .when(by_supplier == 2, Decimal("0.333333")).otherwise(Decimal("-2.5")).cast("decimal(18,6)"))
    return _converted(spark, sf_dir, "decimal(18,2)", rate, factor)


def q_aged_converted_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with amounts of three decimals, rates of ten and factors of
    eight."""
    by_part, by_supplier = F.col("l_partkey") % 6, F.col("l_suppkey") % 4
    rate = (F.when(by_part == 0, Decimal("0.1234567")).when(by_part == 1, Decimal("7.0000000003"))
            .when(by_part == 2, Decimal("123.456789")).when(by_part == 3, Decimal("0.0000004")).when(by_part == 4, None)
            .otherwise(Decimal("-1")).cast("decimal(22,10)"))
    factor = (F.when(by_supplier == 0, 1).when(by_supplier == 1, Decimal("0.92345678"))
              .when(by_supplier == 2, Decimal("1234.5")).otherwise(Decimal("-2.5")).cast("decimal(20,8)"))
    return _converted(spark, sf_dir, "decimal(18,3)", rate, factor)


def q_undelivered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(undelivered_lines(_tables(spark, sf_dir)))


def q_undelivered_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies 1 and 3, customers of the BUILDING segment (semi join)."""
    customers = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet")
    wanted = customers.filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("id"))
    return portable(undelivered_lines(_tables(spark, sf_dir), company_ids=[1, 3],
                                      partner_ids=wanted))


def q_undelivered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line read twice; grouping by the keys leaves each once."""
    t = _tables(spark, sf_dir)
    twice = t["sale_order_line"].unionByName(t["sale_order_line"])
    lines = undelivered_lines(t.with_tables(sale_order_line=twice), dedupe=True)
    return lines.select("id", "order_id", "partner_id", "company_id")


def q_report_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared undelivered report of company 2, both levels, with the
    columns declared for it."""
    return portable(run_report("undelivered", _tables(spark, sf_dir), level="", company_ids=[2], sort=False))


#: A report of three levels, declared: companies, their customers, their orders.
BY_COMPANY = ReportSpec(
    name="undelivered_by_company",
    lines=undelivered_lines,
    columns=("company_id", "partner_id", "partner_name", "order_id", "order_no", "id", "quantity", "outstanding_quantity",
             "unit_price", "amount_currency", "product_code", "date"),
    domain=("company_ids", "partner_ids", "dedupe"),
    rollup=Rollup(
        levels=(GroupLevel(("company_id",), ("company_id DESC",)),
                GroupLevel(("partner_id",), ("partner_name ASC NULLS LAST", "partner_id"), ("partner_name",)),
                GroupLevel(("order_id",), ("order_no ASC NULLS LAST", "order_id"), ("order_no", "date"))),
        operators={"quantity": "sum", "outstanding_quantity": "count", "unit_price": "max", "amount_currency": "min",
                   "product_code": "max", "date": "max"}))


def q_undelivered_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three declared levels and the lines, with each row's place."""
    rows = run_report(BY_COMPANY, _tables(spark, sf_dir), level="")
    return portable(Pages(rows).page(position="position"))


def q_undelivered_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(undelivered_by_order(undelivered_lines(_tables(spark, sf_dir))))


def q_undelivered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(undelivered_report(undelivered_lines(_tables(spark, sf_dir))))


def q_undelivered_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every row of the two-level report."""
    rows = undelivered_report(undelivered_lines(_tables(spark, sf_dir)), position="position")
    return rows.select("level", "order_id", "id", "position")


def q_attachments_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of the default listing (offset 5, limit 10)."""
    a = _tables(spark, sf_dir)["ir_attachment"]
    return portable(attachments_page(a, columns=ATTACHMENT_COLUMNS, offset=5, limit=10))


def q_attachments_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default listing from its middle on, with each row's place."""
    a = _tables(spark, sf_dir)["ir_attachment"]
    return portable(attachments_page(a, columns=ATTACHMENT_COLUMNS, offset=a.count() // 2, position="position"))


def q_attachments_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter and an explicit order, from row 10 on."""
    a = _tables(spark, sf_dir)["ir_attachment"]
    where = (F.col("res_id") < 20) & ~F.coalesce(F.col("is_main"), F.lit(False))
    return portable(attachments_page(a, where, ATTACHMENT_COLUMNS, offset=10,
                                     order=("mimetype ASC NULLS LAST", "id"), position="position"))


def q_attachments_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of a search domain with every operator and null comparisons."""
    a = _tables(spark, sf_dir)["ir_attachment"]
    domain = ["|", "&", ("mimetype", "ilike", "PDF"), "!", ("res_id", "in", [1, 2, 3]),
              "&", "|", ("mimetype", "=", False), ("mimetype", "not ilike", "image/%g"),
              "!", "|", ("is_main", "=", True), ("id", "<", 100), ("res_id", "!=", 7), ("create_date", ">=", "2024-01-05")]
    return portable(attachments_where(a, domain).select(*ATTACHMENT_COLUMNS))


def q_undelivered_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of a search domain over the report's columns."""
    domain = [("company_id", "in", [1, 3]), "|", ("shipped_quantity", "=", False), "!", ("order_no", "not like", "SO%7"),
              ("partner_id", "=?", None), "|", ("outstanding_quantity", ">", 0), ("outstanding_quantity", "=", None)]
    return portable(undelivered_lines(_tables(spark, sf_dir), where=domain))


def q_attachments_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview lists, with each row's place."""
    a = _tables(spark, sf_dir)["ir_attachment"]
    out = attachments_typed(a, ("res_id",), position="position")
    return portable(out.select(*ATTACHMENT_COLUMNS, "type", "position"))


def q_attachments_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _tables(spark, sf_dir)["ir_attachment"]
    return portable(attachments_main(a, ("res_id",)))


QUERIES: dict[str, Query] = {
    "latest_rate": q_latest_rate,
    "latest_rate_named": q_latest_rate_named,
    "latest_rate_history": q_latest_rate_history,
    "round_by_precision": q_round_by_precision,
    "period_join": q_period_join,
    "period_join_many": q_period_join_many,
    "partial_residual": q_partial_residual,
    "settled_at": q_settled_at,
    "aged_receivable_lines": q_aged_receivable_lines,
    "aged_payable_lines": q_aged_payable_lines,
    "aged_by_partner": q_aged_by_partner,
    "aged_by_partner_sorted": q_aged_by_partner_sorted,
    "aged_by_partner_by_amount": q_aged_by_partner_by_amount,
    "aged_report": q_aged_report,
    "aged_converted": q_aged_converted,
    "aged_converted_fine": q_aged_converted_fine,
    "undelivered_lines": q_undelivered_lines,
    "undelivered_filtered": q_undelivered_filtered,
    "undelivered_by_order": q_undelivered_by_order,
    "undelivered_by_company": q_undelivered_by_company,
    "undelivered_report": q_undelivered_report,
    "undelivered_report_order": q_undelivered_report_order,
    "undelivered_dedupe": q_undelivered_dedupe,
    "report_by_name": q_report_by_name,
    "attachments_page": q_attachments_page,
    "attachments_offset": q_attachments_offset,
    "attachments_where": q_attachments_where,
    "attachments_domain": q_attachments_domain,
    "undelivered_domain": q_undelivered_domain,
    "attachments_typed": q_attachments_typed,
    "attachments_main": q_attachments_main,
}

__all__ = ["QUERIES", "portable"]
