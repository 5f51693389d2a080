"""ERP-shaped tables derived from the TPC-H-like test data.

The mapping is the one documented in ``FIXTURES.md``: every large ERP table
is a projection of a test-data table (lineitem, orders, customer, part,
documents), so the reports' work grows with the scale factor.  Only the
genuinely small master data (journals, accounts, currencies and their rates)
is written inline, as fixed rows chosen to reach every branch of the
reports.

All tables are lazy DataFrames; reading them costs nothing until a report
runs, and Catalyst prunes the columns a report does not use.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.tables import LazyTables

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(18, 6)

# Fixed values of the fixture (FIXTURES.md), kept together.
# account_journal: (id, currency_id)
JOURNAL_ROWS = [(0, 0), (1, 1), (2, None), (3, 2)]
# account_account: (id, code, name, internal_type, exclude_from_aged_reports)
ACCOUNT_ROWS = [
    (0, "1100", "Trade debtors", "receivable", False),
    (1, "1110", "Other debtors", "receivable", None),
    (2, "1190", "Excluded debtors", "receivable", True),
    (3, "2100", "Trade creditors", "payable", False),
    (4, "2110", None, "payable", False),
    (5, "4000", "Sales", "other", False),
]
# res_currency: (id, name, symbol); currency 7 deliberately has no row.
CURRENCY_ROWS = [
    (0, "HKD", "$"), (1, "USD", "US$"), (2, "CNY", "CN¥"), (3, "EUR", "€"),
    (4, "JPY", "JP¥"), (5, "GBP", "£"), (6, "ZRO", "z"),
]
# res_currency_rate: (id, currency_id, name (date), rate)
RATE_ROWS = [
    (1, 0, "1995-01-01", "1"),
    (2, 1, "1996-01-01", "0.5"),
    (3, 1, "2001-01-01", "0.25"),
    (4, 2, "1999-01-01", "0.2"),
    (5, 3, "2001-01-01", "0.1"),
    (6, 3, None, "0.125"),
    (7, 4, "2000-01-01", "0.1"),
    (8, 4, "2000-01-01", "0.2"),
    (9, 5, "1998-01-01", "0.5"),
    (10, 5, "2000-01-01", None),
    (11, 6, "2000-01-01", "0"),
]
# Company currency table used by the ageing fixture: (company_id, rate, precision)
CURRENCY_TABLE_ROWS = [(1, "1", 2), (2, "2", 0), (3, "1", 3)]
# Report date of the fixture runs.
FIXTURE_DATE_TO = dt.date(1999, 12, 31)

JOURNAL_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("currency_id", T.IntegerType(), True),
])
ACCOUNT_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("code", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("internal_type", T.StringType(), True),
    T.StructField("exclude_from_aged_reports", T.BooleanType(), True),
])
CURRENCY_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("symbol", T.StringType(), True),
])
RATE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("currency_id", T.IntegerType(), True),
    T.StructField("name", T.DateType(), True),
    T.StructField("rate", RATE, True),
])


def line_key(orderkey: Column, partkey: Column, suppkey: Column, linenumber: Column) -> Column:
    """Unique id of a lineitem row (``(l_orderkey, l_linenumber)`` is not)."""
    return ((orderkey * F.lit(1000000) + partkey) * F.lit(10000) + suppkey) * F.lit(10) \
        + linenumber.cast("bigint")


def _lineitem_key(li: DataFrame) -> Column:
    return line_key(li.l_orderkey, li.l_partkey, li.l_suppkey, li.l_linenumber)


def _company(orderkey: Column) -> Column:
    return (orderkey % 3 + 1).cast("int")


_BUILT: dict[tuple[str, int, str], LazyTables] = {}


def fixture_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    """All ERP tables of the fixture over ``sf_dir`` (lazy).

    The table set is built once per session and folder, like a catalog: the
    DataFrames (plans, not data) are reused by every report, so the parquet
    footers are listed and read once.
    """
    root = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, id(spark), root)
    if key not in _BUILT:
        _BUILT[key] = _fixture_tables(spark, root)
    return _BUILT[key]


def _fixture_tables(spark: SparkSession, root: str) -> LazyTables:

    def raw(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}.parquet")

    def account_move_line() -> DataFrame:
        li = raw("lineitem")
        o = raw("orders")
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        return j.select(
            _lineitem_key(li).alias("id"),
            li.l_orderkey.alias("move_id"),
            F.when(o.o_custkey % 11 == 0, F.lit(None)).otherwise(o.o_custkey)
             .cast("bigint").alias("partner_id"),
            (li.l_suppkey % 4).cast("int").alias("journal_id"),
            (li.l_partkey % 6).cast("int").alias("account_id"),
            _company(li.l_orderkey).alias("company_id"),
            F.when(li.l_linenumber == 1, F.lit(None)).otherwise((o.o_custkey % 8).cast("int"))
             .cast("int").alias("currency_id"),
            o.o_orderdate.cast("date").alias("date"),
            F.when(li.l_linenumber % 3 == 0, F.lit(None)).otherwise(li.l_shipdate.cast("date"))
             .cast("date").alias("date_maturity"),
            F.lit(None).cast("date").alias("expected_pay_date"),
            F.lit(None).cast("bigint").alias("payment_id"),
            li.l_extendedprice.cast(MONEY).alias("balance"),
            (li.l_extendedprice * 2).cast(MONEY).alias("amount_currency"),
        )

    def account_move() -> DataFrame:
        o = raw("orders")
        return o.select(
            o.o_orderkey.alias("id"),
            F.concat(F.lit("INV/"), o.o_orderkey.cast("string")).alias("name"),
            o.o_orderpriority.alias("ref"),
            F.when(o.o_orderstatus == "P", F.lit("out_refund")).otherwise(F.lit("out_invoice"))
             .alias("move_type"),
            o.o_totalprice.cast(MONEY).alias("amount_residual"),
            (o.o_custkey % 8).cast("int").alias("currency_id"),
            F.when(o.o_orderkey % 4 == 0, F.lit(None)).otherwise(o.o_orderkey)
             .cast("bigint").alias("x_studio_source_order"),
        )

    def account_partial_reconcile() -> DataFrame:
        li = raw("lineitem").filter(F.col("l_returnflag") == "R")
        key = _lineitem_key(li)
        when_date = li.l_shipdate.cast("date")
        full = F.when((li.l_linestatus == "F") & (li.l_linenumber % 2 == 1),
                      li.l_extendedprice).otherwise(F.lit(10.0))
        # One row per (line, part): part 0 always, part 1 for line 2, part 2
        # for even line numbers.  Written as one scan plus a generator.
        parts = F.inline(F.array(
            F.struct(key.alias("debit_move_id"), F.lit(None).cast("bigint").alias("credit_move_id"),
                     full.cast(MONEY).alias("amount"), F.lit(True).alias("keep")),
            F.struct(key.alias("debit_move_id"), F.lit(None).cast("bigint").alias("credit_move_id"),
                     F.lit(3).cast(MONEY).alias("amount"), (li.l_linenumber == 2).alias("keep")),
            F.struct(F.lit(None).cast("bigint").alias("debit_move_id"), key.alias("credit_move_id"),
                     F.lit(5).cast(MONEY).alias("amount"), (li.l_linenumber % 2 == 0).alias("keep")),
        ))
        return (li.select(parts, when_date.alias("max_date"))
                .filter(F.col("keep"))
                .drop("keep"))

    def res_partner() -> DataFrame:
        c = raw("customer")
        return c.select(
            c.c_custkey.alias("id"),
            c.c_name.alias("name"),
            F.concat(c.c_mktsegment, F.lit(" "), c.c_name).alias("display_name"),
        )

    def ir_property() -> DataFrame:
        c = raw("customer").filter(F.col("c_custkey") % 5 == 0)
        return c.select(
            c.c_custkey.alias("id"),
            F.lit("trust").alias("name"),
            F.concat(F.lit("res.partner,"), c.c_custkey.cast("string")).alias("res_id"),
            (c.c_custkey % 3 + 1).cast("int").alias("company_id"),
            F.when(c.c_acctbal < 0, F.lit("bad")).otherwise(F.lit("good")).alias("value_text"),
        )

    def sale_order() -> DataFrame:
        o = raw("orders")
        return o.select(
            o.o_orderkey.alias("id"),
            F.when(o.o_orderkey % 97 == 0, F.lit(None))
             .otherwise(F.concat(F.lit("SO"), F.lpad(o.o_orderkey.cast("string"), 9, "0")))
             .alias("name"),
            o.o_custkey.alias("partner_id"),
            (o.o_custkey % 8).cast("int").alias("currency_id"),
            F.lit(None).cast("int").alias("analytic_account_id"),
            o.o_orderdate.alias("create_date"),
        )

    def sale_order_line() -> DataFrame:
        li = raw("lineitem")
        qty = li.l_quantity.cast(MONEY)
        shipped = (F.when(li.l_linestatus == "F", qty)
                   .when(li.l_returnflag == "N", F.lit(None))
                   .when(li.l_returnflag == "A", F.lit(0).cast(MONEY))
                   .otherwise(qty + F.lit(1)))
        ship_ts = li.l_shipdate
        return li.select(
            _lineitem_key(li).alias("id"),
            li.l_orderkey.alias("order_id"),
            F.when((li.l_linenumber == 7) & (li.l_partkey % 10 == 0), F.lit(None))
             .otherwise(li.l_partkey).cast("bigint").alias("product_id"),
            _company(li.l_orderkey).alias("company_id"),
            qty.alias("product_uom_qty"),
            shipped.cast(MONEY).alias("qty_delivered"),
            li.l_extendedprice.cast(MONEY).alias("price_unit"),
            li.l_extendedprice.cast(MONEY).alias("price_total"),
            ship_ts.alias("create_date"),
            ship_ts.alias("write_date"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("display_type"),
            F.lit(None).cast("int").alias("create_uid"),
            F.lit(None).cast("int").alias("write_uid"),
        )

    def product_product() -> DataFrame:
        p = raw("part")
        return p.select(p.p_partkey.alias("id"), p.p_partkey.alias("product_tmpl_id"))

    def product_template() -> DataFrame:
        p = raw("part")
        return p.select(p.p_partkey.alias("id"), p.p_name.alias("name"))

    def ir_attachment() -> DataFrame:
        d = raw("documents")
        kind = d.doc_id % 5
        return d.select(
            d.doc_id.alias("id"),
            (d.doc_id % 41).cast("int").alias("res_id"),
            F.when(kind == 0, F.lit("application/pdf"))
             .when(kind == 1, F.lit("image/png"))
             .when(kind == 2, F.lit("text/plain"))
             .when(kind == 3, F.lit(None))
             .otherwise(F.lit("image/jpeg")).alias("mimetype"),
            F.date_add(F.lit(dt.date(2024, 1, 1)), (d.doc_id % 37).cast("int")).alias("create_date"),
            (d.doc_id % 211 == 0).alias("is_main"),
        )

    def account_journal() -> DataFrame:
        return spark.createDataFrame(JOURNAL_ROWS, JOURNAL_SCHEMA)

    def account_account() -> DataFrame:
        return spark.createDataFrame(ACCOUNT_ROWS, ACCOUNT_SCHEMA)

    def res_currency() -> DataFrame:
        return spark.createDataFrame(CURRENCY_ROWS, CURRENCY_SCHEMA)

    def res_currency_rate() -> DataFrame:
        rows = [(i, c, None if d is None else dt.date.fromisoformat(d),
                 None if r is None else Decimal(r)) for i, c, d, r in RATE_ROWS]
        return spark.createDataFrame(rows, RATE_SCHEMA)

    return LazyTables({
        "account_move_line": account_move_line,
        "account_move": account_move,
        "account_partial_reconcile": account_partial_reconcile,
        "account_journal": account_journal,
        "account_account": account_account,
        "res_partner": res_partner,
        "ir_property": ir_property,
        "res_currency": res_currency,
        "res_currency_rate": res_currency_rate,
        "sale_order": sale_order,
        "sale_order_line": sale_order_line,
        "product_product": product_product,
        "product_template": product_template,
        "ir_attachment": ir_attachment,
    })
