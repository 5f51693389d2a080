"""Undelivered sale-order lines.

Every sale order line that has a product, with ordered, shipped and
outstanding quantity, its amount converted at the latest rate of the order
currency, and the customer's names.  Delivered and over-delivered lines are
listed too (there is no outstanding > 0 test).

Tables join without hints, one form at every size: Catalyst and AQE broadcast
what is small by its statistics or its real size.  Customers join the order
headers, trust rows the lines; each shuffled join has an exchange of its own
on both sides, so AQE splits a hot order, customer or product.  The roll-up to
orders is declared (``UNDELIVERED_ROLLUP``); alone it sums narrow rows on the
map side, and the two-level report deals the lines into ranges of its order once
and emits the order rows there.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.domain import Domain, domain_filter
from ledgerlens.functions.money import WORK, converted_amount
from ledgerlens.functions.text import blank_zero, order_label
from ledgerlens.operators.latest import latest_rate_named
from ledgerlens.operators.paging import Pages
from ledgerlens.operators.rollup import GroupLevel, Rollup, group_rows, hierarchy
from ledgerlens.operators.trust import join_trust

# Fixed fallback currency shown when an order's currency has no usable rate.
FALLBACK_CURRENCY_NAME = "HKD"
FALLBACK_CURRENCY_SYMBOL = "$"

# Output columns of undelivered_lines, in the report query's order.
LINE_COLUMNS = (
    "move_id", "name", "account_id", "journal_id", "company_id", "currency_id",
    "analytic_account_id", "display_type", "date", "debit", "credit", "balance",
    "analytic_tag_ids", "create_date", "write_date", "write_uid", "create_uid",
    "id", "order_id", "product_id", "quantity", "shipped_quantity", "unit_price",
    "amount_currency", "amount", "outstanding_quantity", "product_code", "order_no",
    "currency_name", "currency_symbol", "currency_rate", "partner_id", "partner_name",
    "english_name",
)


def undelivered_lines(tables: Mapping[str, DataFrame],
                      company_ids: Iterable[int] | None = None,
                      partner_ids: Iterable[int] | DataFrame | None = None,
                      dedupe: bool = False, where: Domain | None = None) -> DataFrame:
    """Sale order lines with quantities, converted amount and customer.

    ``company_ids`` / ``partner_ids`` restrict the report (the report's
    domain); a partner DataFrame (column ``id``) is applied as a semi join,
    for lists too long to inline.  ``where`` is a search domain over the
    report's columns (a list in prefix notation,
    :mod:`ledgerlens.functions.domain`); Catalyst moves its parts to the tables
    they are about.

    The source query groups by the line's primary key and the joined ids
    without aggregating; with primary keys unique (which that query itself
    requires) the grouping cannot merge rows, so it is skipped.  ``dedupe``
    restores it as a ``dropDuplicates`` for data without enforced keys.
    """
    sol = tables["sale_order_line"]
    if company_ids is not None:
        sol = sol.filter(F.col("company_id").isin(list(company_ids)))

    orders = tables["sale_order"].select(
        F.col("id").alias("__so_id"), F.col("name").alias("order_no"),
        F.col("partner_id").alias("partner_id"), F.col("currency_id").alias("__so_currency_id"),
        F.col("analytic_account_id").alias("__so_analytic_account_id"),
        F.col("create_date").alias("__so_create_date"))
    partners = tables["res_partner"].select(
        F.col("id").alias("__p_id"), F.col("name").alias("partner_name"),
        F.col("display_name").alias("english_name"))
    rates = latest_rate_named(tables["res_currency_rate"], tables["res_currency"]).select(
        F.col("currency_id").alias("__rate_currency_id"), F.col("rate").alias("__rate"),
        F.col("currency_name").alias("__rate_name"), F.col("currency_symbol").alias("__rate_symbol"))
    products = (tables["product_product"].select(F.col("id").alias("__prod_id"),
                                                 F.col("product_tmpl_id").alias("__tmpl_ref"))
                .join(tables["product_template"].select(F.col("id").alias("__tmpl_id"),
                                                        F.col("name").alias("product_code")),
                      F.col("__tmpl_ref") == F.col("__tmpl_id"))
                .select("__prod_id", "product_code"))
    if isinstance(partner_ids, DataFrame):
        wanted = partner_ids.select(F.col("id").alias("__pf_id"))
        orders = orders.join(wanted, F.col("partner_id") == F.col("__pf_id"), "left_semi")
    elif partner_ids is not None:
        orders = orders.filter(F.col("partner_id").isin(list(partner_ids)))
    order_info = (orders
                  .join(partners, F.col("partner_id") == F.col("__p_id"))
                  .join(rates, F.col("__so_currency_id") == F.col("__rate_currency_id"), "left")
                  .drop("__p_id", "__rate_currency_id"))

    lines = (sol
             .join(products, F.col("product_id") == F.col("__prod_id"))
             .join(order_info, F.col("order_id") == F.col("__so_id")))
    lines = join_trust(lines, tables["ir_property"])
    if dedupe:
        lines = lines.dropDuplicates(["id", "__so_id", "partner_id", "__trust_id"])

    rate = F.col("__rate")
    usable = rate > 0
    one = F.lit(1)
    cols: dict[str, Column] = {
        "move_id": F.col("__so_id"),
        "name": F.col("name"),
        "account_id": one,
        "journal_id": one,
        "company_id": F.col("company_id"),
        "currency_id": F.col("__so_currency_id"),
        "analytic_account_id": F.col("__so_analytic_account_id"),
        "display_type": F.col("display_type"),
        "date": F.col("__so_create_date"),
        "debit": F.lit(0),
        "credit": F.lit(0),
        "balance": F.lit(0),
        "analytic_tag_ids": one,
        "create_date": F.col("create_date"),
        "write_date": F.col("write_date"),
        "write_uid": F.col("write_uid"),
        "create_uid": F.col("create_uid"),
        "id": F.col("id"),
        "order_id": F.col("order_id"),
        "product_id": F.col("product_id"),
        "quantity": F.col("product_uom_qty"),
        "shipped_quantity": F.col("qty_delivered"),
        "unit_price": F.col("price_unit"),
        "amount_currency": F.col("price_total"),
        "amount": converted_amount(F.col("price_total"), rate, F.col("price_total")).cast(WORK),
        "outstanding_quantity": F.col("product_uom_qty") - F.col("qty_delivered"),
        "product_code": F.col("product_code"),
        "order_no": F.col("order_no"),
        "currency_name": F.when(usable, F.col("__rate_name"))
                          .otherwise(F.lit(FALLBACK_CURRENCY_NAME)),
        "currency_symbol": F.when(usable, F.col("__rate_symbol"))
                            .otherwise(F.lit(FALLBACK_CURRENCY_SYMBOL)),
        "currency_rate": F.when(usable, rate).otherwise(one),
        "partner_id": F.col("partner_id"),
        "partner_name": F.col("partner_name"),
        "english_name": F.col("english_name"),
    }
    out = lines.select(*[cols[c].alias(c) for c in LINE_COLUMNS])
    return out if where is None else out.filter(domain_filter(out, where))


# How lines fold into orders: the operators that the report declares for its
# columns (text without an operator is empty in an order row).  Order number and
# customer names come from the order header, so an order has each of them once.
UNDELIVERED_ROLLUP = Rollup(
    levels=(GroupLevel(("order_id",), ("order_no ASC NULLS LAST", "order_id"), ("order_no", "partner_name", "english_name")),),
    operators={"order_no": "max", "partner_name": "max", "english_name": "max",
               "quantity": "sum", "shipped_quantity": "sum", "outstanding_quantity": "sum", "unit_price": "sum",
               "amount_currency": "sum", "amount": "sum", "currency_rate": "sum", "line_count": "rows"},
    line_order=("id ASC NULLS FIRST",))


def undelivered_by_order(lines: DataFrame) -> DataFrame:
    """One row per order, by :data:`UNDELIVERED_ROLLUP`: order number and
    customer names, sums of the numeric columns (including the rate, which has
    no operator of its own) and the number of lines."""
    return group_rows(lines, UNDELIVERED_ROLLUP)


# Columns of the two-level report, in display order.
REPORT_COLUMNS = ("level", "order_id", "id", "order_no", "name", "partner_name", "english_name",
                  "product_code", "quantity", "shipped_quantity", "outstanding_quantity",
                  "currency_name", "unit_price", "amount_currency", "amount")


def undelivered_report(lines: DataFrame, sort: bool = True, position: str | None = None) -> DataFrame:
    """Two-level report: an order row (``level`` 0) followed by its line rows
    (``level`` 1); no grand total.

    Order row: label = first 128 characters of the order number, or
    ``'Unknown Order'``; names are the group ``max``, numbers the group sum;
    product and currency (no operator) are empty.
    Line row: label = the full order number; every number equal to 0 shows
    empty; the last column (``amount``) is always empty, so the amount shows
    on order rows only.

    Both levels come from one run of the lines (:func:`hierarchy`), copies
    included (one per trust row of the customer).  Sorted by order number
    (nulls last), order, level, line; ``position`` names a column with each
    row's place in that order, from 0.
    """
    shown = ("quantity", "shipped_quantity", "outstanding_quantity", "unit_price", "amount_currency")
    both = hierarchy(lines, UNDELIVERED_ROLLUP, [c for c in REPORT_COLUMNS if c not in ("level", "name")],
                     sort=sort or position is not None)
    order_row = F.col("level") == 0
    cells: dict[str, Column] = {
        "name": F.when(order_row, order_label(F.col("order_no"))).otherwise(F.col("order_no")),
        **{c: F.when(order_row, F.col(c)).otherwise(blank_zero(F.col(c))) for c in shown},
        "amount": F.when(order_row, F.col("amount")).cast(WORK),
    }
    out = both.select(*[cells.get(c, F.col(c)).alias(c) for c in REPORT_COLUMNS])
    return Pages(out).page(position=position) if position is not None else out
