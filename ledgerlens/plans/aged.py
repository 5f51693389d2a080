"""Aged receivable / payable report.

One row per open journal line of a receivable (or payable) account, with the
amount still due spread over six ageing columns: the line's own period holds
the signed residual in company currency, rounded to the company precision,
the other five hold 0.

Plan, in the order the data meets it (lines are the only large input):

1. accounts of the report's kind (non-excluded) filter the lines by a semi
   join, and the company currency table joins them;
2. partials are reduced to one row per line (``partial_residual``) and joined
   on the line id; the "still open" test (company-currency residual rounded
   to the company precision is not 0) is applied right there, so settled
   lines leave before the wider joins;
3. document headers (with their source sale order and the latest rate of the
   document currency) join on the move id;
4. account label, journal currency, partner and trust rows join;
5. the period range join runs last, against the broadcast period table.

Tables join without hints: Catalyst and AQE broadcast what is small by its
statistics or its real size, and split a hot partner, document or line in a
shuffled join, because both sides of each have an exchange of their own.
Joined columns carry private names until the last select, so a line table may
have columns of the same names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.money import (
    ROUNDED, ratio_or_one, rounds_to_nonzero, scale_of, with_converted,
)
from ledgerlens.functions.text import DEFAULT_TRUST, account_label
from ledgerlens.operators.checks import assert_unique
from ledgerlens.operators.latest import latest_rate
from ledgerlens.operators.paging import Pages, SortKey
from ledgerlens.operators.periods import period_join
from ledgerlens.operators.rollup import GroupLevel, Rollup, group_rows, hierarchy
from ledgerlens.operators.settlement import partial_residual
from ledgerlens.operators.trust import join_trust
from ledgerlens.sources.inline import currency_table as make_currency_table
from ledgerlens.sources.inline import period_rows, period_table

PERIODS = 6
# Columns the report selects explicitly; every other column of the journal
# line passes through under its own name, in front of them.
_EXPLICIT = (
    "amount_currency", "partner_id", "partner_name", "partner_trust", "report_currency_id",
    "payment_id", "report_date", "expected_pay_date", "move_type", "move_name", "move_ref",
    "amount_residual", "order_no", "currency_rate", "account_name", "account_code",
)


def account_sign(account_type: str) -> int:
    """+1 for receivable accounts, -1 for any other kind."""
    return 1 if account_type == "receivable" else -1


def aged_lines(tables: Mapping[str, DataFrame], date_to: dt.date | str,
               account_type: str = "receivable",
               currency_table: DataFrame | Sequence[tuple] | None = None,
               periods: DataFrame | None = None) -> DataFrame:
    """Open lines of ``account_type`` accounts as of ``date_to`` with six
    ageing columns ``period0 .. period5``.

    ``currency_table`` is ``(company_id, rate, precision)``, one row per
    company (a company missing from it drops its lines), given as Python
    rows or as a DataFrame (checked for repeated companies).  ``periods`` is
    ``(date_start, date_stop, period_index)``; by default the six 30-day
    buckets ending at ``date_to``.
    """
    if currency_table is None:
        raise ValueError("aged_lines needs the company currency table")
    aml = tables["account_move_line"]
    spark = aml.sparkSession
    sign = account_sign(account_type)

    acc = (tables["account_account"]
           .filter((F.col("internal_type") == account_type)
                   & ~F.coalesce(F.col("exclude_from_aged_reports"), F.lit(False)))
           .select(F.col("id").alias("__acc_id"),
                   account_label(F.col("code"), F.col("name")).alias("__account_name"),
                   F.col("code").alias("__account_code")))
    journal = tables["account_journal"].select(
        F.col("id").alias("__jr_id"), F.col("currency_id").alias("__jr_currency_id"))
    if isinstance(currency_table, DataFrame):
        assert_unique(currency_table, ["company_id"], "currency table")
    else:
        currency_table = make_currency_table(spark, list(currency_table))  # validates on the driver
    ct = currency_table.select(F.col("company_id").alias("__ct_company_id"),
                               F.col("rate").alias("__company_rate"),
                               F.col("precision").alias("__precision"))
    partners = tables["res_partner"].select(F.col("id").alias("__p_id"),
                                            F.col("name").alias("__partner_name"))

    line_cols = aml.columns
    # Only the filtering joins run before the shuffles (account kind as a
    # semi join, company currency for the open-amount test); the account
    # label and the journal currency are attached after them, so the
    # shuffled rows stay narrow.
    lines = (aml
             .filter(F.col("partner_id").isNotNull())
             .join(acc.select("__acc_id"), F.col("account_id") == F.col("__acc_id"), "left_semi")
             .join(ct, F.col("company_id") == F.col("__ct_company_id")))

    # settlement as of date_to, then the HAVING test
    settled = partial_residual(tables["account_partial_reconcile"], date_to).select(
        F.col("line_id").alias("__set_line_id"),
        F.col("debit_amount").alias("__debit"), F.col("credit_amount").alias("__credit"))
    lines = lines.join(settled, F.col("id") == F.col("__set_line_id"), "left")
    debit = F.coalesce(F.col("__debit"), F.lit(0))
    credit = F.coalesce(F.col("__credit"), F.lit(0))
    # a type that keeps all decimals of both sides of a difference
    scale = max(scale_of(lines, F.col("balance")), scale_of(lines, debit))
    kept = T.DecimalType(36, scale)
    paid = (debit.cast(kept) - credit.cast(kept)).cast(kept)
    lines = lines.filter(rounds_to_nonzero((F.col("balance").cast(kept) - paid).cast(kept), F.col("__precision")))

    # document header, its source order and the latest rate of its currency
    lines = lines.join(_move_headers(tables), F.col("move_id") == F.col("__mv_id"))

    # account label, journal currency, partner (inner) and its trust rows
    lines = (lines
             .join(acc, F.col("account_id") == F.col("__acc_id"))
             .join(journal, F.col("journal_id") == F.col("__jr_id"))
             .join(partners, F.col("partner_id") == F.col("__p_id")))
    lines = join_trust(lines, tables["ir_property"])

    # period range join
    lines = lines.withColumn("__report_date", F.coalesce(F.col("date_maturity"), F.col("date")))
    if "period_index" in line_cols:
        lines = lines.withColumnRenamed("period_index", "__own_period_index")
    if periods is None:
        lines = period_join(lines, period_table(spark, date_to), "__report_date",
                            known_rows=len(period_rows(date_to)))
    else:
        lines = period_join(lines, periods, "__report_date")

    lines = with_converted(lines, "__amount", F.col("amount_currency"), F.col("__currency_rate"), F.col("balance"),
                           paid, F.col("__company_rate"), F.col("__precision"))
    amount = (F.lit(sign) * F.col("__amount")).cast(ROUNDED)
    buckets = [F.when(F.col("period_index") == i, amount).otherwise(F.lit(0).cast(ROUNDED))
               .alias(f"period{i}") for i in range(PERIODS)]

    explicit: dict[str, Column] = {
        "amount_currency": F.col("amount_currency"),
        "partner_id": F.col("partner_id"),
        "partner_name": F.col("__partner_name"),
        "partner_trust": F.coalesce(F.col("__trust_value"), F.lit(DEFAULT_TRUST)),
        "report_currency_id": F.coalesce(F.col("currency_id"), F.col("__jr_currency_id")),
        "payment_id": F.col("payment_id"),
        "report_date": F.col("__report_date"),
        "expected_pay_date": F.col("expected_pay_date"),
        "move_type": F.col("__move_type"),
        "move_name": F.col("__move_name"),
        "move_ref": F.col("__move_ref"),
        "amount_residual": F.col("__amount_residual"),
        "order_no": F.col("__order_no"),
        "currency_rate": F.col("__currency_rate"),
        "account_name": F.col("__account_name"),
        "account_code": F.col("__account_code"),
    }
    own = {"period_index": "__own_period_index"}
    replaced = {*_EXPLICIT, *(f"period{i}" for i in range(PERIODS))}
    passthrough = [F.col(own.get(c, c)).alias(c) for c in line_cols if c not in replaced]
    return lines.select(*passthrough, *[explicit[c].alias(c) for c in _EXPLICIT], *buckets)


def _move_headers(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Document headers with the source sale order name and the latest rate
    of the document currency, under private names."""
    mv = tables["account_move"].select(
        F.col("id").alias("__mv_id"), F.col("move_type").alias("__move_type"),
        F.col("name").alias("__move_name"), F.col("ref").alias("__move_ref"),
        F.col("amount_residual").alias("__amount_residual"),
        F.col("currency_id").alias("__mv_currency_id"),
        F.col("x_studio_source_order").alias("__mv_source_order"))
    rates = latest_rate(tables["res_currency_rate"]).select(
        F.col("currency_id").alias("__rate_currency_id"), F.col("rate").alias("__currency_rate"))
    orders = tables["sale_order"].select(F.col("id").alias("__so_id"),
                                         F.col("name").alias("__order_no"))
    return (mv.join(rates, F.col("__mv_currency_id") == F.col("__rate_currency_id"), "left")
              .join(orders, F.col("__mv_source_order") == F.col("__so_id"), "left")
              .drop("__rate_currency_id", "__so_id", "__mv_currency_id", "__mv_source_order"))


# Columns of the partner-level report, in display order.
BY_PARTNER_COLUMNS = (
    "partner_id", "partner_name", "amount_residual", "report_date", "move_name",
    "currency_rate", "original_currency_amount", "account_name", "order_no",
    *[f"period{i}" for i in range(PERIODS)], "amount_currency",
)


# How lines fold into partners: ``max`` for the order number and the rate, as
# the report declares, sums for the other numbers (``amount_residual`` is a
# document-header value repeated on each of its lines, so it is counted once per
# line, as the report does); due date, document and account have no operator.
AGED_ROLLUP = Rollup(
    levels=(GroupLevel(("partner_id",), ("partner_name ASC NULLS LAST", "partner_id"), ("partner_name",)),),
    operators={"order_no": "max", "currency_rate": "max", "amount_residual": "sum", "amount_currency": "sum",
               **{f"period{i}": "sum" for i in range(PERIODS)}},
    line_order=("report_date ASC NULLS LAST", "id ASC NULLS FIRST"))


def group_by_partner(lines: DataFrame, sort_by: Sequence[Column | str] | None = None,
                     position: str | None = None) -> DataFrame:
    """Roll aged lines up per partner, by :data:`AGED_ROLLUP`.

    Columns with no operator (due date, move name, account) are empty at this
    level.  ``original_currency_amount`` is the ratio of the group's aggregates:
    sum of ``amount_currency`` over the group's max rate (rate null or 0 -> 1).

    ``sort_by`` takes sort columns or SQL sort keys over the result's columns,
    the computed one included.  With SQL keys, ``position`` names a column with
    each row's place in that order, from 0.
    """
    empty = {"report_date": "date", "move_name": "string", "account_name": "string"}
    cells = {**{c: F.lit(None).cast(kind) for c, kind in empty.items()},
             "original_currency_amount": ratio_or_one(F.col("amount_currency"), F.col("currency_rate"))}
    out = group_rows(lines, AGED_ROLLUP).select(*[cells.get(c, F.col(c)).alias(c) for c in BY_PARTNER_COLUMNS])
    if position is not None:
        return Pages(out, [str(k) for k in sort_by or ("partner_id",)]).page(position=position)
    if sort_by:
        out = out.orderBy(*[SortKey.parse(k).column if isinstance(k, str) else k for k in sort_by])
    return out


def two_levels(lines: DataFrame, position: str | None = None) -> DataFrame:
    """Partner rows (``level`` 0) and line rows (``level`` 1) with the same
    columns, each partner followed by its lines.

    A line row shows its own document and account; its original currency
    amount is the same ratio as a partner's, of the line's own values.
    Both levels come from one run of the lines (:func:`hierarchy`).  Sorted by
    partner name (nulls last), partner, level, due date and line; ``position``
    names a column with each row's place, from 0.
    """
    both = hierarchy(lines, AGED_ROLLUP, ["id", *[c for c in BY_PARTNER_COLUMNS if c != "original_currency_amount"]])
    ratio = ratio_or_one(F.col("amount_currency"), F.col("currency_rate")).alias("original_currency_amount")
    out = both.select("level", "id", *[ratio if c == "original_currency_amount" else F.col(c) for c in BY_PARTNER_COLUMNS])
    return Pages(out).page(position=position) if position is not None else out


def aged_report(tables: Mapping[str, DataFrame], date_to: dt.date | str, account_type: str = "receivable",
                currency_table: DataFrame | Sequence[tuple] | None = None,
                periods: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """The two-level report: :func:`aged_lines` under their partners."""
    return two_levels(aged_lines(tables, date_to, account_type, currency_table, periods), position)


def aged_by_partner(tables: Mapping[str, DataFrame], date_to: dt.date | str,
                    account_type: str = "receivable",
                    currency_table: DataFrame | Sequence[tuple] | None = None,
                    periods: DataFrame | None = None,
                    sort_by: Sequence[Column | str] | None = None, position: str | None = None) -> DataFrame:
    """:func:`aged_lines` rolled up per partner (:func:`group_by_partner`)."""
    return group_by_partner(
        aged_lines(tables, date_to, account_type, currency_table, periods), sort_by, position)
