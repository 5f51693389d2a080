"""Settled amounts per journal line as of a date.

A line's residual is its amount minus the partial reconciliations where it
is the debit side plus those where it is the credit side, counting only
partials dated on or before ``date_to`` (a partial with no date never
counts).

The ageing report joins the debit partials and the credit partials as two
independent one-to-many joins, so inside one line the two lists multiply:
with n debit rows and m credit rows the summed debit is
``sum(debit) * max(m, 1)`` and the summed credit ``sum(credit) * max(n, 1)``.
This module reproduces that arithmetic exactly from per-side aggregates,
without materialising the product: one scan of the partials, one map-side
combined aggregation keyed by line id (a line with millions of partials is
reduced inside each map task before the shuffle).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.money import scale_of

# Decimals up to which a sum times a count keeps all of them in 38 digits.
_EXACT_SCALE = 12


def _times(total: Column, count: Column, scale: int) -> Column:
    """``total * max(count, 1)`` with all decimals of the amounts."""
    kind = T.DecimalType(38, scale)
    times = F.greatest(count, F.lit(1))
    if scale <= 6:
        return (total * times).cast(kind)
    often = times.cast(T.DecimalType(9, 0))
    out = (total.cast(T.DecimalType(28, scale)) * often).cast(kind)
    if scale > _EXACT_SCALE:  # decimals that are zeros don't use up the digits
        short = T.DecimalType(28, _EXACT_SCALE)
        out = F.when(F.round(total, _EXACT_SCALE) == total, (total.cast(short) * often).cast(kind)).otherwise(out)
    return F.when(times == 1, total.cast(kind)).otherwise(out)


_SUMS = ("debit_count", "credit_count", "debit_sum", "credit_sum")


def _sides(partials: DataFrame, *more: Column) -> DataFrame:
    """Each partial once as a debit of its debit line and once as a credit of
    its credit line (both may be set, even to the same line)."""
    def side(line: str, debit: bool) -> Column:
        return F.struct(F.col(line).alias("line_id"), F.lit(debit).alias("is_debit"), F.col("amount").alias("amount"), *more)
    return partials.select(F.inline(F.array(side("debit_move_id", True), side("credit_move_id", False)))).filter(
        F.col("line_id").isNotNull())


def _side_sums() -> list[Column]:
    debit = F.col("is_debit")
    return [
        F.count(F.when(debit, F.lit(1))).alias("debit_count"),
        F.count(F.when(~debit, F.lit(1))).alias("credit_count"),
        F.sum(F.when(debit, F.col("amount"))).alias("debit_sum"),
        F.sum(F.when(~debit, F.col("amount"))).alias("credit_sum"),
    ]


def _effective(scale: int) -> list[Column]:
    """The sums as the report sees them: fan-out applied, null as 0."""
    zero = F.lit(0).cast(T.DecimalType(38, scale))
    return [F.coalesce(_times(F.col("debit_sum"), F.col("credit_count"), scale), zero).alias("debit_amount"),
            F.coalesce(_times(F.col("credit_sum"), F.col("debit_count"), scale), zero).alias("credit_amount")]


def partial_residual(partials: DataFrame, date_to: dt.date | str) -> DataFrame:
    """Per line id: partial counts, plain sums and the report's effective sums.

    Output ``(line_id, debit_count, credit_count, debit_sum, credit_sum,
    debit_amount, credit_amount)``; ``debit_amount`` / ``credit_amount`` are
    the sums as the report sees them (fan-out applied, null as 0), with the
    decimals of the partials' amounts.
    """
    live = partials.filter(F.col("max_date") <= F.lit(date_to).cast("date"))
    agg = _sides(live).groupBy("line_id").agg(*_side_sums())
    return agg.select("line_id", *_SUMS, *_effective(scale_of(partials, partials["amount"])))


def settlement_deltas(partials: DataFrame) -> DataFrame:
    """Per line and day, what that day's partials add: ``(line_id, day,
    debit_count, credit_count, debit_sum, credit_sum)``.

    A table that grows by its newest days: kept, it answers any as-of date from
    the days up to it (:func:`settled_at`), without the partials.  A partial
    without a date never counts.
    """
    dated = partials.filter(F.col("max_date").isNotNull())
    return _sides(dated, F.col("max_date").alias("day")).groupBy("line_id", "day").agg(*_side_sums())


def settled_at(deltas: DataFrame, dates: Iterable[dt.date | str]) -> DataFrame:
    """:func:`partial_residual` as of each of some dates, from one run over the
    deltas: ``(as_of, line_id, ...)``, for the lines that have a partial by then.

    A day's sums are added to the first date that is not before it, so a line
    has a row per date at most before the running sums over its dates; a row
    then holds until the line's next one.
    """
    days = sorted({_date(d) for d in dates})
    if not days:
        raise ValueError("settled_at needs one date at least")
    scale = scale_of(deltas, deltas["debit_sum"])
    table = F.array(*[F.lit(d) for d in days])
    place = F.aggregate(table, F.lit(0), lambda n, d: n + (d < F.col("day")).cast("int"))
    at = deltas.filter(F.col("day") <= F.lit(days[-1])).withColumn("place", place)
    by_date = at.groupBy("line_id", "place").agg(*[F.sum(c).alias(c) for c in _SUMS])
    line = Window.partitionBy("line_id").orderBy("place")
    running = by_date.select("line_id", "place", F.lead("place", 1, len(days)).over(line).alias("until"),
                             *[F.sum(c).over(line).alias(c) for c in _SUMS])
    rows = running.withColumn("at", F.explode(F.sequence(F.col("place"), F.col("until") - 1)))
    return rows.select(F.get(table, F.col("at")).alias("as_of"), "line_id", *_SUMS, *_effective(scale))


def _date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)
