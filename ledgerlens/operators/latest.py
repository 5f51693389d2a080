"""Newest row per key (the reports' "latest currency rate").

The reports look up, for a document's currency, the rate row with the
newest ``name`` (a date) -- the newest overall, not the one valid at the
document date.  Order is date descending with nulls **first** (a rate with
no date wins, as in a database that sorts nulls high) and, for equal dates,
the higher id (a fixed choice; the tie is otherwise undefined).

Rates are chosen by the maximum of one packed number that keeps this order:
the date's day, or a day above all others, before the id.  A number and the
rate beside it fit Spark's hash aggregate, so a history of any length is
reduced on the map side without a sort.

Rows of other kinds (:func:`top1_per_key`) are chosen as ``row_number() = 1``
over a window: Spark plans it with a partial ``WindowGroupLimit`` before the
shuffle, so each map task sends at most one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top1_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per ``keys`` under ``order`` (order must be total to be
    deterministic)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = "__top1_rn"
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


# Days of a date lie within four bytes, ids within eight.
_DAY_ZERO, _NO_DATE = 2**31, 2**32
_ID_ZERO, _ID_DIGITS = Decimal(2**63), 20
_PACKED = T.DecimalType(38, 0)


def recency(day: Column, row_id: Column) -> Column:
    """A whole number that grows with the date (null: above all dates), and
    for equal dates with the id (null: below all ids)."""
    days = F.coalesce(F.unix_date(day).cast("bigint") + F.lit(_DAY_ZERO), F.lit(_NO_DATE)).cast(T.DecimalType(17, 0))
    number = F.coalesce(row_id.cast(T.DecimalType(20, 0)) + F.lit(_ID_ZERO + 1), F.lit(Decimal(0)))
    return (days * F.lit(Decimal(10**_ID_DIGITS))).cast(_PACKED) + number.cast(_PACKED)


def latest_rate(rates: DataFrame) -> DataFrame:
    """``(currency_id, rate)``: the newest rate row of each currency."""
    r = rates.select("currency_id", "rate", recency(F.col("name"), F.col("id")).cast(_PACKED).alias("__recency"))
    return (r.filter(F.col("currency_id").isNotNull())
            .groupBy("currency_id").agg(F.max_by("rate", "__recency").alias("rate")))


def latest_rate_named(rates: DataFrame, currencies: DataFrame) -> DataFrame:
    """``(currency_id, rate, currency_name, currency_symbol)``.

    Rates of a currency missing from ``currencies`` are left out **before** the
    newest one is chosen; names join the chosen ones.
    """
    c = currencies.select(F.col("id").alias("c_id"), F.col("name").alias("currency_name"),
                          F.col("symbol").alias("currency_symbol"))
    known = rates.join(c.select("c_id"), F.col("currency_id") == F.col("c_id"), "left_semi")
    return latest_rate(known).join(c, F.col("currency_id") == F.col("c_id")).select(
        "currency_id", "rate", "currency_name", "currency_symbol")
