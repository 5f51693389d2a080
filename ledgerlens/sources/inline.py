"""Small parameter relations built on the driver.

The ageing query joins two relations that are not tables but report
parameters: the company currency table (rate and rounding precision per
company) and the period table (six ageing buckets).  They are created with
``createDataFrame`` from a handful of Python rows, so their size is known
on the driver and they can be broadcast without any further check.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CURRENCY_TABLE_SCHEMA = T.StructType([
    T.StructField("company_id", T.IntegerType(), False),
    T.StructField("rate", T.DecimalType(18, 6), True),
    T.StructField("precision", T.IntegerType(), True),
])

# Decimals that a company rate can have.
MAX_RATE_DECIMALS = 18

PERIOD_TABLE_SCHEMA = T.StructType([
    # Upper bound of the period (inclusive); null = open.
    T.StructField("date_start", T.DateType(), True),
    # Lower bound of the period (inclusive); null = open.
    T.StructField("date_stop", T.DateType(), True),
    T.StructField("period_index", T.IntegerType(), False),
])


def currency_table(spark: SparkSession,
                   rows: Iterable[tuple[int, Decimal | float | int | str, int]]) -> DataFrame:
    """Company currency table ``(company_id, rate, precision)``; rates have
    the decimals of the longest one given, 6 at least.

    ``company_id`` must be unique: the report sums over one joined row per
    line, and a second row for a company would double that line.
    """
    clean = [(int(c), _dec(r), None if p is None else int(p)) for c, r, p in rows]
    companies = [c for c, _, _ in clean]
    if len(set(companies)) != len(companies):
        raise ValueError("currency_table: company_id must be unique")
    scale = max([CURRENCY_TABLE_SCHEMA["rate"].dataType.scale, *(-r.as_tuple().exponent for _, r, _ in clean if r is not None)])
    if scale > MAX_RATE_DECIMALS:
        raise ValueError(f"currency_table: more than {MAX_RATE_DECIMALS} decimals in a rate")
    rate = T.StructField("rate", T.DecimalType(12 + scale, scale), True)
    company, _, precision = CURRENCY_TABLE_SCHEMA.fields
    return spark.createDataFrame(clean, T.StructType([company, rate, precision]))


def period_rows(date_to: dt.date | str, days: int = 30,
                periods: int = 6) -> list[tuple[dt.date | None, dt.date | None, int]]:
    """Ageing buckets ending at ``date_to``, both ends inclusive.

    With D = ``date_to`` and ``days`` = 30 (fixed choice, see SURVEY 7.5):
    0 -> [D, open), 1 -> [D-30, D-1], 2 -> [D-60, D-31], 3 -> [D-90, D-61],
    4 -> [D-120, D-91], 5 -> (open, D-121].
    """
    d = _date(date_to)
    one = dt.timedelta(days=1)
    rows: list[tuple[dt.date | None, dt.date | None, int]] = [(None, d, 0)]
    upper = d - one
    for i in range(1, periods):
        if i == periods - 1:
            rows.append((upper, None, i))
        else:
            lower = d - dt.timedelta(days=days * i)
            rows.append((upper, lower, i))
            upper = lower - one
    return rows


def period_table(spark: SparkSession, date_to: dt.date | str, days: int = 30,
                 periods: int = 6) -> DataFrame:
    """Period table for ``date_to`` (see :func:`period_rows`)."""
    return spark.createDataFrame(period_rows(date_to, days, periods), PERIOD_TABLE_SCHEMA)


def _dec(value) -> Decimal | None:
    if value is None:
        return None
    return Decimal(str(value))


def _date(value: dt.date | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))
