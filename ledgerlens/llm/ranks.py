"""Row numbers over large groups without putting a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: Column, bucket_rows: int) -> Column:
    """Number of buckets for a group of ``rows`` rows, one at least."""
    return F.greatest(F.ceil(rows / F.lit(bucket_rows)), F.lit(1)).cast("long")


def add_rank(df: DataFrame, name: str, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group of rows equal in ``keys``.

    Ranks go up by ``bucket`` and, inside a bucket, by ``order``; so one task
    sorts a bucket, not a group, and the bucket offsets are a window over one
    row per bucket.  Take :func:`dealt` for ranks in any fixed order, or a
    range of the leading order column for ranks in that order.  Rows that are
    equal in everything ``order`` names take their ranks in any order.
    """
    n, b, first = f"__{name}_n", f"__{name}_b", f"__{name}_first"
    rows = df.withColumn(b, bucket)
    per = rows.groupBy(*keys, b).agg(F.count("*").alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias(f"__o_{k}") for k in [*keys, b]],
                         F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in [*keys, b]])
    return (ranked.join(offsets, same)
            .withColumn(name, (F.col(name) - 1 + F.col(first)).cast("long"))
            .drop(b, first, *[f"__o_{k}" for k in [*keys, b]]))


def dealt(spread: Column, buckets: Column) -> Column:
    """Bucket by a 64-bit hash; ``buckets`` is constant within a group."""
    return F.pmod(spread, buckets)
