"""Checks of relations that a caller passes as report parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if ``keys`` repeat in ``df`` (a small parameter relation).

    The reports' sums assume one joined row per line for these relations.
    """
    if not df.groupBy(*keys).count().filter(F.col("count") > 1).isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} must be unique")
