"""``ORDER BY ... OFFSET o LIMIT k`` without funnelling rows through one task.

An order is a list of SQL sort keys (``"create_date DESC NULLS FIRST"``).

* With a limit and a page near the top, Spark's ``TakeOrderedAndProject``
  keeps a bounded heap per task.
* Otherwise the list is kept in its order (:class:`Pages`): one range shuffle,
  written to the checkpoint folder.  The row counts of its parts, a number
  each, are the page index: a row's position is its part's first position and
  its place in the part.  Any number of pages are read from the kept list.

Both give the same rows.  The order must be total (end it with a unique
column) for the page to be well defined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import SortKey, sort_columns
from ledgerlens.session import checkpoint_folder

__all__ = ["HEAP_ROWS", "Pages", "SortKey", "ordered_slice", "sort_columns"]

#: Deepest row of a page that per-task heaps are kept for: a task sends so
#: many rows at most to the one that merges them.
HEAP_ROWS = 1_000
# ``monotonically_increasing_id``: the part above, the place in it below.
_PART_BITS = 33


class Pages:
    """A list kept in its order, and the index of its parts.

    The rows are computed once; pages and positions come from the kept files.
    Without ``order``, ``df`` is in order already (its partitions follow each
    other).
    """

    def __init__(self, df: DataFrame, order: Sequence[str] | None = None):
        checkpoint_folder(df.sparkSession)
        if order is not None:
            columns = sort_columns(order)
            df = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        self._columns = df.columns
        self._rows = df.checkpoint().withColumn("__pg_id", F.monotonically_increasing_id())
        part = F.shiftright("__pg_id", _PART_BITS)
        counts = dict(self._rows.groupBy(part.alias("part")).count().collect())  # a number per part
        self._firsts = []
        self.rows = 0
        for i in range(max(counts, default=-1) + 1):
            self._firsts.append(self.rows)
            self.rows += counts.get(i, 0)

    def page(self, offset: int = 0, limit: int | None = None, position: str | None = None) -> DataFrame:
        """Rows ``offset .. offset+limit-1`` in order; ``position`` names a
        column with each row's place in the whole list, from 0."""
        last = self.rows if limit is None else min(offset + limit, self.rows)
        name = position or "__pg_position"
        part, place = F.shiftright("__pg_id", _PART_BITS), F.col("__pg_id").bitwiseAND((1 << _PART_BITS) - 1)
        firsts = F.array(*[F.lit(n).cast("bigint") for n in self._firsts or [0]])
        rows = self._rows.withColumn(name, (F.get(firsts, part.cast("int")) + place).cast("bigint"))
        if offset > 0 or last < self.rows:
            rows = rows.where((F.col(name) >= offset) & (F.col(name) < last))
        return rows.select(*self._columns, *([position] if position else []))


def ordered_slice(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int | None = None,
                  position: str | None = None, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """Rows ``offset .. offset+limit-1`` of ``df`` under ``order``, sorted;
    ``position`` names a column with each row's place in the whole order,
    from 0."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must be non-negative")
    if position is None and limit is not None and offset + limit <= heap_rows:
        return df.orderBy(*sort_columns(order)).offset(offset).limit(limit)
    if position is None and offset == 0 and limit is None:
        return df.orderBy(*sort_columns(order))
    return Pages(df, order).page(offset, limit, position)
