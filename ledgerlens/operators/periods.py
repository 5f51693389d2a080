"""Ageing period range join.

Each period row has an inclusive upper bound ``date_start`` and an inclusive
lower bound ``date_stop`` (the names are historical; a null bound is open).
A line joins every period whose range contains its due date: overlapping
periods give several rows, a date in no period drops the line.

* A report's period table has a handful of rows: a broadcast nested loop join
  tests every line against them in place, with no shuffle of the lines.
* A table of more than :data:`MAX_PERIODS` rows is joined by equality.  The
  days are the leaves of a binary tree; a period is the fewest whole subtrees
  that make it up (two on a level at most, an open end reaches the first or the
  last leaf), and a line's day lies in one subtree of each level.  A line so
  meets each of its periods in exactly one subtree, and no other period, for
  as many rows as there are levels in use.

Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.checks import assert_unique

MAX_PERIODS = 1_000
# Levels of the tree of days, and the first day (0001-01-01): all dates.
LEVELS = 22
_FIRST_DAY = 719_162


def period_join(df: DataFrame, periods: DataFrame, date_col: str = "report_date",
                known_rows: int | None = None) -> DataFrame:
    """Inner range join of ``df`` with ``periods``; adds ``period_index``.

    ``known_rows``: the size of a table the caller built from Python rows;
    another one is counted and its ``period_index`` checked for repeats.  A line
    without a date joins only periods that are open at both ends.
    """
    p = periods.select(
        F.col("date_start").cast("date").alias("__p_upper"),
        F.col("date_stop").cast("date").alias("__p_lower"),
        F.col("period_index"),
    )
    rows = known_rows if known_rows is not None else p.limit(MAX_PERIODS + 1).count()
    if known_rows is None:
        assert_unique(p, ["period_index"], "period table")
    if rows > MAX_PERIODS:
        return _by_subtrees(df, p, date_col)
    p = F.broadcast(p)
    d = F.col(date_col)
    cond = ((p["__p_upper"].isNull() | (d <= p["__p_upper"]))
            & (p["__p_lower"].isNull() | (d >= p["__p_lower"])))
    return df.join(p, cond, "inner").drop("__p_upper", "__p_lower")


def _leaf(day: Column) -> Column:
    return F.unix_date(day) + F.lit(_FIRST_DAY)


def _subtrees(low: Column, high: Column) -> Column:
    """The fewest ``(level, node)`` subtrees that make up leaves ``low`` to ``high``."""
    empty = F.array().cast("array<struct<level:int,node:int>>")

    def node(level: Column, place: Column) -> Column:
        return F.array(F.struct(level.alias("level"), place.alias("node")))

    def up(state: Column, level: Column) -> Column:
        left, right = state["low"], state["high"]  # leaves of this level still to cover, right excluded
        open_ = left < right
        first, last = open_ & (left % 2 == 1), open_ & (right % 2 == 1)
        covered = F.concat(state["nodes"], F.when(first, node(level, left)).otherwise(empty),
                           F.when(last & (F.when(first, left + 1).otherwise(left) < right), node(level, right - 1)).otherwise(empty))
        return F.struct(F.shiftright(F.when(first, left + 1).otherwise(left), 1).alias("low"),
                        F.shiftright(F.when(last, right - 1).otherwise(right), 1).alias("high"), covered.alias("nodes"))

    start = F.struct(low.alias("low"), (high + 1).alias("high"), empty.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, up)["nodes"]


def _by_subtrees(df: DataFrame, p: DataFrame, date_col: str) -> DataFrame:
    low = F.coalesce(_leaf(F.col("__p_lower")), F.lit(0))
    high = F.coalesce(_leaf(F.col("__p_upper")), F.lit((1 << LEVELS) - 1))
    # a line without a date lies in a subtree of its own, as a period open at both ends does
    undated = F.when(F.col("__p_lower").isNull() & F.col("__p_upper").isNull(), F.array(
        F.struct(F.lit(-1).alias("level"), F.lit(0).alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:int>>"))
    parts = p.select("period_index", F.inline(F.concat(_subtrees(low, high), undated))).withColumnsRenamed(
        {"level": "__p_level", "node": "__p_node"})
    used = sorted(r[0] for r in parts.select("__p_level").distinct().collect() if r[0] >= 0)  # levels: 23 at most
    leaf = _leaf(F.col(date_col))
    own = F.when(F.col(date_col).isNull(), F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("node")))).otherwise(
        F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(leaf, n).alias("node")) for n in used or [0]]))
    lines = df.withColumn("__p_in", F.explode(own))
    same = (F.col("__p_in.level") == F.col("__p_level")) & (F.col("__p_in.node") == F.col("__p_node"))
    return lines.join(parts, same).drop("__p_in", "__p_level", "__p_node")
