"""Declared roll-ups: group rows at any number of levels.

A :class:`Rollup` declares the levels a report folds into (their keys, the
order of their groups, the columns that a group has once) and an operator for
each column that group rows show: ``sum``, ``max``, ``min``, ``count`` (rows
with a value) or ``rows``.  A column without an operator is empty in a group
row.

* :func:`group_rows` compiles it into the aggregation of one level.
* :func:`hierarchy` compiles it into all levels and the lines themselves, from
  one run of the lines: they are dealt into ranges of the report's order with
  literal bounds, a window over (range, group) gives a group's values within
  its range, and the group row is emitted beside the group's first line.  The
  window needs no shuffle of its own, and the ranges are the report's order.

Bounds lie between groups (:mod:`ledgerlens.operators.ranges`).  Only a group
with more than a range's share of the rows is split over ranges; the values of
these groups, a row per bound at most, are aggregated on the map side from
their own lines and joined to the row beside their first line.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ranges import SortKey, align, cut_points, range_of, sort_columns, split_groups

_OPERATORS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "rows": lambda _: F.count(F.lit(1))}
# The operator that puts two results of an operator together.
_AGAIN = {"sum": "sum", "max": "max", "min": "min", "count": "sum", "rows": "sum"}


@dataclass(frozen=True)
class GroupLevel:
    """A level's own key columns, the order of its groups (SQL sort keys over
    the keys and ``constants``; the keys, unless said) and the other columns
    that have one value within a group."""

    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    constants: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.keys, *self.constants)

    @property
    def sort_keys(self) -> tuple[str, ...]:
        return self.order or self.keys


@dataclass(frozen=True)
class Rollup:
    """Levels, outermost first, the operator of each column, and the order of
    the lines within the innermost group; ``line_key`` names a line."""

    levels: tuple[GroupLevel, ...]
    operators: Mapping[str, str]
    line_order: tuple[str, ...] = ("id",)
    line_key: str = "id"

    def __post_init__(self):
        unknown = set(self.operators.values()) - set(_OPERATORS)
        if unknown:
            raise ValueError(f"unknown operator(s) {sorted(unknown)}; known: {sorted(_OPERATORS)}")
        if not self.levels:
            raise ValueError("a roll-up has one level at least")

    def columns_to(self, depth: int) -> list[str]:
        """Keys and constants of the first ``depth`` levels."""
        return [c for level in self.levels[:depth] for c in level.columns]

    def folded(self, depth: int) -> dict[str, str]:
        """Columns that an operator folds at a level (a key or constant has one
        value in a group, whatever the operator)."""
        fixed = set(self.columns_to(depth))
        return {c: op for c, op in self.operators.items() if c not in fixed}


def _folds(operators: Mapping[str, str]) -> list[Column]:
    return [_OPERATORS[op](F.col(c) if op != "rows" else None).alias(c) for c, op in operators.items()]


def group_rows(lines: DataFrame, rollup: Rollup, depth: int | None = None) -> DataFrame:
    """One row per group of a level (the innermost, unless said): its keys and
    constants, and every column with an operator.

    Numbers are hash aggregates, combined on the map side.  The ``max`` or
    ``min`` of a text needs a sorting aggregate in Spark: such texts are keys of
    a first aggregation, so that only one row per group and text is sorted.
    """
    depth = len(rollup.levels) if depth is None else depth
    keys, folded = rollup.columns_to(depth), rollup.folded(depth)
    texts = [c for c, op in folded.items() if op in ("max", "min") and isinstance(lines.schema[c].dataType, T.StringType)]
    if texts:
        first = {c: op for c, op in folded.items() if c not in texts}
        lines = lines.groupBy(*keys, *texts).agg(*(_folds(first) or [F.lit(None)]))
        folded = {c: op if c in texts else _AGAIN[op] for c, op in folded.items()}
    if not folded:
        return lines.select(*keys).distinct()
    return lines.groupBy(*keys).agg(*_folds(folded)).select(*keys, *folded)


def report_order(rollup: Rollup, level: str = "level") -> list[Column]:
    """The order of a hierarchy: every group before what it holds."""
    out: list[Column] = []
    for j, group in enumerate(rollup.levels):
        out += [*sort_columns(group.sort_keys), F.col(level) > j]
    return [*out, *sort_columns(rollup.line_order)]


def hierarchy(lines: DataFrame, rollup: Rollup, columns: Sequence[str] | None = None, level: str = "level",
              sort: bool = True, ranges: int | None = None) -> DataFrame:
    """Group rows of all levels and the lines, in the report's order.

    ``level`` is 0 for the outermost groups and the number of levels for lines;
    ``columns`` (all, unless said) have a line's values in line rows, and in
    group rows the group's keys and constants, the results of operators, and
    null elsewhere.  A folded column has its operator's result type in all rows
    (a line that is counted shows its own count, 0 or 1).
    Equal lines stay as many rows as they are.  ``ranges``: partitions of the
    result at most (the session's shuffle partitions, unless said).
    """
    columns = list(columns or lines.columns)
    depth = len(rollup.levels)
    operators = {c: op for c, op in rollup.operators.items() if c in columns}
    kinds = {f.name: f.dataType for f in lines.agg(*_folds(operators)).schema.fields} if operators else {}
    own = {c: F.col(c).isNotNull() if op == "count" else F.lit(1) if op == "rows" else F.col(c) for c, op in operators.items()}
    wide = lines.select(*[own[c].cast(kinds[c]).alias(c) if c in own else F.col(c) for c in columns])

    orders = [k for g in rollup.levels for k in g.sort_keys]
    keys = [SortKey.parse(k) for k in (*orders, *rollup.line_order)]
    lengths = [len([k for g in rollup.levels[:j + 1] for k in g.sort_keys]) for j in range(depth)]
    most = ranges or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = align(cut_points(lines, keys, F.col(rollup.line_key), most), lengths)
    place = "__range"
    sorted_by = [f.dataType for f in wide.select(*[F.expr(k.expression).alias(f"k{i}") for i, k in enumerate(keys)]).schema]
    rows = wide.withColumn(place, range_of(keys, cuts, sorted_by)).repartitionById(len(cuts) + 1, place)

    values: list[dict[str, Column]] = []
    heads: list[Column] = []
    for j in range(depth):
        group = rollup.columns_to(j + 1)
        folded = {c: _AGAIN[op] for c, op in rollup.folded(j + 1).items() if c in columns}
        inner = [k for g in rollup.levels[j + 1:] for k in g.sort_keys]
        whole = Window.partitionBy(place, *group).orderBy(*sort_columns([*inner, *rollup.line_order]))
        unbounded = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({f"__{j}_first": F.row_number().over(whole), **{
            f"__{j}_{c}": _OPERATORS[op](F.col(c)).over(unbounded) for c, op in folded.items()}})
        rows, value, head = _with_split_groups(rows, wide, rollup, j, folded, split_groups(cuts, lengths[j]), keys, place)
        values.append({**{c: F.col(c) for c in group}, **value})
        heads.append(head)

    shown = {f.name: f.dataType for f in wide.schema.fields}

    def row(number: int, given: Mapping[str, Column]) -> Column:
        return F.struct(F.lit(number).alias(level), *[
            given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in shown.items()])

    line = row(depth, {c: F.col(c) for c in shown})
    if depth == 1:
        emitted = F.when(heads[0], F.array(row(0, values[0]), line)).otherwise(F.array(line))
    else:
        emitted = F.array_compact(F.array(*[F.when(h, row(j, v)) for j, (h, v) in enumerate(zip(heads, values, strict=True))], line))
    out = rows.select(F.inline(emitted))
    return out.sortWithinPartitions(*report_order(rollup, level)) if sort else out


def _with_split_groups(rows: DataFrame, lines: DataFrame, rollup: Rollup, j: int, folded: Mapping[str, str],
                       split: Mapping[tuple, int], keys: Sequence[SortKey], place: str) -> tuple[DataFrame, dict, Column]:
    """The values of a level's groups and the row they stand beside: those of
    a split group come from all its lines, beside the first of its first range."""
    first = F.col(f"__{j}_first") == 1
    if not split:
        return rows, {c: F.col(f"__{j}_{c}") for c in folded}, first
    length = len(next(iter(split)))
    names = [f"__s{i}" for i in range(length)]
    kinds = lines.select(*[F.expr(k.expression).alias(n) for k, n in zip(keys, names, strict=False)]).schema
    begins = lines.sparkSession.createDataFrame([(*g, at) for g, at in split.items()],
                                                T.StructType([*kinds.fields, T.StructField("__begin", T.IntegerType())]))

    def same(right: Sequence[str]) -> Column:
        return reduce(Column.__and__, [F.expr(k.expression).eqNullSafe(F.col(n)) for k, n in zip(keys, right, strict=False)])

    bounded = F.broadcast(begins)  # a row per cut point at most
    theirs = lines.join(bounded.drop("__begin"), same(names), "left_semi")
    level = Rollup(rollup.levels[:j + 1], folded, rollup.line_order, rollup.line_key)
    totals = group_rows(theirs, level, j + 1)
    group = rollup.columns_to(j + 1)
    totals = totals.join(bounded, same(names)).select(
        F.col("__begin").alias(f"__{j}_begin"), *[F.col(c).alias(f"__{j}_is_{c}") for c in group],
        *[F.col(c).alias(f"__{j}_all_{c}") for c in folded])
    match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{j}_is_{c}")) for c in group])
    rows = rows.join(F.broadcast(totals), match, "left")
    whole = F.col(f"__{j}_begin").isNull()
    return (rows, {c: F.when(whole, F.col(f"__{j}_{c}")).otherwise(F.col(f"__{j}_all_{c}")) for c in folded},
            first & (whole | (F.col(place) == F.col(f"__{j}_begin"))))
