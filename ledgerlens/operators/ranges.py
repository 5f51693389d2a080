"""Ranges of a sort order with literal bounds.

``repartitionByRange`` draws its bounds anew in every run, so nothing can be
said on the driver about where a range begins.  Here the bounds are *cut
points*: sort keys of some rows, collected once.  A row's range follows from
its own sort keys and the cut points alone, whatever task or run meets it, and
the driver knows which groups a cut point lies in.

Cut points lie between groups wherever they can: one that follows the cut
point of another group is moved to the start of its own group.  Only a group
that holds several cut points, i.e. more than a range's share of the rows, is
cut inside.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One row in so many is counted to learn how many rows there are.
COUNTED_SHARE = 64
# Rows looked at for each cut point, and rows that are worth a range.
SAMPLE_PER_RANGE = 32
RANGE_ROWS = 20_000
_KEY = re.compile(r"^(.*?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?$", re.IGNORECASE | re.DOTALL)


@dataclass(frozen=True)
class SortKey:
    """One sort key: an SQL expression, its direction and where nulls go."""

    expression: str
    descending: bool
    nulls_first: bool

    @staticmethod
    def parse(text: str) -> SortKey:
        """``expression [ASC | DESC] [NULLS FIRST | NULLS LAST]``; nulls are
        first in ascending and last in descending order unless said."""
        expression, direction, nulls = _KEY.match(text.strip()).groups()
        descending = (direction or "").upper() == "DESC"
        return SortKey(expression, descending, nulls.upper() == "FIRST" if nulls else not descending)

    @property
    def column(self) -> Column:
        value = F.expr(self.expression)
        if self.descending:
            return value.desc_nulls_first() if self.nulls_first else value.desc_nulls_last()
        return value.asc_nulls_first() if self.nulls_first else value.asc_nulls_last()

    def reversed(self) -> str:
        """The key of the same list read from its end."""
        return f"{self.expression} {'ASC' if self.descending else 'DESC'} NULLS {'LAST' if self.nulls_first else 'FIRST'}"


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [SortKey.parse(k).column for k in order]


@dataclass(frozen=True)
class CutPoint:
    """A bound between two ranges: the sort keys of a row, of which the first
    ``length`` count (a group's keys: the bound is the group's start)."""

    values: tuple
    length: int


def align(rows: Sequence[tuple], groups: Sequence[int]) -> list[CutPoint]:
    """Cut points at the starts of groups where possible.

    ``rows``: sort keys in ascending order; ``groups``: how many leading keys
    name a group of each level, outermost first.  A bound lies at the start of
    the outermost group that the bound before it isn't in, inside a group only
    if that is the same group on all levels.
    """
    out, before = [], None
    for row in rows:
        length = next((n for n in groups if before is None or row[:n] != before[:n]), len(row))
        out.append(CutPoint(tuple(row), length))
        before = row
    return out


def split_groups(cuts: Sequence[CutPoint], length: int) -> dict[tuple, int]:
    """Groups (their first ``length`` keys) that a bound lies inside, and the
    range that each begins in."""
    out: dict[tuple, int] = {}
    for i, cut in enumerate(cuts):
        if cut.length > length:
            out.setdefault(cut.values[:length], i)
    return out


def cut_points(df: DataFrame, keys: Sequence[SortKey], row_key: Column, most: int) -> list[tuple]:
    """Sort keys of up to ``most - 1`` rows, evenly spaced in the order.

    Rows are chosen by a hash of ``row_key`` alone, which filters the scan that
    the key comes from; a first count over one row in :data:`COUNTED_SHARE`
    sets the hash bound, so that about :data:`SAMPLE_PER_RANGE` rows a range
    are collected from a table of any size.
    """
    place = F.pmod(F.xxhash64(row_key), F.lit(1 << 40))
    counted = df.where(place < (1 << 40) // COUNTED_SHARE).count()
    rows = max(counted, 1) * COUNTED_SHARE
    ranges = max(1, min(most, rows // RANGE_ROWS))
    if ranges == 1:
        return []
    share = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    names = [f"k{i}" for i in range(len(keys))]
    found = (df.where(place < int(share * (1 << 40)))
             .select(*[F.expr(k.expression).alias(n) for k, n in zip(keys, names, strict=True)])
             .orderBy(*[SortKey(n, k.descending, k.nulls_first).column for k, n in zip(keys, names, strict=True)]).collect())
    return [tuple(found[len(found) * i // ranges]) for i in range(1, ranges)] if found else []


# Types whose values compare inside a struct as they do alone.
_PLAIN = (T.IntegralType, T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def range_of(keys: Sequence[SortKey], cuts: Sequence[CutPoint], kinds: Sequence[T.DataType] | None = None) -> Column:
    """Number of cut points that a row doesn't come before, by binary search.

    With ``kinds``, the keys' types, a row's keys are put into one struct that
    sorts as the keys do, if their types allow it: one comparison a step.
    """
    if not cuts:
        return F.lit(0)
    size = 1 << len(cuts).bit_length()  # cut points that are missing to a power of two: before none
    steps = F.lit([size >> (i + 1) for i in range(size.bit_length() - 1)])

    def search(table: Column, before: Callable[[Column], Column]) -> Column:
        def step_up(low: Column, step: Column) -> Column:
            cut = F.get(table, low + step - 1)
            return F.when(cut.isNull() | before(cut), low).otherwise(low + step)
        return F.aggregate(steps, F.lit(0), step_up)

    if kinds is not None and all(isinstance(t, T.IntegralType if k.descending else _PLAIN) for k, t in zip(keys, kinds, strict=True)):
        table = F.array(*[_sortable(keys, [F.lit(v).cast(t) for v, t in zip(c.values, kinds, strict=False)], kinds, c.length)
                          for c in cuts])
        own = _sortable(keys, [F.expr(k.expression) for k in keys], kinds, len(keys))
        return F.get(F.transform(F.array(own), lambda row: search(table, lambda cut: row < cut)), F.lit(0))
    table = F.array(*[F.struct(F.lit(c.length).alias("length"), *[F.lit(v).alias(f"c{i}") for i, v in enumerate(c.values)])
                      for c in cuts])
    return search(table, lambda cut: _before(keys, cut))


def _sortable(keys: Sequence[SortKey], values: Sequence[Column], kinds: Sequence[T.DataType], length: int) -> Column:
    """A struct whose own order (ascending, nulls first) is that of the first
    ``length`` keys; the others are null, i.e. before all."""
    fields = []
    for i, (key, kind) in enumerate(zip(keys, kinds, strict=True)):
        value = values[i] if i < length else F.lit(None).cast(kind)
        if not key.nulls_first:
            fields.append((value.isNull() if i < length else F.lit(None).cast("boolean")).alias(f"n{i}"))
        fields.append((F.bitwise_not(value) if key.descending else value).alias(f"k{i}"))
    return F.struct(*fields)


def _before(keys: Sequence[SortKey], cut: Column) -> Column:
    """Whether a row comes before the cut point; equal keys do not."""
    out = F.lit(False)
    for i, key in reversed(list(enumerate(keys))):
        mine, other = F.expr(key.expression), cut.getField(f"c{i}")
        smaller = (mine > other) if key.descending else (mine < other)
        by_value = F.when(mine.eqNullSafe(other), out).otherwise(smaller)
        nulls = F.when(mine.isNull() & other.isNotNull(), F.lit(key.nulls_first)).when(
            mine.isNotNull() & other.isNull(), F.lit(not key.nulls_first))
        out = F.when(cut.getField("length") <= i, F.lit(False)).otherwise(nulls.otherwise(by_value))
    return out
