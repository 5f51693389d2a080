"""Search domains: a filter written as a list in prefix notation.

A domain is a list of terms ``(column, operator, value)`` and the operators
``"&"`` and ``"|"`` (of the two parts that follow) and ``"!"`` (of the one that
follows).  Parts that no operator takes hold together.  The empty domain holds
for every row.

    ["|", ("kind", "=", "pdf"), "&", ("size", ">", 10), ("owner", "=", False)]

Operators: ``=``, ``!=``, ``<``, ``<=``, ``>``, ``>=``, ``in``, ``not in``,
``like``, ``not like``, ``ilike``, ``not ilike`` (the value anywhere, ``%`` and
``_`` as in SQL), ``=like``, ``=ilike`` (the whole text) and ``=?`` (``=``, or
anything where the value is missing).

Missing values are two-valued, not SQL's unknown: a missing value (``None`` or
``False``) equals a null and, in a boolean column, false; a row with a null
differs from every value, is in no list (unless that holds a missing value) and
outside every list; it is neither smaller nor larger than anything.  ``!`` turns
the operators of its part into their opposites.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Domain = Sequence

_OPPOSITE = {"=": "!=", "in": "not in", "<": ">=", ">": "<=", "like": "not like", "ilike": "not ilike",
             "=like": "not =like", "=ilike": "not =ilike"}
_OPPOSITE |= {b: a for a, b in _OPPOSITE.items()}
_ORDERED: dict[str, Callable[[Column, object], Column]] = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}
_JOINED = {"&": Column.__and__, "|": Column.__or__}


def domain_filter(df: DataFrame, domain: Domain) -> Column:
    """The filter that a domain stands for, over the columns of ``df``.

    Read from its end, every part is a condition on a stack; an operator takes
    the ones on top.  A condition is kept with its opposite, so ``!`` is a swap.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stack: list[tuple[Column, Column]] = []

    def take() -> tuple[Column, Column]:
        if not stack:
            raise ValueError("domain: an operator lacks a part")
        return stack.pop()

    for part in reversed(list(domain)):
        if part in ("&", "|"):
            (left, not_left), (right, not_right) = take(), take()
            other = "|" if part == "&" else "&"
            stack.append((_JOINED[part](left, right), _JOINED[other](not_left, not_right)))
        elif part == "!":
            holds, fails = take()
            stack.append((fails, holds))
        elif isinstance(part, (tuple, list)) and len(part) == 3:
            name, operator, value = part
            if name not in kinds:
                raise ValueError(f"domain: no column {name!r}; columns: {sorted(kinds)}")
            stack.append(_term(F.col(f"`{name}`"), kinds[name], operator, value))
        else:
            raise ValueError(f"domain: neither a term nor an operator: {part!r}")
    return reduce(Column.__and__, [holds for holds, _ in reversed(stack)], F.lit(True))


def _missing(value: object) -> bool:
    return value is None or value is False


def _term(column: Column, kind: T.DataType, operator: str, value: object) -> tuple[Column, Column]:
    """A term's condition and its opposite; neither is ever null."""
    if operator == "=?":
        return (F.lit(True), F.lit(False)) if _missing(value) else _term(column, kind, "=", value)
    if operator not in _OPPOSITE:
        raise ValueError(f"domain: unknown operator {operator!r}; known: {sorted({*_OPPOSITE, '=?'})}")
    return _condition(column, kind, operator, value), _condition(column, kind, _OPPOSITE[operator], value)


def _condition(column: Column, kind: T.DataType, operator: str, value: object) -> Column:
    if operator.removeprefix("not ") != operator:
        return ~_condition(column, kind, operator.removeprefix("not "), value)
    if operator == "!=":
        return ~_condition(column, kind, "=", value)
    if operator == "in":
        values = list(value)
        found = [v for v in values if not _missing(v)]
        listed = F.coalesce(column.isin(found), F.lit(False)) if found else F.lit(False)
        return listed | _is_missing(column, kind) if len(found) < len(values) else listed
    if operator == "=":
        return _is_missing(column, kind) if _missing(value) else F.coalesce(column == F.lit(value), F.lit(False))
    if operator in _ORDERED:
        return F.coalesce(_ORDERED[operator](column, F.lit(value)), F.lit(False))
    pattern = str(value) if operator.startswith("=") else f"%{value}%"
    match = column.ilike(pattern) if operator.endswith("ilike") else column.like(pattern)
    return F.coalesce(match, F.lit(False))


def _is_missing(column: Column, kind: T.DataType) -> Column:
    return ~F.coalesce(column, F.lit(False)) if isinstance(kind, T.BooleanType) else column.isNull()
