"""Money arithmetic as native column expressions.

Amounts are decimals end to end; doubles appear only where the reports
themselves compute in floating point (the original-currency ratio, which is
a display value computed from two aggregated numbers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type of a converted line amount of the undelivered report: 22 integer
# digits, 6 decimals.
WORK = T.DecimalType(28, 6)
# Currency precisions that amounts can be rounded to, and a type that holds
# all of them: 26 integer digits, 12 decimals.  Values beyond 26 digits raise.
PRECISIONS = range(0, 13)
ROUNDED = T.DecimalType(38, 12)
# Whole-number arithmetic: a decimal of whole numbers, the integer digits that
# amounts and rates may have, sizes that a bigint and a whole number surely hold
# (tested in floating point), and the zeros that a bigint can end with.
_WHOLE = T.DecimalType(38, 0)
_AMOUNT_DIGITS, _RATE_DIGITS = 18, 12
_LONG_SIZE, _WHOLE_SIZE = 4e18, 1e37
_LONG_DIGITS = 18
# A type with more decimals than the first is read at the second, where a number
# has no more.
_MANY, _FEW = 10, 6


def _unsupported(precision: Column) -> Column:
    return F.raise_error(F.concat(F.lit("unsupported currency precision: "), precision.cast("string")))


def round_by_precision(value: Column, precision: Column,
                       precisions: Iterable[int] = PRECISIONS) -> Column:
    """``ROUND(value, precision)`` where ``precision`` is a column.

    Spark's ``round`` needs a constant scale, so the expression branches over
    the precisions a currency can have (0 to 12).  Decimal ``round`` is
    half-up on the magnitude, i.e. half away from zero for both signs.  A
    null precision gives null; a precision outside ``precisions`` raises
    rather than silently returning a wrong amount.  ``value`` is rounded at
    its own scale (no intermediate cast, so no double rounding); the result
    has type :data:`ROUNDED`.
    """
    expr = None
    for p in precisions:
        branch = F.round(value, p).cast(ROUNDED)
        expr = F.when(precision == p, branch) if expr is None else expr.when(precision == p, branch)
    return (expr.when(precision.isNull(), F.lit(None).cast(ROUNDED))
            .otherwise(_unsupported(precision).cast(ROUNDED)))


def rounds_to_nonzero(value: Column, precision: Column) -> Column:
    """``round_by_precision(value, precision) != 0`` as one comparison with half
    a unit of the last digit; null and an error as there."""
    half = F.get(_table(f"CAST({Decimal(5).scaleb(-p - 1):f}BD AS DECIMAL(14, 13))" for p in PRECISIONS), precision)
    return (F.when(precision.isNull(), F.lit(None).cast("boolean"))
            .when(~precision.between(min(PRECISIONS), max(PRECISIONS)), _unsupported(precision).cast("boolean"))
            .otherwise(F.abs(value) >= half))


def converted_amount(amount_currency: Column, rate: Column, fallback: Column) -> Column:
    """``amount_currency / rate`` when the rate is positive, else ``fallback``.

    The division only runs on the branch guarded by ``rate > 0`` (a null or
    non-positive rate takes the fallback), so ANSI mode never sees a zero
    divisor.
    """
    return F.when(rate > 0, amount_currency / rate).otherwise(fallback)


def scale_of(df: DataFrame, value: Column) -> int:
    """Decimals of an exact number's type; an error for a floating-point one."""
    kind = df.select(value.alias("value")).schema[0].dataType
    if isinstance(kind, T.DecimalType):
        return kind.scale
    if isinstance(kind, (T.IntegralType, T.NullType)):
        return 0
    raise TypeError(f"amounts and rates must be decimals or whole numbers, not {kind.simpleString()}")


def _power(digits: int) -> Column:
    return F.lit(10**digits).cast(T.DecimalType(digits + 1, 0))


def _table(values: Iterable[str]) -> Column:
    """An array of SQL literals, as one expression."""
    return F.expr(f"array({', '.join(values)})")


def _powers(exponent: Column) -> Column:
    """10 to a power from the data, 0 to 37, as a decimal."""
    return F.get(_table(f"CAST({10**i}BD AS DECIMAL(38, 0))" for i in range(38)), F.greatest(exponent, F.lit(0)))


def _long_powers(exponent: Column) -> Column:
    """10 to a power from the data, 0 to 18, as a bigint."""
    return F.get(_table(f"{10**i}L" for i in range(19)), F.greatest(exponent, F.lit(0)))


def _div(number: Column, by: Column) -> Column:
    """Whole quotient of two bigints, by cutting off the remainder."""
    return F.call_function("div", number, by)


def _whole(value: Column, digits: int, scale: int) -> Column:
    """``value * 10^scale`` as a whole number, for a decimal of that scale with
    ``digits`` integer digits.

    By nine decimals at a time: a product that Spark cuts at 38 digits then
    loses decimals that are zeros already.
    """
    while scale:
        step = min(scale, 9)
        digits, scale = min(digits + step, 38), scale - step
        value = (value * _power(step)).cast(T.DecimalType(min(digits + scale, 38), scale))
    return value.cast(_WHOLE)


def _digits_of(value: Column, digits: int, scale: int) -> tuple[Column, Column]:
    """A decimal as ``(whole number, decimals)``: of a type with many decimals,
    only as many as the value has (6, 12 or all)."""
    number, decimals = _whole(value, digits, scale), F.lit(scale)
    if scale > 9:
        for fewer in (12, 6):
            if fewer < scale:
                same = F.round(value, fewer) == value
                number = F.when(same, _whole(value.cast(T.DecimalType(digits + fewer, fewer)), digits, fewer)).otherwise(number)
                decimals = F.when(same, F.lit(fewer)).otherwise(decimals)
    return number, decimals


def _zeros(number: Column, decimals: Column) -> Column:
    """Decimals at the end of a bigint that are zeros and can be cut off."""
    digits = number.cast("string")
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    return F.least(decimals, F.when(number == 0, F.lit(_LONG_DIGITS)).otherwise(zeros))


def _rest(number: Column, by: Column) -> Column:
    return (number % by).cast(_WHOLE)


def _quotient(number: Column, rest: Column, by: Column) -> Column:
    """``number / by`` without the remainder ``rest``: an exact division."""
    return ((number - rest).cast(_WHOLE) / by).cast(_WHOLE)


def with_converted(df: DataFrame, name: str, amount_currency: Column, rate: Column, balance: Column,
                   settled: Column, factor: Column, precision: Column) -> DataFrame:
    """Add ``ROUND((amount_currency / rate - settled) * factor, precision)``
    as ``name``, exactly: one rounding, half away from zero, of the true
    quotient.

    With a null or non-positive ``rate``, ``balance`` stands for the quotient.
    All inputs are decimals or whole numbers, taken at the decimals of their
    types: amounts with up to 18 integer digits, rates and factors with 12.

    Everything is counted in whole numbers: with amounts A, S of ``m``
    decimals, a rate R of ``i`` and a factor K of ``j``, the value is
    (A * 10^i - S * R) * K / (R * 10^(m + j)).  Where both sides of the
    fraction fit 38 digits and the result a bigint, which is tested beforehand
    in floating point, one whole division rounds it.  The other rows go step
    by step with remainders (:func:`_stepwise_size`).  That is a function of one
    struct, so its code is not part of the generated method that runs all
    rows: a method of more than 8,000 bytes is never compiled by the JVM.

    The result has type :data:`ROUNDED`; null where an input is null, an error
    where a number doesn't fit 38 digits or for a precision outside
    :data:`PRECISIONS`.
    """
    made: list[str] = []

    def put(frame: DataFrame, **columns: Column) -> DataFrame:
        made.extend(f"__{name}_{c}" for c in columns)
        return frame.withColumns({f"__{name}_{c}": v for c, v in columns.items()})

    def c(short: str) -> Column:
        return F.col(f"__{name}_{short}")

    usable = rate > 0
    given = {"a": (F.when(usable, amount_currency).otherwise(balance),
                   max(scale_of(df, amount_currency), scale_of(df, balance)), _AMOUNT_DIGITS),
             "s": (settled, scale_of(df, settled), _AMOUNT_DIGITS),
             "r": (F.when(usable, rate).otherwise(F.lit(1)), scale_of(df, rate), _RATE_DIGITS),
             "k": (factor, scale_of(df, factor), _RATE_DIGITS)}
    out = put(df, **{x: v.cast(T.DecimalType(digits + scale, scale)) for x, (v, scale, digits) in given.items()})
    sizes = {x: (scale, digits) for x, (_, scale, digits) in given.items()}
    fits, top, bottom = _fraction(c, sizes, precision)
    out = put(out, fits=fits)
    out = put(out, top=F.when(c("fits"), top), bottom=F.when(c("fits"), bottom))
    half = F.when(c("top") < 0, -c("bottom")).otherwise(c("bottom"))
    units = _div((c("top") + c("top") + half).cast(_WHOLE), (c("bottom") + c("bottom")).cast(_WHOLE))
    unit = F.get(_table(f"CAST({Decimal(1).scaleb(-i):f}BD AS DECIMAL(13, 12))" for i in PRECISIONS), precision)
    size = _stepwise_size(F.struct(*[c(x).alias(x) for x in given], precision.alias("p")), sizes)
    lost = F.raise_error(F.lit("converted amount: a number has more than 38 digits")).cast(ROUNDED)
    given_all = reduce(Column.__and__, [c(x).isNotNull() for x in given])
    value = (F.when(precision.isNull() | ~given_all, F.lit(None).cast(ROUNDED))
             .when(~precision.between(min(PRECISIONS), max(PRECISIONS)), _unsupported(precision).cast(ROUNDED))
             .when(c("fits"), (units.cast(T.DecimalType(19, 0)) * unit).cast(ROUNDED))
             .otherwise(F.coalesce(size, lost)))
    return out.withColumn(name, value.cast(ROUNDED)).drop(*made)


def _fraction(c, sizes: dict[str, tuple[int, int]], precision: Column) -> tuple[Column, Column, Column]:
    """``fits``: whether a row can do with one division; then, the numerator
    and denominator of the result in units of its last digit.

    Of a type with many decimals only ``_FEW`` are taken here; a number with
    more doesn't fit.
    """
    few = {x: scale if scale <= _MANY else _FEW for x, (scale, _) in sizes.items()}
    m = max(few["a"], few["s"])
    places = m + few["k"]
    more, less = [max(p - places, 0) for p in PRECISIONS], [max(places - p, 0) for p in PRECISIONS]

    def number(x: str) -> Column:
        digits = sizes[x][1]
        return _whole(c(x).cast(T.DecimalType(digits + few[x], few[x])), digits, few[x])

    def by_precision(powers: list[int]) -> Column:
        return F.get(_table(f"CAST({10**i}BD AS DECIMAL(38, 0))" for i in powers), precision)

    def size(x: str) -> Column:
        return F.abs(c(x).cast("double"))

    def sizes_of(powers: list[int]) -> Column:
        return F.get(_table(f"1e{i}D" for i in powers), precision)

    top_size = (size("a") + size("s") * size("r")) * float(10**(m + few["r"]))
    fits = ((top_size * (size("k") * float(10**few["k"]) + 1) * sizes_of(more) < _WHOLE_SIZE)
            & (size("r") * float(10**few["r"]) * sizes_of(less) < _WHOLE_SIZE)
            & ((size("a") / size("r") + size("s")) * size("k") * sizes_of(list(PRECISIONS)) < _LONG_SIZE))
    for x, (scale, _) in sizes.items():
        if few[x] < scale:
            fits = fits & (F.round(c(x), few[x]) == c(x))

    amount = (number("a") * _power(m - few["a"] + few["r"])).cast(_WHOLE)
    paid = ((number("s") * _power(m - few["s"])).cast(_WHOLE) * number("r")).cast(_WHOLE)
    top = (((amount - paid).cast(_WHOLE) * number("k")).cast(_WHOLE) * by_precision(more)).cast(_WHOLE)
    return F.coalesce(fits, F.lit(False)), top, (number("r") * by_precision(less)).cast(_WHOLE)


def _stepwise(start: Column, steps: Iterable[Callable[[Column], dict[str, Column]]]) -> Column:
    """A struct with the fields that steps add to it, each from those before,
    computed once a step."""
    def add(step: Callable[[Column], dict[str, Column]]) -> Callable[[Column], Column]:
        def run(row: Column) -> Column:
            new = step(row)
            return reduce(lambda r, field: r.withField(field, new[field]), new, row)
        return run

    state = F.array(start)
    for step in steps:
        state = F.transform(state, add(step))
    return F.get(state, F.lit(0))


def _stepwise_size(start: Column, sizes: dict[str, tuple[int, int]]) -> Column:
    """The converted amount of numbers of any size that 38 digits hold, null
    beyond: divided step by step with remainders, after the zeros at the end of
    each number are cut off, so the sizes follow the data, not the types."""
    most = max(PRECISIONS)
    part = T.DecimalType(37, most)

    def digits(r: Column) -> dict[str, Column]:
        found = {x: _digits_of(r[x], whole, scale) for x, (scale, whole) in sizes.items()}
        return {**{f"{x}w": w for x, (w, _) in found.items()}, **{f"{x}t": t for x, (_, t) in found.items()}}

    def signed(r: Column) -> Column:
        paid = ((r["sn"] * _powers(r["up_s"])).cast(_WHOLE) * r["rn"]).cast(_WHOLE)
        return ((r["an"] * _powers(r["up_a"])).cast(_WHOLE) - paid).cast(_WHOLE)

    def units(r: Column) -> Column:
        whole = _quotient(r["num"], r["over"], r["by"])
        up = F.when(r["over"] >= (r["by"] - r["over"]), F.lit(1)).otherwise(F.lit(0))
        exact = (r["n"] * _powers(r["more"])).cast(_WHOLE)
        return (F.when(r["less"] == 0, exact + whole).otherwise(whole) + up).cast(_WHOLE)

    def value(r: Column) -> Column:
        fraction = (r["frac"].cast(T.DecimalType(most, 0)) * _powers(F.lit(most) - r["p"]).cast(
            T.DecimalType(most + 1, 0))).cast(T.DecimalType(most, 0))
        size = (_quotient(r["units"], r["frac"], r["unit"]).cast(part)
                + (fraction * F.lit(Decimal(1).scaleb(-most))).cast(part)).cast(ROUNDED)
        return F.when((r["signed"] < 0) != (r["kn"] < 0), -size).otherwise(size)

    end = _stepwise(start, [
        digits,
        lambda r: {f"{x}u": r[f"{x}w"].try_cast("bigint") for x in sizes},
        lambda r: {f"{x}z": F.coalesce(_zeros(r[f"{x}u"], r[f"{x}t"]), F.lit(0)) for x in sizes},
        # each number without its zeros, and its decimals
        lambda r: {**{f"{x}n": F.coalesce(_div(r[f"{x}u"], _long_powers(r[f"{x}z"])).cast(_WHOLE), r[f"{x}w"]) for x in sizes},
                   **{f"{x}d": r[f"{x}t"] - r[f"{x}z"] for x in sizes}},
        lambda r: {"m": F.greatest(r["ad"], r["sd"])},
        lambda r: {"up_a": r["m"] - r["ad"] + r["rd"], "up_s": r["m"] - r["sd"], "places": r["m"] + r["kd"]},
        lambda r: {"more": F.greatest(r["p"] - r["places"], F.lit(0)), "less": F.greatest(r["places"] - r["p"], F.lit(0)),
                   "signed": signed(r)},
        lambda r: {"rest": _rest(F.abs(r["signed"]), r["rn"])},
        lambda r: {"prod": (r["rest"] * F.abs(r["kn"])).cast(_WHOLE)},
        lambda r: {"low": _rest(r["prod"], r["rn"])},
        lambda r: {"n": ((_quotient(F.abs(r["signed"]), r["rest"], r["rn"]) * F.abs(r["kn"])).cast(_WHOLE)
                         + _quotient(r["prod"], r["low"], r["rn"])).cast(_WHOLE)},
        # fewer decimals than the numbers have: n over a power of ten (what is
        # below a multiple can't tip an even power); else more digits of low / R
        lambda r: {"num": F.when(r["less"] == 0, (r["low"] * _powers(r["more"])).cast(_WHOLE)).otherwise(r["n"]),
                   "by": F.when(r["less"] == 0, r["rn"]).otherwise(_powers(r["less"]))},
        lambda r: {"over": _rest(r["num"], r["by"])},
        lambda r: {"units": units(r), "unit": _powers(r["p"])},
        lambda r: {"frac": _rest(r["units"], r["unit"])},
        lambda r: {"value": value(r)},
    ])
    return end["value"]


def ratio_or_one(numerator: Column, rate: Column) -> Column:
    """``numerator / (rate or 1)`` in floating point.

    A null **or zero** rate counts as 1; a negative rate is used as is.  This
    is the report's display ratio of two aggregated values, computed in
    double precision like the report's own getter.
    """
    divisor = F.coalesce(F.nullif(rate, F.lit(0)), F.lit(1))
    return numerator.cast("double") / divisor.cast("double")
