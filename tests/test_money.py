"""Rounding to a precision taken from the data, against Python's decimal."""

from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.functions.money import ROUNDED, ratio_or_one, round_by_precision, rounds_to_nonzero, with_converted
from harness import LONGEST_METHOD, longest_method

values = st.integers(-10**13, 10**13).map(lambda n: Decimal(n).scaleb(-8))
cases = st.lists(st.tuples(values, st.integers(0, 12)), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None)
@given(cases)
def test_round_by_precision_matches_half_away_from_zero(spark, rows):
    df = spark.createDataFrame(rows, "v decimal(30,8), p int")
    got = [r.r for r in df.select(round_by_precision(F.col("v"), F.col("p")).alias("r")).collect()]
    want = [v.quantize(Decimal(1).scaleb(-p), rounding=ROUND_HALF_UP) for v, p in rows]
    assert got == want
    assert df.select(round_by_precision(F.col("v"), F.col("p")).alias("r")).schema[0].dataType == ROUNDED


def test_rounds_to_nonzero_is_rounding_compared_with_zero(spark):
    halves = [Decimal(n).scaleb(-d) for d in range(0, 15) for n in (-51, -50, -49, -5, -4, 0, 4, 5, 49, 50, 51)]
    rows = [(v, p) for v in [*halves, None] for p in [*range(0, 13), None]]
    df = spark.createDataFrame(rows, "v decimal(36,14), p int")
    both = df.select("v", "p", rounds_to_nonzero(F.col("v"), F.col("p")).alias("one"),
                     (round_by_precision(F.col("v"), F.col("p")) != 0).alias("two")).collect()
    assert [r.one for r in both] == [r.two for r in both] and {r.one for r in both} == {True, False, None}
    with pytest.raises(PySparkException):
        df.select(rounds_to_nonzero(F.col("v"), F.lit(13))).collect()
    with pytest.raises(PySparkException):
        df.select(rounds_to_nonzero(F.col("v"), F.lit(-1))).collect()


def test_round_by_precision_null_and_unsupported(spark):
    df = spark.createDataFrame([(Decimal("1.25"), None)], "v decimal(10,2), p int")
    assert df.select(round_by_precision(F.col("v"), F.col("p"))).first()[0] is None
    bad = spark.createDataFrame([(Decimal("1.25"), 13)], "v decimal(10,2), p int")
    with pytest.raises(PySparkException):
        bad.select(round_by_precision(F.col("v"), F.col("p"))).collect()


def test_ratio_or_one(spark):
    df = spark.createDataFrame([(Decimal("10"), Decimal("0.5")), (Decimal("10"), Decimal("0")),
                                (Decimal("10"), None), (Decimal("10"), Decimal("-2"))],
                               "a decimal(18,2), r decimal(18,6)")
    got = [x[0] for x in df.select(ratio_or_one(F.col("a"), F.col("r"))).collect()]
    assert got == [20.0, 10.0, 10.0, -5.0]


def exact(amount, rate, balance, settled, factor, precision):
    """The converted amount as a fraction, rounded once, half away from zero."""
    base = Fraction(amount) / Fraction(rate) if rate is not None and rate > 0 else Fraction(balance)
    units = (base - Fraction(settled)) * Fraction(factor) * 10**precision
    whole = (2 * abs(units.numerator) + units.denominator) // (2 * units.denominator)
    return Decimal(whole if units >= 0 else -whole).scaleb(-precision)


money = st.integers(-10**9, 10**9).map(lambda n: Decimal(n).scaleb(-2))
rates = st.one_of(st.none(), st.sampled_from([Decimal(x) for x in ("0", "-1", "0.3", "0.7", "6.000001", "1", "0.000001")]),
                  st.integers(1, 10**8).map(lambda n: Decimal(n).scaleb(-6)))
factors = st.one_of(st.integers(-10**9, 10**9).map(lambda n: Decimal(n).scaleb(-6)),
                    st.sampled_from([Decimal("1500000"), Decimal("25000"), Decimal("1")]))
amounts = st.lists(st.tuples(money, rates, money, money, factors, st.integers(0, 12)), min_size=1, max_size=60)


@settings(max_examples=10, deadline=None)
@given(amounts)
def test_whole_amount_is_exact(spark, rows):
    df = spark.createDataFrame(rows, "a decimal(18,2), r decimal(18,6), b decimal(18,2), s decimal(38,2), f decimal(18,6), p int")
    got = with_converted(df, "v", *[F.col(c) for c in "arbsfp"])
    assert got.columns == [*"arbsfp", "v"] and got.schema["v"].dataType == ROUNDED
    assert [r.v for r in got.collect()] == [exact(*r) for r in rows]


def test_ties_and_nulls_of_the_whole_amount(spark):
    rows = [("0.05", "1", "0", "0", "0.1", 2), ("-0.05", "1", "0", "0", "0.1", 2), ("1", "8", "0", "0", "1", 2),
            ("1", "3", "0", "0.33", "1", 8), ("1", "2000000", "0", "0", "0.000001", 12), ("1", None, "7", "2", "1", None)]
    rows = [tuple(Decimal(x) if isinstance(x, str) else x for x in r) for r in rows]
    df = spark.createDataFrame(rows, "a decimal(18,2), r decimal(18,6), b decimal(18,2), s decimal(20,2), f decimal(18,6), p int")
    got = [r.v for r in with_converted(df, "v", *[F.col(c) for c in "arbsfp"]).collect()]
    assert got == [Decimal("0.01"), Decimal("-0.01"), Decimal("0.13"), Decimal("0.00333333"), Decimal("0.000000000001"), None]
    with pytest.raises(PySparkException):
        with_converted(df.withColumn("p", F.lit(13)), "v", *[F.col(c) for c in "arbsfp"]).collect()


def wide(n, digits):
    return st.integers(-10**n, 10**n).map(lambda x: Decimal(x).scaleb(-digits))


def ratios(digits):
    return st.one_of(st.none(), st.sampled_from([Decimal("0"), Decimal("-1"), Decimal("0.3"), Decimal(1).scaleb(-digits)]),
                     st.integers(1, digits + 3).flatmap(lambda n: st.integers(1, 10**n)).map(lambda x: Decimal(x).scaleb(-digits)))


SCALES = {
    (3, 10, 8): "a decimal(18,3), r decimal(22,10), b decimal(18,3), s decimal(38,3), f decimal(20,8), p int",
    (4, 12, 12): "a decimal(38,18), r decimal(38,18), b decimal(38,18), s decimal(38,18), f decimal(38,18), p int",
    (0, 0, 0): "a bigint, r int, b int, s bigint, f int, p int",
}


@pytest.mark.parametrize("scales", sorted(SCALES))
@settings(max_examples=5, deadline=None, phases=(Phase.generate,))
@given(data=st.data())
def test_amounts_at_the_scales_of_their_types(spark, scales, data):
    """Three decimals and ten of a rate, decimal(38,18) columns, whole numbers."""
    sa, sr, sk = scales
    rows = data.draw(st.lists(st.tuples(wide(9, sa), ratios(sr), wide(9, sa), wide(8, sa), wide(sk + 4, sk), st.integers(0, 12)),
                              min_size=20, max_size=60))
    if scales == (0, 0, 0):
        rows = [tuple(None if v is None else int(v) for v in r) for r in rows]
    df = spark.createDataFrame(rows, SCALES[scales])
    got = [r.v for r in with_converted(df, "v", *[F.col(c) for c in "arbsfp"]).collect()]
    with localcontext() as context:
        context.prec = 60
        assert got == [exact(*r) for r in rows]


def test_amounts_and_rates_are_not_cut(spark):
    rows = [("1", None, "1.235", "0", "1", 3), ("100", "0.1234567", "0", "0", "1", 6), ("100", "0.0000004", "0", "0", "1", 2),
            ("0.001", "1", "0", "0", "0.0000001", 10), ("99999999999.999", "0.0000001", "0", "0", "0.0000001", 3)]
    df = spark.createDataFrame([tuple(Decimal(x) if isinstance(x, str) else x for x in r) for r in rows],
                               "a decimal(18,3), r decimal(18,7), b decimal(18,3), s decimal(18,3), f decimal(18,7), p int")
    got = [r.v for r in with_converted(df, "v", *[F.col(c) for c in "arbsfp"]).collect()]
    assert got == [Decimal(x) for x in ("1.235", "810.000591", "250000000", "0.0000000001", "99999999999.999")]


def test_numbers_that_do_not_fit_are_an_error(spark):
    big = Decimal(10) ** 17
    df = spark.createDataFrame([(big, Decimal(1).scaleb(-12), big, Decimal(0), Decimal(10) ** 11, 12)],
                               "a decimal(18,0), r decimal(24,12), b decimal(18,0), s decimal(18,0), f decimal(24,12), p int")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(PySparkException):
                with_converted(df, "v", *[F.col(c) for c in "arbsfp"]).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    with pytest.raises(TypeError):
        with_converted(df.withColumn("r", F.lit(0.5)), "v", *[F.col(c) for c in "arbsfp"])


def test_generated_code_of_the_conversion_can_be_compiled(spark):
    df = spark.range(10).selectExpr(
        "cast(id as decimal(18,2)) as a", "cast(id as decimal(18,6)) as r", "cast(id as decimal(18,2)) as b",
        "cast(id as decimal(38,2)) as s", "cast(1 as decimal(18,6)) as f", "cast(id % 4 as int) as p")
    out = with_converted(df, "v", *[F.col(c) for c in "arbsfp"])
    assert longest_method(out) <= LONGEST_METHOD
    assert out.count() == 10


def test_numbers_at_the_edge_of_one_division(spark):
    """Results beyond a bigint, fractions beyond 38 digits and numbers with more
    decimals than are read at first take the steps; the sign and ties hold."""
    rows = [("100000", "0.0000004", "0", "0", "1234.5", 11), ("-100000", "0.0000004", "0", "0", "1234.5", 11),
            ("-100000", "0.0000004", "0", "0", "-1234.5", 11), ("922337203685.47", "1", "0", "0", "10", 6),
            ("-922337203685.47", "1", "0", "0", "10", 6), ("0.1234567891234", "1", "0", "0", "1", 12),
            ("-0.0000005", "1", "0", "0", "1", 6), ("0", "1", "0", "0.0000005", "1", 6),
            ("0.0000004999999", "1", "0", "0", "1", 6), ("0", None, "0", "0", "0", 0), ("5", None, "5", "5.5", "-1", 0)]
    rows = [tuple(Decimal(x) if isinstance(x, str) else x for x in r) for r in rows]
    df = spark.createDataFrame(rows, "a decimal(36,18), r decimal(24,12), b decimal(36,18), s decimal(36,18), f decimal(24,12), p int")
    got = [r.v for r in with_converted(df, "v", *[F.col(c) for c in "arbsfp"]).collect()]
    with localcontext() as context:
        context.prec = 60
        assert got == [exact(*r) for r in rows]
