"""Search domains against a plain evaluator of the same rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.domain import domain_filter

ROWS = [(i, t, n, b) for i, (t, n, b) in enumerate(
    (t, n, b) for t in (None, "", "pdf", "A.PDF", "50% off", "50_off") for n in (None, 0, 1, 7) for b in (None, True, False))]
SCHEMA = "id int, t string, n int, b boolean"


def like(text, pattern, fold):
    if text is None:
        return False
    import re
    regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(regex, text, re.DOTALL | (re.IGNORECASE if fold else 0)) is not None


def term(row, name, op, value):
    """Whether a term holds; missing values as the module says."""
    x = row[name]
    missing = value is None or value is False
    empty = x is None or (name == "b" and x is False)
    if op == "=?":
        return missing or term(row, name, "=", value)
    if op == "=":
        return empty if missing else x is not None and x == value
    if op == "in":
        return any(term(row, name, "=", v) for v in value)
    if op in ("<", "<=", ">", ">="):
        return x is not None and {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op]
    if op in ("like", "ilike"):
        return like(x, f"%{value}%", op == "ilike")
    if op in ("=like", "=ilike"):
        return like(x, value, op == "=ilike")
    return not term(row, name, {"!=": "="}.get(op, op.removeprefix("not ")), value)


OPPOSITE = {"<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def holds(row, domain):
    """Reads the list from its start, by recursion."""
    at = 0

    def part(negated):
        nonlocal at
        p = domain[at]
        at += 1
        if p == "!":
            return part(not negated)
        if p in ("&", "|"):
            a, b = part(negated), part(negated)
            return (a and b) if (p == "&") != negated else (a or b)
        name, op, value = p
        if negated and op in OPPOSITE:
            return term(row, name, OPPOSITE[op], value)
        return term(row, name, op, value) != negated
    out = True
    while at < len(domain):
        out = part(False) and out
    return out


values = {"n": st.sampled_from([0, 1, 5, None, False]), "t": st.sampled_from(["pdf", "", "50%", "_off", "A.pdf", None, False]),
          "b": st.sampled_from([True, False, None])}
terms = st.one_of(
    st.sampled_from("ntb").flatmap(lambda c: st.tuples(st.just(c), st.sampled_from(["=", "!=", "=?"]), values[c])),
    st.sampled_from("nt").flatmap(lambda c: st.tuples(st.just(c), st.sampled_from(["in", "not in"]), st.lists(values[c], max_size=3))),
    st.tuples(st.just("n"), st.sampled_from(["<", "<=", ">", ">="]), st.integers(-1, 8)),
    st.tuples(st.just("t"), st.sampled_from(["like", "not like", "ilike", "not ilike", "=like", "=ilike"]),
              st.sampled_from(["pdf", "50%", "5__off", "", "A%"])))
domains = st.lists(st.recursive(terms.map(lambda t: [t]), lambda d: st.one_of(
    d.map(lambda x: ["!", *x]), st.tuples(st.sampled_from("&|"), d, d).map(lambda x: [x[0], *x[1], *x[2]])), max_leaves=6),
    max_size=3).map(lambda ds: [p for d in ds for p in d])


@settings(max_examples=60, deadline=None)
@given(domains)
def test_equals_a_plain_evaluator(spark, domain):
    df = spark.createDataFrame(ROWS, SCHEMA)
    names = ("id", "t", "n", "b")
    want = [r[0] for r in ROWS if holds(dict(zip(names, r, strict=True)), domain)]
    assert sorted(r.id for r in df.filter(domain_filter(df, domain)).collect()) == want
    fails = ~domain_filter(df, domain)  # never unknown
    assert df.filter(fails).count() == len(ROWS) - len(want)


def test_errors(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for bad in (["&", ("n", "=", 1)], ["!"], [("x", "=", 1)], [("n", "~", 1)], ["or"], [("n", "=")]):
        with pytest.raises(ValueError):
            domain_filter(df, bad)


def test_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    plan = df.filter(domain_filter(df, [("n", ">", 3), ("t", "=", False)]))._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(t)" in plan.split("PushedFilters")[1] and F is not None
