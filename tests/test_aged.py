"""Ageing report traps, on hand-made rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.plans.aged import aged_by_partner, aged_lines, aged_report
from ledgerlens.sources.fixtures import ACCOUNT_ROWS, CURRENCY_ROWS, JOURNAL_ROWS
from ledgerlens.sources.inline import PERIOD_TABLE_SCHEMA, period_rows
from harness import LONGEST_METHOD, longest_method
from micro import day, line, move, partial, rate, tables, trust

D = dt.date(2000, 1, 31)
CT = [(1, "1", 2)]


def base(spark, lines, partials=(), moves=None, rates=None, props=(), partners=None, **kw):
    return tables(
        spark,
        account_move_line=lines,
        account_move=moves or [move(1)],
        account_partial_reconcile=list(partials),
        account_journal=JOURNAL_ROWS,
        account_account=ACCOUNT_ROWS,
        res_currency=CURRENCY_ROWS,
        res_currency_rate=rates or [rate(1, 0, "1995-01-01", "1")],
        res_partner=partners or [{"id": 10, "name": "A"}, {"id": 11, "name": "B"}],
        ir_property=list(props),
        **kw,
    )


def rows_by_id(df):
    return {r["id"]: r for r in df.collect()}


def amount(r):
    return sum(r[f"period{i}"] for i in range(6))


def test_filters(spark):
    t = base(spark, [
        line(1), line(2, partner_id=None), line(3, account_id=1), line(4, account_id=2),
        line(5, account_id=3), line(6, company_id=9),
    ])
    got = rows_by_id(aged_lines(t, D, "receivable", CT))
    assert set(got) == {1, 3}  # no partner, excluded, other kind, unknown company drop
    pay = rows_by_id(aged_lines(t, D, "payable", CT))
    assert set(pay) == {5}
    assert amount(pay[5]) == Decimal("-100")  # sign -1 outside the rounding


def test_settlement_cutoff_and_fanout(spark):
    t = base(spark, [line(1), line(2), line(3), line(4)], partials=[
        partial(debit=1, amount=100, max_date="2000-01-15"),   # fully settled
        partial(debit=2, amount=100, max_date="2000-02-15"),   # after date_to
        partial(debit=3, amount=100, max_date=None),           # no date
        partial(debit=4, amount=10), partial(debit=4, amount=20),
        partial(credit=4, amount=5), partial(credit=4, amount=5), partial(credit=4, amount=5),
    ])
    got = rows_by_id(aged_lines(t, D, "receivable", CT))
    assert set(got) == {2, 3, 4}
    assert amount(got[2]) == Decimal("100")
    # 2 debit rows x 3 credit rows: 100 - 30*3 + 15*2
    assert amount(got[4]) == Decimal("40")


def test_period_bounds_inclusive(spark):
    dates = {1: "2000-01-31", 2: "2000-01-30", 3: "2000-01-01", 4: "1999-12-31",
             5: "1999-10-03", 6: "1999-10-02"}
    lines = [line(i, date_maturity=d) for i, d in dates.items()]
    lines.append(line(7, date="2000-02-10", date_maturity=None))
    got = rows_by_id(aged_lines(base(spark, lines), D, "receivable", CT))
    bucket = {i: next(k for k in range(6) if r[f"period{k}"] != 0) for i, r in got.items()}
    assert bucket == {1: 0, 2: 1, 3: 1, 4: 2, 5: 4, 6: 5, 7: 0}
    assert str(got[7]["report_date"]) == "2000-02-10"


def test_overlapping_periods_give_two_rows(spark):
    periods = spark.createDataFrame(
        [(None, day("2000-01-01"), 0), (day("2000-01-31"), None, 1)], PERIOD_TABLE_SCHEMA)
    df = aged_lines(base(spark, [line(1, date_maturity="2000-01-15")]), D, "receivable", CT,
                    periods=periods)
    rows = df.collect()
    assert len(rows) == 2
    assert sorted((r.period0, r.period1) for r in rows) == [(0, 100), (100, 0)]


def test_rounding_precision_from_data(spark):
    ct = [(1, "1", 0), (2, "0.5", 2), (3, "0.1", 0)]
    t = base(spark, [
        line(1, company_id=1, balance="2.50"), line(2, company_id=1, balance="-2.50"),
        line(3, company_id=2, balance="0.25"), line(4, company_id=1, balance="0.40"),
        line(5, company_id=3, balance="1"),
    ])
    got = rows_by_id(aged_lines(t, D, "receivable", ct))
    assert amount(got[1]) == 3 and amount(got[2]) == -3      # half away from zero
    assert amount(got[3]) == Decimal("0.13")                  # 0.125 -> 0.13
    assert 4 not in got                                       # rounds to 0: settled
    assert amount(got[5]) == 0                                # listed, shows 0


def test_document_rate_conversion(spark):
    rates = [rate(1, 0, "1995-01-01", "1"), rate(5, 3, "2001-01-01", "0.1"),
             rate(6, 3, None, "0.125"), rate(11, 6, "2000-01-01", "0")]
    t = base(spark, [line(1, move_id=1, balance=999, amount_currency=10),
                     line(2, move_id=2, balance=999, amount_currency=10),
                     line(3, move_id=3, balance=999, amount_currency=10)],
             moves=[move(1, currency_id=3), move(2, currency_id=6), move(3, currency_id=7)],
             rates=rates)
    got = rows_by_id(aged_lines(t, D, "receivable", CT))
    assert amount(got[1]) == 80            # null-dated rate 0.125 wins
    assert got[1]["currency_rate"] == Decimal("0.125")
    assert amount(got[2]) == 999           # rate 0 -> balance
    assert amount(got[3]) == 999 and got[3]["currency_rate"] is None


def test_trust_rows(spark):
    props = [trust(1, 10, 1, "good"), trust(2, 10, 1, "bad"), trust(3, 11, 2, "bad"),
             {"id": 4, "name": "trust", "res_id": "res.partner,011", "company_id": 1,
              "value_text": "bad"}]
    t = base(spark, [line(1, partner_id=10), line(2, partner_id=11)], props=props)
    rows = aged_lines(t, D, "receivable", CT).collect()
    assert sorted(r.partner_trust for r in rows if r.id == 1) == ["bad", "good"]
    assert [r.partner_trust for r in rows if r.id == 2] == ["normal"]


def test_by_partner_ratio_of_aggregates(spark):
    rates = [rate(1, 0, "1995-01-01", "1"), rate(2, 1, "1999-01-01", "0.5"),
             rate(11, 6, "2000-01-01", "0")]
    t = base(spark, [line(1, move_id=1, amount_currency=10), line(2, move_id=1, amount_currency=30),
                     line(3, move_id=2, partner_id=11, amount_currency=7)],
             moves=[move(1, currency_id=1, amount_residual=5), move(2, currency_id=6)],
             rates=rates)
    got = {r.partner_id: r for r in aged_by_partner(t, D, "receivable", CT).collect()}
    assert got[10].original_currency_amount == 80.0        # 40 / 0.5
    assert got[10].amount_residual == Decimal("10")         # header value once per line
    assert got[11].original_currency_amount == 7.0          # rate 0 counts as 1
    assert got[10].report_date is None and got[10].move_name is None


def test_period_rows_default():
    rows = period_rows(dt.date(1999, 12, 31))
    assert rows[0] == (None, dt.date(1999, 12, 31), 0)
    assert rows[1] == (dt.date(1999, 12, 30), dt.date(1999, 12, 1), 1)
    assert rows[4] == (dt.date(1999, 10, 1), dt.date(1999, 9, 2), 4)
    assert rows[5] == (dt.date(1999, 9, 1), None, 5)


def test_payable_uses_rate_path(spark):
    t = base(spark, [line(1, account_id=3, balance=50)])
    df = aged_lines(t, D, "payable", CT)
    assert df.agg(F.sum("period1")).first()[0] == Decimal("-50")


def test_parameter_relations_as_dataframes(spark):
    from ledgerlens.sources.inline import CURRENCY_TABLE_SCHEMA, currency_table, period_table
    import pytest
    t = base(spark, [line(1, balance="2.50", company_id=2), line(2, date_maturity="1999-12-31")])
    ct_rows = [(1, "1", 2), (2, "2", 0)]
    from_rows = sorted(map(tuple, aged_lines(t, D, "receivable", ct_rows).collect()))
    ct_df = currency_table(spark, ct_rows)
    from_df = sorted(map(tuple, aged_lines(t, D, "receivable", ct_df,
                                           periods=period_table(spark, D)).collect()))
    assert from_rows == from_df
    dup = spark.createDataFrame([(1, dec_("1"), 2), (1, dec_("2"), 2)], CURRENCY_TABLE_SCHEMA)
    with pytest.raises(ValueError):
        aged_lines(t, D, "receivable", dup)
    with pytest.raises(ValueError):
        currency_table(spark, [(1, "1", 2), (1, "2", 2)])
    bad_periods = spark.createDataFrame([(None, None, 0), (None, None, 0)], PERIOD_TABLE_SCHEMA)
    with pytest.raises(ValueError):
        aged_lines(t, D, "receivable", ct_rows, periods=bad_periods)


def dec_(x):
    return Decimal(x)


def test_line_table_with_the_names_of_joined_columns(spark):
    """The header's values win; the report is the same as without."""
    rows = [line(1, balance=70), line(2, partner_id=11, balance=30)]
    props = [trust(1, 10, 1, "bad")]
    t = base(spark, rows, moves=[move(1, amount_residual=55)], props=props)
    plain = t["account_move_line"]
    clash = plain
    for name in ("amount_residual", "move_name", "move_type", "account_code", "currency_rate", "account_name", "order_no",
                 "partner_name", "partner_trust", "report_date", "move_ref", "report_currency_id", "period0",
                 "trust_value", "rate", "precision", "line_id"):
        clash = clash.withColumn(name, F.lit("own"))
    clash = clash.withColumn("period_index", F.lit(99))
    want = aged_lines(t, D, "receivable", CT)
    got = aged_lines(t.with_tables(account_move_line=clash), D, "receivable", CT)
    assert {r["period_index"] for r in got.collect()} == {99} and {r["rate"] for r in got.collect()} == {"own"}
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_amounts_of_quotients_without_an_end(spark):
    rates = [rate(1, 0, "1995-01-01", "0.7"), rate(2, 1, "1995-01-01", "6.000001"), rate(3, 2, "1995-01-01", "1")]
    t = base(spark, [line(1, move_id=1, amount_currency=100), line(2, move_id=2, balance=5, amount_currency="0.03"),
                     line(3, move_id=3, amount_currency=2), line(4, move_id=1, company_id=2, amount_currency=1)],
             moves=[move(1, currency_id=0), move(2, currency_id=1), move(3, currency_id=2)], rates=rates)
    got = rows_by_id(aged_lines(t, D, "receivable", [(1, "25000", 2), (2, "1500000", 9)]))
    assert amount(got[1]) == Decimal("3571428.57")
    assert amount(got[3]) == Decimal("50000") and amount(got[4]) == Decimal("2142857.142857143")
    small = rows_by_id(aged_lines(t, D, "receivable", [(1, "1", 2)]))
    assert amount(small[2]) == 0  # a little less than half a cent
    exact = rows_by_id(aged_lines(t, D, "receivable", [(1, "1", 10)]))
    assert amount(exact[2]) == Decimal("0.0049999992")


def test_two_level_report(spark):
    rates = [rate(1, 0, "1995-01-01", "0.5"), rate(2, 1, "1995-01-01", "0")]
    t = base(spark, [line(1, amount_currency=10, date_maturity="2000-01-20"), line(2, move_id=2, amount_currency=8),
                     line(3, partner_id=11, amount_currency=6)],
             moves=[move(1, currency_id=0, amount_residual=3), move(2, currency_id=1, amount_residual=4)], rates=rates)
    rows = aged_report(t, D, "receivable", CT, position="place").collect()
    assert [(r["level"], r["partner_name"], r["id"]) for r in rows] == [
        (0, "A", None), (1, "A", 2), (1, "A", 1), (0, "B", None), (1, "B", 3)]
    assert [r["place"] for r in rows] == list(range(5))
    partner, second, first = rows[:3]
    assert first["original_currency_amount"] == 20.0 and second["original_currency_amount"] == 8.0
    assert partner["original_currency_amount"] == 18 / 0.5
    assert partner["amount_residual"] == 7 and first["move_name"] == "INV/1" and partner["move_name"] is None
    assert str(first["report_date"]) == "2000-01-20" and first["account_name"] is not None
    assert sum(first[f"period{i}"] for i in range(6)) == 20


def test_sorted_partners(spark):
    t = base(spark, [line(1, balance=5), line(2, partner_id=11, balance=50)])
    rows = aged_by_partner(t, D, "receivable", CT, sort_by=[F.desc("period1")]).collect()
    assert [r["partner_name"] for r in rows] == ["B", "A"]


def test_large_period_tables_and_repeated_periods(spark, monkeypatch):
    import pytest

    from ledgerlens.operators import periods
    lines = [line(i, date_maturity=f"1999-{m:02}-15", balance=i) for i, m in enumerate(range(1, 13), 1)]
    table = spark.createDataFrame(period_rows(D), PERIOD_TABLE_SCHEMA)
    small = sorted(map(str, aged_lines(base(spark, lines), D, "receivable", CT, periods=table).collect()))
    monkeypatch.setattr(periods, "MAX_PERIODS", 3)
    large = aged_lines(base(spark, lines), D, "receivable", CT, periods=table)
    assert sorted(map(str, large.collect())) == small and len(small) == 12
    twice = spark.createDataFrame([(None, None, 1), (None, None, 1)], PERIOD_TABLE_SCHEMA)
    with pytest.raises(ValueError, match="unique"):
        aged_lines(base(spark, [line(1)]), D, "receivable", CT, periods=twice)


def test_trust_join(spark):
    from ledgerlens.operators.trust import join_trust
    props = [trust(1, 10, 1, "good"), trust(2, 10, 1, "bad"),      # two rows, company 1
             trust(3, 11, 2, "bad"),                                # other company only
             {"id": 4, "name": "trust", "res_id": "res.partner,12", "company_id": None,
              "value_text": "bad"},                                 # null company
             {"id": 5, "name": "other", "res_id": "res.partner,13", "company_id": 1,
              "value_text": "bad"}]                                 # not a trust row
    lines = spark.createDataFrame(
        [(1, 10, 1), (2, 10, 2), (3, 11, 1), (4, 12, 1), (5, 13, 1), (6, 14, 1)],
        "id long, partner_id long, company_id int")
    got = join_trust(lines, tables(spark, ir_property=props)["ir_property"]).collect()
    assert sorted(r["__trust_id"] for r in got if r.id == 1) == [1, 2]
    assert [r["__trust_value"] for r in got if r.id in (2, 3, 4, 5, 6)] == [None] * 5


def test_money_of_three_decimals(spark):
    """A three-decimal currency and a rate of seven decimals reach the report uncut."""
    t = base(spark, [line(1, balance=2)])
    exact = F.lit("1.235").cast("decimal(18,3)")
    aml = t["account_move_line"].withColumns({"balance": exact, "amount_currency": exact})
    part = t["account_partial_reconcile"].withColumn("amount", F.col("amount").cast("decimal(18,3)"))
    row = aged_lines({**t, "account_move_line": aml, "account_partial_reconcile": part}, D, "receivable", [(1, "1.0000001", 7)]).first()
    base_amount = sum(row[f"period{i}"] for i in range(6))
    rate = row["currency_rate"]
    assert rate is None or rate == 1 or rate > 0
    if rate in (None, 1):
        assert str(base_amount) == "1.235000100000"


def test_generated_code_of_the_lines_can_be_compiled(spark):
    t = base(spark, [line(1), line(2, account_id=3)])
    for kind in ("receivable", "payable"):
        assert longest_method(aged_lines(t, D, kind, CT)) <= LONGEST_METHOD
