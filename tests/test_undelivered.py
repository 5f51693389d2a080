"""Undelivered report traps on hand-made rows."""

import datetime as dt
from decimal import Decimal

from ledgerlens.operators.latest import latest_rate, latest_rate_named
from ledgerlens.plans.undelivered import (
    undelivered_by_order, undelivered_lines, undelivered_report,
)
from ledgerlens.sources.fixtures import CURRENCY_ROWS
from micro import dec, rate, tables, trust

TS = dt.datetime(2000, 1, 1)
RATES = [rate(1, 0, "1995-01-01", "1"), rate(5, 3, "2001-01-01", "0.1"), rate(6, 3, None, "0.125"),
         rate(7, 4, "2000-01-01", "0.1"), rate(8, 4, "2000-01-01", "0.2"),
         rate(9, 5, "1998-01-01", "0.5"), rate(10, 5, "2000-01-01", None),
         rate(11, 6, "2000-01-01", "0"), rate(12, 9, "2005-01-01", "0.5")]  # 9: no currency row


def order(id, name, currency_id, partner_id=10):
    return {"id": id, "name": name, "partner_id": partner_id, "currency_id": currency_id,
            "create_date": TS}


def sol(id, order_id, qty=5, delivered=5, price=10, product_id=100, company_id=1):
    return {"id": id, "order_id": order_id, "product_id": product_id, "company_id": company_id,
            "product_uom_qty": dec(qty), "qty_delivered": dec(delivered),
            "price_unit": dec(price), "price_total": dec(price), "create_date": TS,
            "write_date": TS}


def make(spark, orders, lines, props=()):
    return tables(
        spark, sale_order=orders, sale_order_line=lines,
        res_partner=[{"id": 10, "name": "A", "display_name": "Seg A"}],
        ir_property=list(props), res_currency=CURRENCY_ROWS, res_currency_rate=RATES,
        product_product=[{"id": 100, "product_tmpl_id": 200}],
        product_template=[{"id": 200, "name": "Widget"}])


def test_latest_rate_order(spark):
    t = make(spark, [], [])
    got = {r.currency_id: r.rate for r in latest_rate(t["res_currency_rate"]).collect()}
    assert got[3] == Decimal("0.125")   # null date first on descending order
    assert got[4] == Decimal("0.2")     # tie -> higher id
    assert got[5] is None               # newest rate null
    named = {r.currency_id: r for r in latest_rate_named(t["res_currency_rate"],
                                                         t["res_currency"]).collect()}
    assert 9 in got and 9 not in named  # currency joined before the top-1
    assert named[4].currency_name == "JPY"


def test_lines_quantities_and_currency(spark):
    t = make(spark,
             [order(1, "SO1", 4), order(2, "", 5), order(3, None, 7), order(4, "X" * 129, 3),
              order(5, "SO5", 6)],
             [sol(1, 1, qty=5, delivered=7), sol(2, 1, qty=5, delivered=5),
              sol(3, 1, qty=5, delivered=None), sol(4, 1, product_id=None),
              sol(5, 2, price=30), sol(6, 3), sol(7, 4, price=1), sol(8, 5, price=4)])
    got = {r.id: r for r in undelivered_lines(t).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7, 8}            # line without product dropped
    assert got[1].outstanding_quantity == -2 and got[2].outstanding_quantity == 0
    assert got[3].outstanding_quantity is None
    assert got[1].amount == 50 and got[1].currency_rate == Decimal("0.2")
    assert (got[5].currency_name, got[5].currency_symbol, got[5].currency_rate) == ("HKD", "$", 1)
    assert got[5].amount == 30                           # null newest rate -> unchanged
    assert got[6].currency_name == "HKD"                 # no rate at all
    assert got[7].amount == 8                            # 1 / 0.125
    assert got[8].currency_name == "HKD"                 # zero rate -> fallback
    assert got[1].move_id == 1 and got[1].english_name == "Seg A"
    assert got[1].product_code == "Widget"

    rep = undelivered_report(undelivered_lines(t)).collect()
    labels = [r.name for r in rep if r.level == 0]
    assert labels.count("Unknown Order") == 2
    assert "X" * 128 in labels and "X" * 129 not in labels
    assert [r.order_no for r in rep][:3] == ["", "", "SO1"]  # order number asc (empty first), nulls last
    assert rep[-1].order_no is None
    line2 = next(r for r in rep if r.level == 1 and r.id == 2)
    assert line2.outstanding_quantity is None             # 0 shows empty
    assert line2.quantity == 5
    assert all(r.amount is None for r in rep if r.level == 1)
    o1 = next(r for r in rep if r.level == 0 and r.order_id == 1)
    assert o1.amount == 150 and o1.quantity == 15
    line_x = next(r for r in rep if r.level == 1 and r.id == 7)
    assert line_x.name == "X" * 129                      # line label is not truncated


def test_filters_and_trust_rows(spark):
    t = make(spark, [order(1, "SO1", 0), order(2, "SO2", 0, partner_id=11)],
             [sol(1, 1, company_id=1), sol(2, 1, company_id=2), sol(3, 2)],
             props=[trust(1, 10, 1, "good"), trust(2, 10, 1, "bad")])
    rows = undelivered_lines(t).collect()
    assert sorted(r.id for r in rows) == [1, 1, 2]      # two trust rows, partner 11 unknown
    assert sorted(r.id for r in undelivered_lines(t, dedupe=True).collect()) == [1, 1, 2]
    assert [r.id for r in undelivered_lines(t, company_ids=[2]).collect()] == [2]
    assert undelivered_lines(t, partner_ids=[11]).count() == 0
    wanted = spark.createDataFrame([(10,)], "id long")
    assert undelivered_lines(t, partner_ids=wanted).count() == 3
    by_order = undelivered_by_order(undelivered_lines(t)).collect()
    assert len(by_order) == 1 and by_order[0].line_count == 3


def test_report_keeps_one_line_row_per_trust_row(spark):
    t = make(spark, [order(1, "SO1", 0)], [sol(1, 1, company_id=1), sol(2, 1, company_id=2)],
             props=[trust(1, 10, 1, "good"), trust(2, 10, 1, "bad")])
    rep = undelivered_report(undelivered_lines(t)).collect()
    assert sorted(r.id for r in rep if r.level == 1) == [1, 1, 2]
    order_row = next(r for r in rep if r.level == 0)
    assert order_row.quantity == 15 and order_row.amount == 30   # three report rows summed
    assert [r.level for r in rep] == [0, 1, 1, 1]
