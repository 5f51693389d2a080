"""Tiny hand-made ERP tables for the trap tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from ledgerlens.sources.fixtures import (
    ACCOUNT_SCHEMA, CURRENCY_SCHEMA, JOURNAL_SCHEMA, RATE_SCHEMA,
)
from ledgerlens.sources.tables import LazyTables

L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.BooleanType()
M, TS = T.DecimalType(18, 2), T.TimestampNTZType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS = {
    "account_move_line": _schema(("id", L), ("move_id", L), ("partner_id", L), ("journal_id", I),
                                 ("account_id", I), ("company_id", I), ("currency_id", I),
                                 ("date", D), ("date_maturity", D), ("expected_pay_date", D),
                                 ("payment_id", L), ("balance", M), ("amount_currency", M)),
    "account_move": _schema(("id", L), ("name", S), ("ref", S), ("move_type", S),
                            ("amount_residual", M), ("currency_id", I),
                            ("x_studio_source_order", L)),
    "account_partial_reconcile": _schema(("debit_move_id", L), ("credit_move_id", L),
                                         ("amount", M), ("max_date", D)),
    "account_journal": JOURNAL_SCHEMA,
    "account_account": ACCOUNT_SCHEMA,
    "res_currency": CURRENCY_SCHEMA,
    "res_currency_rate": RATE_SCHEMA,
    "res_partner": _schema(("id", L), ("name", S), ("display_name", S)),
    "ir_property": _schema(("id", L), ("name", S), ("res_id", S), ("company_id", I),
                           ("value_text", S)),
    "sale_order": _schema(("id", L), ("name", S), ("partner_id", L), ("currency_id", I),
                          ("analytic_account_id", I), ("create_date", TS)),
    "sale_order_line": _schema(("id", L), ("order_id", L), ("product_id", L), ("company_id", I),
                               ("product_uom_qty", M), ("qty_delivered", M), ("price_unit", M),
                               ("price_total", M), ("create_date", TS), ("write_date", TS),
                               ("name", S), ("display_type", S), ("create_uid", I),
                               ("write_uid", I)),
    "product_product": _schema(("id", L), ("product_tmpl_id", L)),
    "product_template": _schema(("id", L), ("name", S)),
    "ir_attachment": _schema(("id", L), ("res_id", I), ("mimetype", S), ("create_date", D),
                             ("is_main", B)),
}


def dec(x):
    return None if x is None else Decimal(str(x))


def day(s):
    return None if s is None else dt.date.fromisoformat(s)


def tables(spark, **rows) -> LazyTables:
    """LazyTables with the given rows (dicts or tuples); other tables empty."""
    makers = {}
    for name, schema in SCHEMAS.items():
        data = rows.get(name, [])
        data = [tuple(r.get(f.name) for f in schema.fields) if isinstance(r, dict) else r
                for r in data]
        makers[name] = (lambda d=data, s=schema: spark.createDataFrame(d, s))
    return LazyTables(makers)


def line(id, move_id=1, partner_id=10, journal_id=0, account_id=0, company_id=1,
         currency_id=None, date="2000-01-01", date_maturity=None, balance=100,
         amount_currency=None):
    return {"id": id, "move_id": move_id, "partner_id": partner_id, "journal_id": journal_id,
            "account_id": account_id, "company_id": company_id, "currency_id": currency_id,
            "date": day(date), "date_maturity": day(date_maturity),
            "balance": dec(balance),
            "amount_currency": dec(balance if amount_currency is None else amount_currency)}


def move(id, currency_id=0, source_order=None, amount_residual=0, name=None):
    return {"id": id, "name": name or f"INV/{id}", "ref": None, "move_type": "out_invoice",
            "amount_residual": dec(amount_residual), "currency_id": currency_id,
            "x_studio_source_order": source_order}


def partial(debit=None, credit=None, amount=0, max_date="2000-01-01"):
    return {"debit_move_id": debit, "credit_move_id": credit, "amount": dec(amount),
            "max_date": day(max_date)}


def rate(id, currency_id, name, value):
    return (id, currency_id, day(name), dec(value))


def trust(id, partner_id, company_id, value):
    return {"id": id, "name": "trust", "res_id": f"res.partner,{partner_id}",
            "company_id": company_id, "value_text": value}
