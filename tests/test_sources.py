"""Reports over ERP tables stored as parquet datasets (not fixture views)."""

import os

import pytest

from ledgerlens.plans import attachments_main, undelivered_by_order, undelivered_lines
from ledgerlens.sources import fixture_tables, parquet_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_parquet_catalog_round_trip(spark, tmp_path):
    fx = fixture_tables(spark, SF)
    names = ("sale_order_line", "sale_order", "res_partner", "ir_property", "res_currency",
             "res_currency_rate", "product_product", "product_template", "ir_attachment")
    for n in names:
        fx[n].write.parquet(str(tmp_path / n))
    stored = parquet_tables(spark, str(tmp_path), names)
    assert sorted(stored) == sorted(names)
    assert rows(undelivered_by_order(undelivered_lines(stored))) == \
        rows(undelivered_by_order(undelivered_lines(fx)))
    assert rows(attachments_main(stored["ir_attachment"], ("res_id",))) == \
        rows(attachments_main(fx["ir_attachment"], ("res_id",)))
    with pytest.raises(KeyError):
        stored["account_move_line"]
