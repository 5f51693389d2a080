"""Physical plan shape: the scale properties the reports rely on."""

import os
import re

import pytest

from ledgerlens.operators.latest import latest_rate
from ledgerlens.operators.settlement import partial_residual
from ledgerlens.plans import (
    aged_by_partner, aged_lines, attachments_main, undelivered_by_order, undelivered_lines,
    undelivered_report,
)
from ledgerlens.sources import CURRENCY_TABLE_ROWS, FIXTURE_DATE_TO, fixture_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern, text):
    return len(re.findall(pattern, text))


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF)


def test_partials_scanned_once_and_combined_map_side(t):
    p = plan(partial_residual(t["account_partial_reconcile"], FIXTURE_DATE_TO))
    assert count(r"Scan parquet", p) == 1
    assert count(r"partial_sum", p) >= 1 and count(r"Exchange hashpartitioning", p) == 1


def test_top1_limits_before_shuffle(t):
    p = plan(latest_rate(t["res_currency_rate"]))
    assert count(r"HashAggregate", p) == 2 and "partial_max_by" in p and "Sort" not in p  # combined on the map side
    p = plan(attachments_main(t["ir_attachment"], ("res_id",)))
    assert re.search(r"WindowGroupLimit .*Partial", p)


def test_aged_plan(t):
    p = plan(aged_lines(t, FIXTURE_DATE_TO, "receivable", CURRENCY_TABLE_ROWS))
    assert "CartesianProduct" not in p
    assert count(r"BroadcastNestedLoopJoin BuildRight, Inner", p) == 1   # period range join
    assert "LeftSemi" in p                                               # account filter
    q = plan(aged_by_partner(t, FIXTURE_DATE_TO, "receivable", CURRENCY_TABLE_ROWS))
    # string max only in the second, per-(partner, order) phase
    assert count(r"HashAggregate\(keys=\[partner_id#\d+L, partner_name#\d+, order_no", q) == 2


def test_undelivered_report_plan(t):
    lines = undelivered_lines(t)
    p = plan(undelivered_report(lines))
    # one run of the lines: ranges of the order, a window in them, no union and no sort of its own by ranges
    assert "Union" not in p and "Expand" not in p and "rangepartitioning" not in p
    assert count(r"\bWindow \[", p) == 1 and count(r"Generate inline", p) == 1
    assert count(r"Exchange .*REPARTITION_BY_NUM", p) == 1
    folded = plan(undelivered_by_order(lines))
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\], functions=\[(?:partial_)?sum\(quantity", folded)
    assert keys and all(len(k.split(",")) == 4 for k in keys) and "SortAggregate" not in folded


def test_building_a_report_starts_no_job(spark, t):
    """Plans are only declared: no size probes, no counts."""
    sc = spark.sparkContext
    sc.setJobGroup("building", "reports are declared")
    try:
        lines = undelivered_lines(t, company_ids=[1])
        undelivered_by_order(lines)
        aged_by_partner(t, FIXTURE_DATE_TO, "receivable", CURRENCY_TABLE_ROWS)
        attachments_main(t["ir_attachment"], ("res_id",))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sc.statusTracker().getJobIdsForGroup("building") == []
    # a two-level report looks at a sample of its lines for the bounds of its ranges
    sc.setJobGroup("bounds", "two levels")
    try:
        undelivered_report(lines)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("bounds")) > 0


def test_no_hints_on_tables(t):
    """Without Spark's own broadcasts, only the period table is broadcast."""
    spark = t["account_move"].sparkSession
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(undelivered_report(undelivered_lines(t)))
        p = plan(aged_lines(t, FIXTURE_DATE_TO, "receivable", CURRENCY_TABLE_ROWS))
        assert count(r"BroadcastExchange", p) == 1 and count(r"BroadcastNestedLoopJoin", p) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
