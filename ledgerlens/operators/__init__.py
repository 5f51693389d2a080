"""Relational building blocks shared by the reports."""

from ledgerlens.operators.checks import assert_unique
from ledgerlens.operators.latest import latest_rate, latest_rate_named, top1_per_key
from ledgerlens.operators.paging import Pages, ordered_slice, sort_columns
from ledgerlens.operators.periods import period_join
from ledgerlens.operators.rollup import GroupLevel, Rollup, group_rows, hierarchy
from ledgerlens.operators.settlement import partial_residual, settled_at, settlement_deltas
from ledgerlens.operators.trust import join_trust, trust_properties

__all__ = [
    "assert_unique", "latest_rate", "latest_rate_named", "top1_per_key", "ordered_slice",
    "Pages", "GroupLevel", "Rollup", "group_rows", "hierarchy", "sort_columns", "period_join", "partial_residual", "settled_at", "settlement_deltas", "join_trust", "trust_properties",
]
