"""The reports."""

from ledgerlens.plans.aged import (
    aged_by_partner, aged_lines, aged_report, group_by_partner, two_levels,
)
from ledgerlens.plans.attachments import (
    attachments_main, attachments_page, attachments_typed, typed_attachments,
)
from ledgerlens.plans.spec import REPORTS, Level, ReportSpec, run_report
from ledgerlens.plans.undelivered import (
    undelivered_by_order, undelivered_lines, undelivered_report,
)

__all__ = [
    "aged_by_partner", "aged_lines", "aged_report", "group_by_partner", "two_levels", "attachments_main",
    "attachments_page", "attachments_typed", "typed_attachments",
    "undelivered_by_order", "undelivered_lines", "undelivered_report",
    "REPORTS", "Level", "ReportSpec", "run_report",
]
