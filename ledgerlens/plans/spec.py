"""Report declarations: the four extension points of a report.

A report is declared by what its lines are (the query), how lines fold into
levels (the hierarchy), which columns each level shows and in which order,
and which parameters restrict it (the domain).  ``ReportSpec`` records
exactly those, pointing at the plan functions of this package, so a new
report is one more declaration and a caller can run any report by name:

    run_report("undelivered", tables, level="order_id", company_ids=[1])

A hierarchy is declared as a :class:`~ledgerlens.operators.rollup.Rollup`
(levels and an operator per column) and compiled: every level by its last key,
and the full hierarchy by the empty key.  A report that shows more than the
folded columns (labels, blank cells, ratios) names a function for a level
instead.  ``run_report`` takes a name or a declaration of the caller's own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame

from ledgerlens.operators.rollup import Rollup, group_rows, hierarchy
from ledgerlens.plans.aged import AGED_ROLLUP, BY_PARTNER_COLUMNS, aged_lines, group_by_partner, two_levels
from ledgerlens.plans.attachments import (
    attachments_main, attachments_page, attachments_typed, attachments_where,
)
from ledgerlens.plans.undelivered import (
    LINE_COLUMNS, REPORT_COLUMNS, UNDELIVERED_ROLLUP, undelivered_by_order, undelivered_lines, undelivered_report,
)


@dataclass(frozen=True)
class Level:
    """How lines fold into a level, what it shows (in order; nothing said:
    all it has), and the parameters it takes."""

    fold: Callable[..., DataFrame]
    columns: tuple[str, ...] = ()
    parameters: tuple[str, ...] = ()


@dataclass(frozen=True)
class ReportSpec:
    """One report: ``lines(tables, **domain)`` builds the line relation with
    the domain applied; ``columns`` are the line columns shown, in order;
    ``rollup`` declares the hierarchy; ``levels`` maps a hierarchy key to a
    :class:`Level` (the empty key is the full hierarchy) where the report shows
    more than the roll-up folds; ``domain`` names the parameters ``lines``
    accepts."""

    name: str
    lines: Callable[..., DataFrame]
    columns: tuple[str, ...]
    levels: Mapping[str, Level] = field(default_factory=dict)
    domain: tuple[str, ...] = ()
    rollup: Rollup | None = None

    def all_levels(self) -> dict[str, Level]:
        """The levels the roll-up compiles to, and those with a function."""
        compiled: dict[str, Level] = {}
        if self.rollup is not None:
            for depth, level in enumerate(self.rollup.levels, 1):
                compiled[level.keys[-1]] = Level(partial(group_rows, rollup=self.rollup, depth=depth))
            compiled[""] = Level(partial(hierarchy, rollup=self.rollup, columns=self.columns), parameters=("sort", "ranges"))
        return {**compiled, **self.levels}


def _attachment_lines(tables, where=None):
    return attachments_where(tables["ir_attachment"], where)


_ATTACHMENT = ("id", "res_id", "mimetype", "create_date", "is_main")

REPORTS: dict[str, ReportSpec] = {
    "aged_partner": ReportSpec(
        name="aged_partner",
        lines=aged_lines,
        columns=("id", *(c for c in BY_PARTNER_COLUMNS if c != "original_currency_amount")),
        levels={"partner_id": Level(group_by_partner, BY_PARTNER_COLUMNS, ("sort_by",)),
                "": Level(two_levels, ("level", "id", *BY_PARTNER_COLUMNS))},
        domain=("date_to", "account_type", "currency_table", "periods"),
        rollup=AGED_ROLLUP,
    ),
    "undelivered": ReportSpec(
        name="undelivered",
        lines=undelivered_lines,
        columns=LINE_COLUMNS,
        levels={"order_id": Level(undelivered_by_order),
                "": Level(undelivered_report, REPORT_COLUMNS, ("sort",))},
        domain=("company_ids", "partner_ids", "dedupe", "where"),
        rollup=UNDELIVERED_ROLLUP,
    ),
    "attachments": ReportSpec(
        name="attachments",
        lines=_attachment_lines,
        columns=_ATTACHMENT,
        levels={"main": Level(attachments_main, (), ("record_cols", "types", "order")),
                "": Level(attachments_typed, (*_ATTACHMENT, "type"), ("record_cols", "types", "order")),
                "page": Level(attachments_page, _ATTACHMENT, ("offset", "limit", "order"))},
        domain=("where",),
    ),
}


def run_report(report: str | ReportSpec, tables: Mapping[str, DataFrame], level: str | None = None,
               **parameters) -> DataFrame:
    """Run a declared report (one of :data:`REPORTS` by name, or another
    declaration): its lines with the domain applied, optionally folded into one
    of its levels, with the columns declared for it.

    ``parameters`` are those of the domain and of the level.
    """
    spec = REPORTS[report] if isinstance(report, str) else report
    levels = spec.all_levels()
    if level is not None and level not in levels:
        raise KeyError(f"{spec.name}: no level {level!r}; levels: {sorted(levels)}")
    how = Level(lambda lines: lines, spec.columns) if level is None else levels[level]
    unknown = set(parameters) - set(spec.domain) - set(how.parameters)
    if unknown:
        raise TypeError(f"{spec.name}: unknown parameter(s) {sorted(unknown)}")
    lines = spec.lines(tables, **{k: v for k, v in parameters.items() if k in spec.domain})
    out = how.fold(lines, **{k: v for k, v in parameters.items() if k in how.parameters})
    return out.select(*how.columns) if how.columns else out
