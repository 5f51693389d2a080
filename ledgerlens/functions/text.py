"""Text-valued column helpers used by the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reports' wording.
UNKNOWN_ORDER = "Unknown Order"
DEFAULT_TRUST = "normal"
LABEL_WIDTH = 128
# MIME families previewed by default, in this order.
PREVIEW_TYPES = ("pdf", "image")


def account_label(code: Column, name: Column) -> Column:
    """``code || ' ' || name``: null when either part is null.

    (``concat`` propagates nulls; ``concat_ws`` would skip them.)
    """
    return F.concat(code, F.lit(" "), name)


def order_label(order_no: Column, width: int = LABEL_WIDTH) -> Column:
    """Label of an order row: the first ``width`` characters of the order
    number, or ``'Unknown Order'`` when it is null or empty."""
    return F.coalesce(F.nullif(F.substring(order_no, 1, width), F.lit("")),
                      F.lit(UNKNOWN_ORDER))


def blank_zero(value: Column) -> Column:
    """Cell shown empty when its raw value equals 0 (nulls stay null)."""
    return F.nullif(value, F.lit(0))


def classify_mime(mimetype: Column, types: Sequence[str] = PREVIEW_TYPES) -> Column:
    """Leftmost match of ``types`` joined by ``|`` inside the MIME type.

    The alternatives are joined as a regular expression without escaping,
    unanchored and case-sensitive; ``''`` means no match, null stays null.
    """
    return F.regexp_extract(mimetype, "|".join(types), 0)


def partner_res_id(partner_id: Column, model: str = "res.partner") -> Column:
    """Composed key ``'<model>,<id>'`` of a polymorphic property row."""
    return F.concat(F.lit(model + ","), partner_id.cast("string"))
