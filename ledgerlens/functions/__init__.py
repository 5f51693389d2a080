"""Column-level functions (all native Spark expressions, no Python UDFs)."""

from ledgerlens.functions.money import (
    PRECISIONS, WORK, converted_amount, ratio_or_one, round_by_precision,
)
from ledgerlens.functions.text import (
    DEFAULT_TRUST, PREVIEW_TYPES, UNKNOWN_ORDER, account_label, blank_zero,
    classify_mime, order_label, partner_res_id,
)

__all__ = [
    "PRECISIONS", "WORK", "converted_amount", "ratio_or_one", "round_by_precision",
    "DEFAULT_TRUST", "PREVIEW_TYPES", "UNKNOWN_ORDER", "account_label", "blank_zero",
    "classify_mime", "order_label", "partner_res_id",
]
