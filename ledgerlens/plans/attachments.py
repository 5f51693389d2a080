"""Attachment listing, preview typing and main-attachment choice.

* :func:`attachments_page` - a listing with newest-first default order and
  offset / limit paging.
* :func:`attachments_typed` - the preview list of each record: attachments
  whose MIME type matches one of the preview families, tagged with the
  family, in oldest-first (``asc``, the default) or newest-first order.
* :func:`attachments_main` - one row per record: the attachment the preview
  opens on (the first flagged ``is_main`` in list order, else the first one),
  and whether it was newly chosen (no attachment of the record was flagged).

A list belongs to one record, identified by ``record_cols``: model and id
(``("res_model", "res_id")``), or the id alone in a table of one model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.domain import Domain, domain_filter
from ledgerlens.functions.text import PREVIEW_TYPES, classify_mime
from ledgerlens.operators.latest import top1_per_key
from ledgerlens.operators.paging import SortKey, ordered_slice, sort_columns

# Listing order: creation date descending (nulls first), then id.
NEWEST_FIRST = ("create_date DESC NULLS FIRST", "id DESC")
# The same list reversed: every key and its null placement.
OLDEST_FIRST = tuple(SortKey.parse(k).reversed() for k in NEWEST_FIRST)


def list_order(order: str) -> tuple[str, ...]:
    if order == "asc":
        return OLDEST_FIRST
    if order == "desc":
        return NEWEST_FIRST
    raise ValueError(f"order must be 'asc' or 'desc', not {order!r}")


def attachments_where(attachments: DataFrame, where: Column | Domain | None) -> DataFrame:
    """The attachments that a column expression or a search domain (a list in
    prefix notation, :mod:`ledgerlens.functions.domain`) holds for."""
    if where is None:
        return attachments
    return attachments.filter(where if isinstance(where, Column) else domain_filter(attachments, where))


def attachments_page(attachments: DataFrame, where: Column | Domain | None = None,
                     columns: Sequence[str] | None = None, offset: int = 0,
                     limit: int | None = None, order: Sequence[str] | None = None,
                     position: str | None = None) -> DataFrame:
    """Filtered, ordered page of attachments.

    ``where`` is a column expression or a search domain.
    ``order`` (SQL sort keys) defaults to newest first, only when none is
    given (an explicit order wins).  ``offset`` / ``limit`` select the page;
    ``position`` names a column with each row's place in the whole list.
    """
    df = attachments_where(attachments, where)
    keys = NEWEST_FIRST if order is None else list(order)
    page = ordered_slice(df, keys, offset, limit, position)
    return page.select(*columns, *([position] if position else [])) if columns else page


def typed_attachments(attachments: DataFrame,
                      types: Sequence[str] = PREVIEW_TYPES) -> DataFrame:
    """Attachments whose MIME type matches a preview family, with ``type``.

    A null MIME type cannot be matched and is left out.
    """
    return (attachments
            .withColumn("type", classify_mime(F.col("mimetype"), types))
            .filter(F.col("mimetype").isNotNull() & (F.col("type") != "")))


def attachments_typed(attachments: DataFrame, record_cols: Sequence[str],
                      types: Sequence[str] = PREVIEW_TYPES, order: str = "asc",
                      position: str | None = None) -> DataFrame:
    """Preview lists of all records, each in list order; ``position`` names a
    column with each row's place in the result, from 0."""
    keys = [*record_cols, *list_order(order)]
    return ordered_slice(typed_attachments(attachments, types), keys, position=position)


def attachments_main(attachments: DataFrame, record_cols: Sequence[str],
                     types: Sequence[str] = PREVIEW_TYPES, order: str = "asc") -> DataFrame:
    """Main attachment per record, with ``newly_chosen``.

    Top-1 per record through ``row_number() = 1``: Spark limits each record
    to one row inside every map task before the shuffle, so a record with a
    very large number of attachments costs no more than any other.
    """
    flagged = F.coalesce(F.col("is_main"), F.lit(False))
    typed = typed_attachments(attachments, types)
    main = top1_per_key(typed, list(record_cols), [flagged.desc(), *sort_columns(list_order(order))])
    return main.select(*record_cols, "id", "mimetype", "type", "create_date", "is_main",
                       (~flagged).alias("newly_chosen"))
