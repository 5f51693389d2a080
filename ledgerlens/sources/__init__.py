"""Table sources: catalogs, the test fixture views, inline parameter relations."""

from ledgerlens.sources.fixtures import FIXTURE_DATE_TO, CURRENCY_TABLE_ROWS, fixture_tables
from ledgerlens.sources.inline import currency_table, period_rows, period_table
from ledgerlens.sources.tables import LazyTables, catalog_tables, parquet_tables

__all__ = [
    "FIXTURE_DATE_TO", "CURRENCY_TABLE_ROWS", "fixture_tables", "currency_table",
    "period_rows", "period_table", "LazyTables", "catalog_tables", "parquet_tables",
]
