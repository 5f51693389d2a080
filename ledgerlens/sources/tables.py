"""Where the ERP tables come from.

Reports take a ``tables`` mapping (table name -> DataFrame).  Two ready
makers are provided: one over a metastore database and one over a folder of
parquet datasets.  Both are lazy: nothing is read until a report asks for a
table, and then only the columns and rows its plan needs (Catalyst prunes
columns and pushes filters into the scan).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

# Tables the reports read.
REPORT_TABLES = (
    "account_move_line", "account_move", "account_partial_reconcile",
    "account_journal", "account_account", "sale_order", "sale_order_line",
    "res_partner", "ir_property", "res_currency", "res_currency_rate",
    "product_product", "product_template", "ir_attachment",
)


class LazyTables(Mapping[str, DataFrame]):
    """Mapping that builds each DataFrame on first access and keeps it."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            try:
                maker = self._makers[name]
            except KeyError:
                raise KeyError(f"no table named {name!r}") from None
            self._built[name] = maker()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def with_tables(self, **frames: DataFrame) -> "LazyTables":
        """Copy with some tables replaced (handy for tests)."""
        makers = dict(self._makers)
        for name, frame in frames.items():
            makers[name] = (lambda f=frame: f)
        return LazyTables(makers)


def catalog_tables(spark: SparkSession, database: str | None = None,
                   names: tuple[str, ...] = REPORT_TABLES) -> LazyTables:
    """Tables of a metastore database (``spark.table``)."""
    prefix = f"{database}." if database else ""
    return LazyTables({n: (lambda n=n: spark.table(prefix + n)) for n in names})


def parquet_tables(spark: SparkSession, root: str,
                   names: tuple[str, ...] = REPORT_TABLES) -> LazyTables:
    """Tables stored as ``<root>/<name>`` parquet datasets."""
    root = root.rstrip("/")
    return LazyTables({n: (lambda n=n: spark.read.parquet(f"{root}/{n}")) for n in names})
