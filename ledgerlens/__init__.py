"""Ledger reports on Spark.

Aged receivable / payable, undelivered sale-order lines and attachment
listing, each written as a function from DataFrames plus explicit
parameters to a DataFrame.  Everything is built from joins, windows,
grouping and column expressions so Catalyst and AQE plan the work.

Sub-packages:

* ``sources``    - table catalogs (parquet / metastore), the ERP-shaped
                   fixture views and small inline parameter relations.
* ``functions``  - column-level helpers (money rounding, labels, MIME type).
* ``operators``  - reusable relational building blocks (latest rate,
                   settlement residuals, period range join, ordered
                   paging).
* ``plans``      - the reports themselves.
"""

from ledgerlens.session import get_spark

__all__ = ["get_spark"]
