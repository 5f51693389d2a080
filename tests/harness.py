"""Spark-versus-DuckDB comparison used by the tests (mirrors the driver's
check: row count, column names, order-insensitive values)."""

from __future__ import annotations

import contextlib
import io
import math
import re

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not res["columns_match"]:
        res["spark_cols"] = sorted(s_cols)
        res["oracle_cols"] = sorted(d_cols)
        res["values_match"] = False
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["values_match"] = a == b
    if a != b:
        sa, sb = set(a), set(b)
        res["only_spark"] = sorted(sa - sb, key=str)[:3]
        res["only_oracle"] = sorted(sb - sa, key=str)[:3]
        res["sorted_cols"] = sorted(s_cols)
    return res


# The JVM never compiles a longer method: all rows are interpreted.
LONGEST_METHOD = 8_000


def longest_method(df) -> int:
    """Bytes of the longest method that Spark generates for a plan (built
    without adaptive execution, which shows its code only as it runs)."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before, text = spark.conf.get(key), io.StringIO()
    spark.conf.set(key, "false")
    try:
        with contextlib.redirect_stdout(text):
            df.select("*").explain("codegen")
    finally:
        spark.conf.set(key, before)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())))
