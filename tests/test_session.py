"""Session defaults fill gaps only, and a submitted master holds."""

import os
import subprocess
import sys

from ledgerlens.session import ensure_defaults

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_defaults_do_not_override(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    prev = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        ensure_defaults(spark)
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.set(key, prev)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_submitted_master_survives():
    code = "from ledgerlens.session import get_spark; print('MASTER', get_spark().sparkContext.master)"
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell", "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "MASTER local[2]" in out.stdout, out.stderr[-2000:]


def test_a_side_of_few_rows_is_broadcast(spark):
    """A key with few values: the other side's rows are not sorted in as many
    tasks as there are keys (the small side leaves most partitions empty)."""
    few = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")  # of unknown size
    many = spark.range(2000).selectExpr("id", "cast(id % 2 + 1 as int) AS k")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = many.join(few, "k")
        assert len(out.collect()) == 2000
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_partition_size_of_joins(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
