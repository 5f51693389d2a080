"""Spark session defaults for the reports.

On a cluster the session normally exists already (spark-submit / a
notebook); :func:`get_spark` then only fills settings that are unset.
Without one it builds a session on the master that the caller passes or the
launcher has configured.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the reports rely on.  Each one is applied only when the session
# does not already define it, so a cluster's own configuration wins.
_DEFAULTS = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, turn shuffled joins into broadcasts when a side turns
    # out small at runtime.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A task of a shuffled join sorts both its sides, which take several times
    # their shuffled size: Spark's 64 MB are most of a task's memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Accounts, journals, companies, currencies: a side of a few rows leaves most
    # partitions empty, and Spark then keeps a sort of the other side, all its
    # rows in as many tasks as there are keys, instead of a broadcast.
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on order_id followed by a per-order aggregation reuses the join's
    # partitioning; without this AQE refuses to split a hot order there
    # (splitting needs one more exchange).  With it, the hot partition is
    # split and the aggregation gets its own (map-side combined) shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Dates in the ledger are calendar dates; keep timestamp->date casts
    # independent of the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "ledgerlens", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one.

    ``master`` is set only when given; otherwise the master of spark-submit
    or of the Spark configuration holds.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_defaults(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Apply :data:`_DEFAULTS` for every key the session leaves unset."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for kept results, shared by all executors: the one that
    ``spark.checkpoint.dir`` names.

    A ``local[...]`` session without one gets a scratch folder; on a cluster
    that is an error, since other executors could not read a local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
    sc.setCheckpointDir(folder)
    return folder
