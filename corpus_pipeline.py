"""From raw documents to a sharded training mix.

``STAGES`` are applied in order; each takes the documents that the one before
kept, written as Parquet and read again, and calls one operator of
``ledgerlens.llm``.  All but the last return the columns of their input.

Rows without id get a stand-in from a hash of their text where a stage needs
one, so rows without id and with equal text count as one document; rows with
the same id and text count as one document too, once the near-duplicate stage
has run.  Null texts and texts without a letter leave in the first stage.
Empty tables pass through.  Own columns of the input pass unchanged, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from ledgerlens.llm.storage import checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words and similarity of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80
SHARDS = 16
_KEY, _HASH = "__pipeline_key", "__pipeline_hash"


def _keyed(docs: DataFrame) -> DataFrame:
    """Add a key that is never null (ids first, stand-ins above them) and a text hash."""
    stand_in = F.lit(2**62) + F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1))
    return docs.withColumn(_KEY, F.coalesce(F.col("doc_id").cast("long"), stand_in)).withColumn(
        _HASH, F.xxhash64("text"))


def _same(left: str, right: str) -> Column:
    return (F.col(_KEY) == F.col(left)) & (F.col(_HASH) == F.col(right))


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or without a letter go."""
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])))
    found = language_id.predict(docs, model, pred_col="__lang", score_col="__lang_score")
    known = F.col("__lang") != language_id.UNDETERMINED
    # a model that could learn no language rejects nothing it can't judge
    return (found.where(known) if model.languages else
            found.where(F.col("text").rlike(r"\p{L}"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates."""
    keyed = _keyed(docs)
    groups = jaccard_join.jaccard_components(keyed, SHINGLE, PERCENT, id_col=_KEY)
    kept = groups.where("doc = component").select(F.col("doc").alias(_KEY)).distinct()
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY, _HASH]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items cover by less than a twentieth of their words."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    keyed = _keyed(docs)
    judged = decontaminate.contamination(keyed, items, id_col=_KEY)
    bad = judged.where(decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(
        F.col("doc").alias("__bad"), F.col("text_hash").alias("__bad_hash")).distinct()
    return keyed.join(bad, _same("__bad", "__bad_hash"), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    keyed = _keyed(docs).withColumn("__words", mixing.word_count(F.col("text")))
    row = F.struct(_KEY, _HASH)
    chosen = mixing.mix(keyed.withColumn("__row", row), F.col("__words"), id_col="__row")
    times = (chosen.where("taken > 0").groupBy("doc").agg(F.sum(F.expr("taken div size")).alias("__times"))
             .select(F.col(f"doc.{_KEY}").alias("__t_key"), F.col(f"doc.{_HASH}").alias("__t_hash"), "__times"))
    taken = _keyed(docs).join(times, _same("__t_key", "__t_hash")).dropDuplicates([_KEY, _HASH])
    return (taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
            .select(*docs.columns))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row of the mix."""
    return sharding.shard_documents(docs, SHARDS).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", detect_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Fitted models, near-duplicate groups and sharding are not SQL; the tests
#: check every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
