"""Registered queries of the training-data operators.

Each applies its operator with production parameters to its whole table and
returns one row per row of it (the phrases: each language's first 2,000).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    collocations, decontaminate, jaccard_join, language_id, line_dedup, merkle, minhash, mixing, quote_links, sharding,
    token_counts, token_files, url_filter,
)
from ledgerlens.llm.storage import checkpoint_dir

#: Tokenizer file of the token counts.
TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Url rules: host, path prefix, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and the smallest id
    among its near duplicates (bands joined, Jaccard of 0.8 verified)."""
    docs = _table(spark, sf_dir, "documents")
    out = minhash.edited_fingerprints(docs, near=minhash.near_duplicates(docs))
    return out.withColumnRenamed("doc", "doc_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    import public_tokenizers
    out = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)
    return out.withColumnRenamed("doc", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    out = url_filter.url_filter(_table(spark, sf_dir, "pages"), rules)
    return out.withColumnRenamed("id", "page_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of even row counts, equal texts together."""
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of the sources takes of every document."""
    out = mixing.mix(_table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))
    return out.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 4-word shingles."""
    out = jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from two thirds of the documents."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.held_out(docs["doc_id"])
    model = language_id.fit(docs.where(~held_out))
    out = language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order, without quotes."""
    return quote_links.reply_ordered(_table(spark, sf_dir, "conversations"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of two or three words."""
    return collocations.best_phrases(collocations.candidates(_table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and recomputed root of every document; a third of the texts
    are lower-cased behind the manifest's back."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    out = merkle.document_manifest(docs, tampered)
    return out.select(F.col("doc").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written to files of packed words and read back."""
    import public_tokenizers
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), folder)
    out = token_files.read(spark, folder)
    return out.select(F.col("doc").alias("doc_id"), "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                      F.crc32("ids").alias("ids_crc32"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_token_counts, op3_line_dedup, op4_url_filter, op5_sharding, op6_mixing,
                            op7_jaccard_join, op8_language_id, op9_decontaminate, op10_quote_links, op11_collocations,
                            op12_merkle, op13_token_files)
}
