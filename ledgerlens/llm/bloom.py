"""Blocked Bloom filters: a key's bits all lie in one 512-bit block, one in
each of its eight 64-bit words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import U64, map_arrow, mix64

WORDS = 8
#: Blocks that a filter has at most (64 bytes each: 32 MB).
MAX_BLOCKS = 1 << 19
KEYS_PER_BLOCK = 32


class BlockedBloom:
    """The filter's words; ``hits`` has no false negatives."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def hits(self, keys: np.ndarray) -> np.ndarray:
        block, bits = places(keys, len(self.words))
        return ((self.words[block] & bits) == bits).all(axis=1)


def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the eight words' bits of 64-bit keys."""
    mixed = mix64(keys)
    block = ((mixed >> U64(32)) % U64(blocks)).astype(np.int64)
    at = mix64(mixed)
    bits = np.empty((len(keys), WORDS), U64)
    for i in range(WORDS):
        bits[:, i] = U64(1) << ((at >> U64(6 * i)) & U64(63))
    return block, bits


def build(keys: DataFrame, column: str, expected: int) -> BlockedBloom:
    """Filter over a column of 64-bit keys; ``expected`` keys set its size,
    up to :data:`MAX_BLOCKS` (more keys only raise the share of false hits)."""
    blocks = max(1, min(MAX_BLOCKS, -(-expected // KEYS_PER_BLOCK)))

    def mark(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bits = places(np.asarray(batch.column(0)).view(U64), blocks)
            for b in np.unique(block).tolist():
                word = np.bitwise_or.reduce(bits[block == b], axis=0)
                own[b] = own[b] | word if b in own else word
        data = np.array(list(own.values()), U64).reshape(-1, WORDS).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(own), pa.int64())] + [pa.array(np.ascontiguousarray(data[:, i])) for i in range(WORDS)],
            ["block"] + [f"w{i}" for i in range(WORDS)])

    columns: list[Column] = [F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    found = (map_arrow(keys.select(F.col(column).cast("long").alias("key")).where("key IS NOT NULL"), mark,
                      "block long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
             .groupBy("block").agg(*columns).toArrow())  # MAX_BLOCKS rows at most
    words = np.zeros((blocks, WORDS), U64)
    at = found.column("block").to_numpy()
    for i in range(WORDS):
        words[at, i] = found.column(f"w{i}").to_numpy().view(U64)
    return BlockedBloom(words)


def only_listed(rows: DataFrame, column: str, listed: DataFrame, key: str) -> DataFrame:
    """``rows`` whose long ``column`` is among ``listed``'s keys, and a few
    others (a join that follows drops them); rows with a null are left out."""
    words = rows.sparkSession.sparkContext.broadcast(build(listed, key, listed.count()).words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(words.value)
        for batch in batches:
            yield batch.filter(pa.array(bloom.hits(batch.column(column).to_numpy().view(U64))))

    return map_arrow(rows.where(F.col(column).isNotNull()), keep, rows.schema)
