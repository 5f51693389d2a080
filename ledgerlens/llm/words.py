"""Splitting texts into words and hashing words and shingles.

Texts travel between Spark and numpy as Arrow batches.  Words are runs of
anything but the six ASCII white-space characters, compared with A-Z
lower-cased; other letters keep their case.  Both are exactly what
``bytes.lower`` and ``bytes.split`` do on UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARK_DEFAULT = "67108864b"
U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_MIX1 = U64(0xBF58476D1CE4E5B9)
_MIX2 = U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in text order.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(k, n)
    acc = np.full(n - k + 1, k, U64)
    for j in range(k):
        acc = (acc ^ word_hashes[j:n - k + 1 + j]) * _MUL
        acc ^= acc >> U64(29)
    return mix64(acc)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return np.unique(shingles(hash_words(words_of(text)), k))


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    col = batch.column(column)
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type)
                    else pa.binary()).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most :data:`BATCH_BYTES`.

    Spark's default of 64 MB is too much for executors of a few GB, which hold
    several batches outside the heap; a session with another value keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _SPARK_DEFAULT:
        conf.set(_BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def parts_of(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` bytes of ``column``
    (a single larger text is a slice of its own)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
