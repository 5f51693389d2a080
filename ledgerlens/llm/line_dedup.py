"""Operator 3: line deduplication over a sharded minimal perfect hash.

Lines are compared by a key (stripped of ASCII white space, A-Z lower-cased)
of at least ``min_chars`` code points, known by its 128-bit hash.  Keys found
in two documents or more are dealt to shards by hash; a shard's minimal
perfect hash indexes compact arrays: the second half of the key's hash as
fingerprint, the smallest document id, the number of lines.  Documents send
only the hashes of their lines to the shards' arrays and get back the few
that fall; lines are not joined with lines.

Each shard's arrays exist once for every slice of its probes: the line counts
in the arrays say how many slices a shard needs, so a line that a third of
all documents hold is probed in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bitmaps import Lookup, build, pack
from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import U64, map_arrow, mix64, parts_of, utf8

_WHITE = b" \t\n\r\x0b\x0c"
#: Probes that one slice of a shard gets at least; twice the mean if that is more.
SLICE_PROBES = 1_000
_NO_ID = 2**63 - 1


def line_hashes(text: bytes | None, min_chars: int) -> list[tuple[int, int] | None]:
    """128-bit hash of every line's key; None for a shorter key."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(_WHITE).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            h = xxhash.xxh3_128_intdigest(key)
            out.append((h >> 64, h & 0xFFFFFFFFFFFFFFFF))
        else:
            out.append(None)
    return out


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h1, h2, doc, n)``: the distinct line keys of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "text"):
                keys: list[tuple[int, int]] = []
                owner: list[int] = []
                for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch, "text"), strict=True):
                    own = {h for h in line_hashes(text, min_chars) if h}
                    keys.extend(own)
                    owner.extend([doc] * len(own))
                both = np.array(keys, U64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])),
                     pa.array(owner, pa.int64())], ["h1", "h2", "doc"])
    return map_arrow(docs, run, "h1 long, h2 long, doc long")


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """``(shard, bits, sizes, prints, owners, counts, probes)``: the arrays of
    each shard over the keys held by two documents or more."""
    repeated = (lines.groupBy("h1", "h2")
                .agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("*").alias("n"))
                .where("owner != last")
                .withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            ids = np.asarray(batch.column("shard"))
            for s in np.unique(ids):
                own = batch.slice(int(np.searchsorted(ids, s)), int((ids == s).sum()))
                if shard is not None and s != shard:
                    yield _arrays(shard, rows)
                    rows = []
                shard = s
                rows.append(own)
        if rows:
            yield _arrays(shard, rows)

    dealt = repeated.select("shard", "h1", "h2", "owner", "n").repartition("shard").sortWithinPartitions("shard")
    return map_arrow(dealt, arrays, "shard int, bits binary, sizes array<int>, prints binary, owners binary, "
                                    "counts binary, probes long")


def _arrays(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows)
    h1, h2 = (table.column(c).to_numpy().view(U64) for c in ("h1", "h2"))
    owner, n = (table.column(c).to_numpy() for c in ("owner", "n"))
    bits, sizes = pack(build(h1, h2))
    at = Lookup(bits, sizes)(h1, h2)
    prints, owners, counts = np.empty_like(h2), np.empty_like(owner), np.empty(len(n), np.uint32)
    prints[at], owners[at], counts[at] = h2 ^ mix64(h1), owner, np.minimum(n, 0xFFFFFFFF)
    return pa.RecordBatch.from_arrays(
        [pa.array([int(shard)], pa.int32()), pa.array([bits]), pa.array([sizes], pa.list_(pa.int32())),
         pa.array([prints.tobytes()]), pa.array([owners.tobytes()]), pa.array([counts.tobytes()]),
         pa.array([int(n.sum())], pa.int64())],
        ["shard", "bits", "sizes", "prints", "owners", "counts", "probes"])


def dropped_lines(docs: DataFrame, min_chars: int, shards: int | None = None) -> DataFrame:
    """``(doc, fallen)``: for documents that lose lines, the first halves of
    the fallen keys' hashes (all halves of a document's keys being distinct,
    but for hash collisions, which the second halves settle in the arrays)."""
    lines = _lines(docs, min_chars)
    if shards is None:
        shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = cut(line_index(lines, shards))
    # as many slices as keep a shard near the usual one: a number per shard,
    # whatever the number of lines
    found = {r["shard"]: r["probes"] for r in index.select("shard", "probes").collect()}
    usual = max(SLICE_PROBES, 2 * sum(found.values()) // shards)
    slices = [max(1, -(-found.get(s, 0) // usual)) for s in range(shards)]
    n = F.lit(slices)[F.col("shard")]
    shard = F.pmod("h1", F.lit(shards)).cast("int")
    probes = (lines.withColumn("shard", shard)
              .withColumn("slice", F.pmod(F.xxhash64("doc"), n).cast("int"))
              .select("shard", "slice", F.lit(1).alias("kind"), "h1", "h2", "doc",
                      *[F.lit(None).cast(t).alias(c) for c, t in (
                          ("bits", "binary"), ("sizes", "array<int>"), ("prints", "binary"), ("owners", "binary"))]))
    arrays = (index.withColumn("slice", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
              .select("shard", "slice", F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c)
                                                                 for c in ("h1", "h2", "doc")],
                      "bits", "sizes", "prints", "owners"))
    dealt = arrays.unionByName(probes).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind")
    met = map_arrow(dealt, _probe, "doc long, h1 long")
    return met.groupBy("doc").agg(F.collect_list("h1").alias("fallen"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes that follow their shard's arrays in the sort order."""
    at = lookup = prints = owners = None
    for batch in batches:
        shard, part, kind = (np.asarray(batch.column(c)) for c in ("shard", "slice", "kind"))
        starts = np.flatnonzero((np.diff(shard, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)
                                | (kind == 0))
        starts = np.unique(np.append(starts, 0)) if batch.num_rows else starts
        for start, stop in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            first = int(start)
            if kind[first] == 0:
                row = batch.slice(first, 1).to_pylist()[0]
                at = (row["shard"], row["slice"])
                lookup = Lookup(row["bits"], row["sizes"])
                prints, owners = np.frombuffer(row["prints"], U64), np.frombuffer(row["owners"], np.int64)
                first += 1
            if first == stop or at != (int(shard[first]), int(part[first])):
                continue  # a shard without repeated lines
            h1, h2, doc = (np.asarray(batch.column(c).slice(first, int(stop) - first)) for c in ("h1", "h2", "doc"))
            u1, u2 = h1.astype(np.int64).view(U64), h2.astype(np.int64).view(U64)
            index = lookup(u1, u2)
            safe = np.maximum(index, 0)
            falls = (index >= 0) & (prints[safe] == (u2 ^ mix64(u1))) & (owners[safe] != doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[falls].astype(np.int64)), pa.array(h1[falls].astype(np.int64))], ["doc", "h1"])


def line_dedup(docs: DataFrame, min_chars: int = 10, shards: int | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(doc, n_lines, n_dropped, kept)``, one row per row of ``docs``.

    Texts are split at ``\\n``.  A line whose key is found in two documents or
    more stays only in the document with the smallest id (all its lines with
    that key stay there); ``kept`` is the remaining lines joined by ``\\n``.

    Null and empty texts are one empty line, which stays.  Rows without id
    count as one document after all others; rows with the same id count as
    one document.  Other columns are not read.
    """
    doc = F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID))
    rows = docs.select(doc.alias("doc"), docs[text_col].alias("text"))
    fallen = dropped_lines(rows, min_chars, shards).withColumnRenamed("doc", "f_doc")
    joined = rows.join(fallen, F.col("doc") == F.col("f_doc"), "left").select("doc", "text", "fallen")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "text"):
                n_lines, n_dropped, kept = [], [], []
                for text, drop in zip(utf8(batch, "text"), batch.column("fallen").to_pylist(), strict=True):
                    lines = (text or b"").split(b"\n")
                    left = lines
                    if drop:
                        gone = set(drop)
                        left = [x for x, h in zip(lines, line_hashes(text, min_chars), strict=True)
                                if h is None or _signed(h[0]) not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                    kept.append(text or b"" if not drop else b"\n".join(left))
                ids = batch.column("doc").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == _NO_ID else i for i in ids], pa.int64()),
                     pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                    ["doc", "n_lines", "n_dropped", "kept", "kept_sha256"])

    return map_arrow(joined, keep, "doc long, n_lines long, n_dropped long, kept string, kept_sha256 string")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x
