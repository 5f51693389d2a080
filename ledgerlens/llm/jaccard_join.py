"""Operator 7: n-gram Jaccard join by parity sketches.

Every document is its set of distinct ``k``-word shingles.  Shingle hashes
are XOR-ed into a bit sketch of as many parts as the size band asks for; a
shingle flips one bit of one part, so sketches differ in at most as many bits
as the sets differ in shingles.  Two sets with the wanted similarity differ
in at most ``d`` shingles; with more than ``d`` non-empty parts, one part at
least is equal (pigeonhole), and documents meet there.  A part is wide (its
bit positions are 64-bit numbers) and is stored as the XOR of its set bits'
positions.  Of a document's parts, the ``d + 1`` fullest are enough (prefix
of a global order), which leaves out the near-empty ones that unrelated
documents share.  Whole sets are then compared: first their short bit
sketches, then the sets.

Size bands: a band holds sizes from L to about 1.4 L.  A document joins in
its own band's parts and, as the larger side, in the bands below that still
hold a possible partner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bloom, grouped
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import U64, map_arrow, mix64, parts_of, shingle_set, utf8

_MAX_SIZE = 1 << 33


def band_limits(percent: int) -> np.ndarray:
    """Lower limits of the size bands."""
    ratio = max(1.4, 110 / percent)
    limits = [1]
    while limits[-1] < _MAX_SIZE:
        limits.append(max(limits[-1] + 1, int(np.ceil(ratio * limits[-1]))))
    return np.array(limits)


def part_keys(grams: np.ndarray, percent: int, limits: np.ndarray) -> np.ndarray:
    """Join keys of a document with the distinct shingle hashes ``grams``."""
    n = len(grams)
    if not n:
        return np.empty(0, U64)
    home = int(np.searchsorted(limits, n, "right")) - 1
    smallest = -(-percent * n // 100)
    out = []
    band = home
    while band >= 0 and (band == home or limits[band + 1] - 1 >= smallest):
        top = int(limits[band + 1]) - 1
        widest = (100 - percent) * top // percent
        parts = widest + 1 + -(-15 * widest // 100)
        if band == home:
            d = (100 - percent) * n // percent
        else:
            d = (100 - percent) * (n + top) // (100 + percent)
        part = (grams % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        flips = mix64(grams + U64(band + 1))[order]
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        count = np.diff(starts, append=n)
        xor = np.bitwise_xor.reduceat(flips, starts)
        where = part[order][starts].astype(U64)
        if len(starts) < d + 1:  # empty parts are needed too: only in tiny sets
            empty = np.setdiff1d(np.arange(parts), part)
            where = np.concatenate([where, empty.astype(U64)])
            xor = np.concatenate([xor, np.zeros(len(empty), U64)])
            count = np.concatenate([count, np.zeros(len(empty), np.int64)])
        key = mix64(xor ^ mix64(where + (U64(band + 1) << U64(40))))
        if len(key) > d + 1:
            key = key[np.lexsort((key, -count))[:d + 1]]
        out.append(key)
        band -= 1
    return np.concatenate(out)


def shingle_sizes(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, n_shingles, h1, h2)``: set size and a 128-bit hash of the set.

    Texts without words have size 0 and null hashes.
    """
    def run(batches):
        for whole in batches:
            for batch in parts_of(whole, "text"):
                n, h1, h2 = [], [], []
                for text in utf8(batch, "text"):
                    g = shingle_set(text, k)
                    n.append(len(g))
                    h1.append(int(np.bitwise_xor.reduce(mix64(g + U64(77))).view(np.int64)) if len(g) else None)
                    h2.append(int(np.add.reduce(mix64(g ^ U64(0xA5A5))).view(np.int64)) if len(g) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                     pa.array(h2, pa.int64())], ["doc", "n_shingles", "h1", "h2"])
    return map_arrow(_texts(docs, id_col, text_col), run, "doc long, n_shingles long, h1 long, h2 long")


def candidate_keys(docs: DataFrame, k: int, percent: int, firsts: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(key, doc)``: the part keys of every document with words and an id
    that is one of ``firsts(doc)``, and of a few others that a Bloom filter of
    these lets through; within a task, copies that it does are sent once.
    """
    limits = band_limits(percent)
    listed = docs.sparkSession.sparkContext.broadcast(bloom.build(firsts, "doc", firsts.count()).words)

    def run(batches):
        seen: set[bytes] = set()
        first = bloom.BlockedBloom(listed.value)
        for whole in batches:
            for part in parts_of(whole, "text"):
                batch = part.filter(pa.array(first.hits(part.column("doc").to_numpy().view(U64))))
                ids, keys = [], []
                for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch, "text"), strict=True):
                    grams = shingle_set(text, k)
                    if not len(grams):
                        continue
                    digest = xxhash.xxh3_128_digest(grams.tobytes())
                    if digest in seen:
                        continue
                    if len(seen) >= 200_000:  # forgetting only sends a copy again
                        seen.clear()
                    seen.add(digest)
                    own = part_keys(grams, percent, limits)
                    keys.append(own)
                    ids.append(np.full(len(own), doc, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))],
                        ["key", "doc"])
    return map_arrow(_texts(docs, id_col, text_col).where("doc IS NOT NULL"), run, "key long, doc long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``(doc, n_shingles, component)``, one row per row of ``docs``.

    Two documents link when the Jaccard similarity of their ``k``-word
    shingle sets is ``percent`` / 100 or more; ``component`` is the smallest
    id reachable by links, the document's own included.

    Null or empty texts (no words) have size 0 and link with nothing.  A
    repeated row gets what the first one gets.  A row without id belongs to
    the component of the equal sets that have one (null if none has).  Other
    columns of ``docs`` are not read, so their names don't matter.
    """
    sizes = cut(shingle_sizes(docs, k, id_col, text_col))
    named = sizes.where("n_shingles > 0 AND doc IS NOT NULL")
    # copies of a set are one class: only the first of each is compared
    firsts = cut(grouped.one_of_each(named))
    keys = candidate_keys(docs, k, percent, firsts, id_col, text_col)
    members = cut(grouped.pivots(keys).join(firsts, "doc", "left_semi").select("pivot", "doc"))
    links = grouped.verified_links(members, named, _texts(docs, id_col, text_col), k, percent)
    roots = connected_components(links)
    return class_components(sizes, roots)


def class_components(sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """Components of all rows from the roots of the linked ones.

    Equal sets are one class, named by its smallest id; the rows of a class
    share a component whether or not each of them took part in the join.
    """
    named = sizes.where("n_shingles > 0 AND doc IS NOT NULL")
    classes = named.groupBy("h1", "h2").agg(F.min("doc").alias("class"))
    rooted = (roots.join(named, F.col("node") == F.col("doc"))
              .groupBy(F.col("h1").alias("r1"), F.col("h2").alias("r2")).agg(F.min("root").alias("root")))
    of_class = classes.join(rooted, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
    least = (of_class.where("root IS NOT NULL").groupBy(F.col("root").alias("r"))
             .agg(F.min("class").alias("least")))
    named_classes = of_class.join(least, F.col("root") == F.col("r"), "left").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("least", "class").alias("component"))
    joined = sizes.join(named_classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    return joined.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
