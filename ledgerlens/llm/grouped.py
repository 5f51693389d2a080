"""Exact links inside candidate groups.

A candidate join gives, for every group key, the documents that share it.
Listing all pairs of a group would grow with its square, so a group is
reduced to its smallest member (the pivot), groups with the same pivot are
merged, and the members' whole shingle sets meet in one task, which returns a
spanning forest of the verified links: at most one row per member.  Connected
components need no more than that, and no link between different sets is lost,
because every linked pair shares a group and so a pivot.

The members of a large group are dealt to blocks and first meet its smallest
one alone, which every block gets.  Those similar to it are one component already
and need no comparison among themselves; only the others, dealt to blocks of
their own, meet all members block by block.  A group of near copies so costs
each member once, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import bloom
from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import U64, map_arrow, parts_of, shingle_set, utf8

#: Shingles of a group that one block holds (8 bytes each), and members.
BLOCK_SHINGLES = 1 << 20
BLOCK_MEMBERS = 250
#: Words of the bit sketch that is compared before whole sets are.
SKETCH_WORDS = 256


def one_of_each(sizes: DataFrame) -> DataFrame:
    """``(doc)`` of ``sizes(doc, n_shingles, h1, h2)``: the smallest id of
    every set, and ids that have several sets, which tie these together."""
    firsts = sizes.groupBy("h1", "h2").agg(F.min("doc").alias("doc")).select("doc")
    several = sizes.groupBy("doc").agg(*[f(h).alias(f"{n}_{h}") for h in ("h1", "h2")
                                         for n, f in (("min", F.min), ("max", F.max))])
    several = several.where("min_h1 != max_h1 OR min_h2 != max_h2").select("doc")
    return firsts.unionByName(several).distinct()


def pivots(keys: DataFrame) -> DataFrame:
    """``keys(key, doc)`` -> distinct ``(pivot, doc)``, the pivot's own row
    included, for keys of two documents or more.

    One shuffle by key; the window holds a key's narrow rows, spilled when
    many.
    """
    by_key = Window.partitionBy("key")
    shared = (keys.withColumn("pivot", F.min("doc").over(by_key))
              .withColumn("last", F.max("doc").over(by_key)).where("pivot != last"))
    return shared.select("pivot", "doc").distinct()


def verified_links(members: DataFrame, sizes: DataFrame, texts: DataFrame, k: int,
                   percent: int) -> DataFrame:
    """Spanning links ``(a, b)`` of the pairs in a group whose ``k``-word
    shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``members(pivot, doc)`` from :func:`pivots`, ``sizes(doc, n_shingles)``,
    ``texts(doc, text)``.  A group of more than :data:`BLOCK_SHINGLES`
    shingles or :data:`BLOCK_MEMBERS` members is dealt to blocks.  A Bloom
    filter of the members keeps the texts of other documents from being
    shuffled.
    """
    n = sizes.groupBy("doc").agg(F.max("n_shingles").alias("n"))
    weight = members.join(n, "doc").groupBy("pivot").agg(
        F.sum("n").alias("total"), F.count("*").alias("m"), F.min("doc").alias("head"))
    # only large groups are dealt, so this side is short; being a table of its
    # own, it leaves Spark free to split the members of a hot pivot
    large = cut(weight.select(F.col("pivot").alias("p"), "head", _blocks(F.col("total"), F.col("m")).alias("blocks"))
                .where("blocks > 1"))
    few = bloom.only_listed(texts, "doc", members.select("doc").distinct(), "doc")

    tasks = first_deal(members, large)
    found = cut(map_arrow(_dealt(few, tasks), _forest(k, percent), "a long, b long, apart boolean"))
    links = found.where("NOT apart").select("a", "b")
    left = found.where("apart").select(F.col("a").alias("pivot"), F.col("b").alias("doc")).distinct()
    if left.isEmpty():
        return links.distinct()
    more = map_arrow(_dealt(few, second_deal(members, left, large, n)), _forest(k, percent), "a long, b long, apart boolean")
    return links.unionByName(more.select("a", "b")).distinct()


def _blocks(total: Column, members: Column) -> Column:
    return F.greatest(F.ceil(total / F.lit(BLOCK_SHINGLES)), F.ceil(members / F.lit(BLOCK_MEMBERS))).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc"), blocks).cast("int")


def first_deal(members: DataFrame, large: DataFrame) -> DataFrame:
    """``(pivot, i, j, side, member)``: small groups whole (``i`` is -1), the
    blocks of large ones (``j``), each with the group's head (``side`` 2): its
    smallest member, which is the pivot where that is a member."""
    all_ = members.join(large, F.col("pivot") == F.col("p"), "left").withColumn(
        "first", F.coalesce(F.col("doc") == F.col("head"), F.lit(False)))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    every = F.when(F.col("first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(_block(blocks)))
    return all_.select("pivot", F.when(F.col("blocks").isNull(), -1).otherwise(0).alias("i"), F.explode(every).alias("j"),
                       F.when(F.col("first"), 2).otherwise(0).alias("side"), F.col("doc").alias("member"))


def second_deal(members: DataFrame, left: DataFrame, large: DataFrame, n: DataFrame) -> DataFrame:
    """``(pivot, i, j, side, member)``: the members ``left`` (``side`` 1), in
    blocks ``i`` of their own, with every block ``j`` of their group."""
    weight = left.join(n, "doc").groupBy(F.col("pivot").alias("q")).agg(F.sum("n").alias("total"), F.count("*").alias("m"))
    counts = cut(weight.select("q", F.greatest(_blocks(F.col("total"), F.col("m")), F.lit(1)).alias("rows")).join(
        large, F.col("q") == F.col("p")).select("q", "rows", "blocks"))
    ours = (left.join(counts, F.col("pivot") == F.col("q"))
            .select("pivot", _block(F.col("rows")).alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"),
                    F.lit(1).alias("side"), F.col("doc").alias("member")))
    theirs = (members.join(counts, F.col("pivot") == F.col("q"))
              .select("pivot", F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), _block(F.col("blocks")).alias("j"),
                      F.lit(0).alias("side"), F.col("doc").alias("member")))
    return ours.unionByName(theirs)


def _dealt(texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """The texts of the members of every task, those of side 1 first."""
    return (texts.join(tasks, F.col("doc") == F.col("member")).select("pivot", "i", "j", "side", "doc", "text")
            .repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", F.desc("side"), "doc"))


def _forest(k: int, percent: int):
    """Rows ``(a, b, apart)`` of the tasks: links, and members of a large group
    ``a`` that are not similar to its head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sides, grams = None, [], [], []
        out: tuple[list, list, list] = ([], [], [])
        for whole in batches:
            for batch in parts_of(whole, "text"):
                cols = [batch.column(i).to_pylist() for i in range(5)]
                for pivot, i, j, side, doc, text in zip(*cols, utf8(batch, "text"), strict=True):
                    if (pivot, i, j) != key:
                        _links(key, docs, sides, grams, percent, out)
                        key, docs, sides, grams = (pivot, i, j), [], [], []
                    docs.append(doc)
                    sides.append(side)
                    grams.append(shingle_set(text, k))
            if len(out[0]) > 10_000:
                yield _found(out)
                out = ([], [], [])
        _links(key, docs, sides, grams, percent, out)
        yield _found(out)
    return run


def _found(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())],
                                      ["a", "b", "apart"])


def sketches(grams: list[np.ndarray], words: int) -> np.ndarray:
    """Parity bit sketches: each shingle flips one of ``64 * words`` bits, so
    two sketches differ in at most as many bits as their sets differ in
    shingles."""
    bits = words * 64
    out = np.empty((len(grams), words), U64)
    for i, g in enumerate(grams):
        flips = np.bincount((g >> U64(20)).astype(np.int64) % bits, minlength=bits) & 1
        out[i] = np.packbits(flips.astype(np.uint8)).view(U64)
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have the similarity, by whole numbers."""
    at = np.searchsorted(y, x)
    both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(key, docs, sides, grams, percent, out) -> None:
    m = len(docs)
    if m < 2:
        return
    sizes = np.array([len(g) for g in grams])
    ours = int(np.count_nonzero(sides))  # they come first; none: all members meet each other
    words = 1 << max(0, int(np.ceil(np.log2(max(1, 4 * int(sizes.max())) / 64))))
    sketch = sketches(grams, min(words, SKETCH_WORDS)) if m > 2 else None
    root = np.arange(m)
    for i in range(ours or m - 1):
        rest = np.arange(i + 1, m)
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[(100 * small >= percent * large) & (root[rest] != root[i])]
        if sketch is not None and len(rest):
            # similar sets differ in at most (100 - p) / (100 + p) of both sizes
            far = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            rest = rest[(100 + percent) * far <= (100 - percent) * (sizes[rest] + sizes[i])]
        for j in rest:
            if root[i] != root[j] and docs[i] != docs[j] and similar(grams[i], grams[j], percent):
                for column, value in zip(out, (docs[i], docs[j], False), strict=True):
                    column.append(value)
                root[root == root[j]] = root[i]
    if sides[0] == 2:
        for j in np.flatnonzero(~np.isin(root, root[:ours])):
            for column, value in zip(out, (key[0], docs[j], True), strict=True):
                column.append(value)
