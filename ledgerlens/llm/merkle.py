"""Operator 12: Merkle manifests of a dataset, with a version per tampered leaf.

Every row is a leaf: the SHA-256 of its fields.  Leaves of a group ascend by
id; every ``FAN`` consecutive nodes (the last run fewer, even one) are hashed
into one until one is left, the group's subroot; subroots ascend by group and
give the root by the same rule.

The tree is built where its leaves are.  ``FAN ** DEPTH`` consecutive leaves of
a group are an aligned block: one task builds the block's subtree and sends its
root up.  Above, a level is one aggregation over nodes, ``FAN`` at most to a
group, until one root is left; then every node learns the siblings on its way
up, level by level down.

A tampered leaf makes a version of the tree: its ancestors are copied, every
other node is shared with the untouched tree (nodes never change, so sharing
needs no lock and no copy).  Inside the block the copies are made on the
block's own levels; the copied block root goes on through the siblings that
the upper levels sent down.  Versions are independent of each other, so their
number is bounded by nothing but the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import map_arrow

#: Children of a node.
FAN = 8
#: Levels of an aligned block: 4,096 leaves.
DEPTH = 4
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A leaf's field: ``-`` for null, else the UTF-8 length, ``:``, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The leaf of a row: the SHA-256 of its fields, as lowercase hex."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def runs_up(leaves: int, fan: int = FAN) -> int:
    """Levels above a group of that many nodes."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fan), levels + 1
    return levels


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``pos`` (0, 1, ... within each group, by ``order``) and ``n`` (rows of the group).

    One range shuffle by group and order; the counts of a group in each range
    (a row per group and range) give the ranges' first places.  The numbered
    rows are kept as checkpoint files, so their ranges can't change between
    the count and its use.  Nulls come first.
    """
    key = [*group, *order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            here = np.empty(batch.num_rows, np.int64)
            if group:
                for i, now in enumerate(zip(*(batch.column(g).to_pylist() for g in group), strict=True)):
                    seen = seen + 1 if now == last else 0
                    here[i], last = seen, now
            else:
                here[:] = np.arange(seen, seen + batch.num_rows)
                seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(here)],
                [*batch.schema.names, "num_part", "num_here"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = cut(map_arrow(df.repartitionByRange(*key).sortWithinPartitions(*key), count,
                         f"{fields}, num_part int, num_here long"))
    counts = rows.groupBy(*group, "num_part").agg(F.count("*").alias("num_rows"))
    whole = Window.partitionBy(*[F.col(g) for g in group])
    before = whole.orderBy("num_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(*[F.col(g).alias(f"num_{g}") for g in group], F.col("num_part").alias("num_at"),
                           F.coalesce(F.sum("num_rows").over(before), F.lit(0)).alias("num_before"),
                           F.sum("num_rows").over(whole).alias("n"))
    same = F.col("num_part") == F.col("num_at")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"num_{g}"))
    return rows.join(places, same).withColumn("pos", F.col("num_before") + F.col("num_here")).drop(
        "num_part", "num_here", "num_at", "num_before", *[f"num_{g}" for g in group])


def _parents(level: list[str], fan: int) -> list[str]:
    return [digest("".join(level[i:i + fan])) for i in range(0, len(level), fan)]


def block_levels(leaves: list[str], levels: int, fan: int = FAN) -> list[list[str]]:
    """A block's nodes, its leaves first, ``levels`` levels above them."""
    out = [leaves]
    for _ in range(levels):
        out.append(_parents(out[-1], fan))
    return out


def siblings(levels: list[list[str]], place: int, fan: int = FAN) -> list[tuple[str, str]]:
    """For each level of a block, the digests left and right of the leaf's
    ancestor in its run, joined."""
    out = []
    for level in levels[:-1]:
        low = place - place % fan
        out.append(("".join(level[low:place]), "".join(level[place + 1:low + fan])))
        place //= fan
    return out


def path_copy(changed: str, way: list[tuple[str, str]]) -> list[str]:
    """The copied ancestors of a changed leaf, lowest first: each is its run
    hashed anew with the copy below in place; all siblings are shared."""
    copies, node = [], changed
    for left, right in way:
        node = digest(left + node + right)
        copies.append(node)
    return copies


def _block_rows(group: str) -> Callable[[tuple, pa.Table], pa.Table]:
    def root(key: tuple, leaves: pa.Table) -> pa.Table:
        g, block = (k.as_py() for k in key)
        leaves = leaves.sort_by("pos")
        n = leaves.column("n")[0].as_py()
        levels = block_levels([x.hex() for x in leaves.column("leaf").to_pylist()], min(DEPTH, runs_up(n)))
        size = -(-n // FAN ** DEPTH)
        return pa.table({group: pa.array([g], pa.string()), "idx": pa.array([block], pa.int64()),
                         "m": pa.array([size], pa.int64()), "node": pa.array([levels[-1][0]], pa.string())})
    return root


def _levels_up(nodes: DataFrame, group: list[str], most: int) -> list[DataFrame]:
    """The nodes of every level of the groups' trees, from ``nodes`` on; a
    finished tree's root goes up as it is.  ``most``: nodes of the largest."""
    out = [nodes]
    for _ in range(runs_up(most)):
        run = F.array_sort(F.collect_list(F.struct("idx", "node")))
        up = (out[-1].groupBy(*group, "m", F.expr(f"idx div {FAN}").alias("up")).agg(run.alias("run"))
              .withColumn("node", F.when(F.col("m") == 1, F.col("run")[0]["node"]).otherwise(
                  F.sha2(F.array_join(F.col("run")["node"], ""), 256))))
        out.append(cut(up.select(*group, F.col("up").alias("idx"), F.ceil(F.col("m") / FAN).cast("long").alias("m"), "node")))
    return out


def _paths_down(levels: list[DataFrame], group: list[str], top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(group, idx, way)`` of the lowest level's nodes: ``way`` is the list of
    (left, right) siblings up to the root.  ``top`` gives the highest nodes
    theirs (``way`` above the group's tree)."""
    known = top(levels[-1]).select(*group, "idx", "way")
    for level in reversed(levels[:-1]):
        run = F.array_sort(F.collect_list(F.struct("idx", "node")))
        runs = level.groupBy(*group, "m", F.expr(f"idx div {FAN}").alias("up")).agg(run.alias("run"))
        above = known.select(*[F.col(g).alias(f"a_{g}") for g in group], F.col("idx").alias("a_idx"), F.col("way").alias("a_way"))
        same = F.col("up") == F.col("a_idx")
        for g in group:
            same &= F.col(g) == F.col(f"a_{g}")
        nodes = runs.join(above, same).select(*group, "m", "run", "a_way", F.posexplode("run").alias("at", "one"))
        names = F.transform(F.col("run"), lambda r: r["node"])
        left = F.array_join(F.slice(names, F.lit(1), F.col("at")), "")
        right = F.array_join(F.slice(names, F.col("at") + 2, F.lit(FAN)), "")
        own = F.array(F.struct(left.alias("left"), right.alias("right")))
        known = cut(nodes.select(*group, F.col("one.idx").alias("idx"),
                                 F.when(F.col("m") == 1, F.col("a_way")).otherwise(F.concat(own, "a_way")).alias("way")))
    return known


def manifest(rows: DataFrame) -> DataFrame:
    """``(doc, leaf, subroot, root, proof_sha256, copies, folded_root, verified)``
    of every row of ``rows``: ``(doc, grp, leaf, tampered)``.

    ``leaf`` and ``tampered`` (null: not tampered) are hex digests, ``grp`` a
    string that is never null and whose byte order is the groups' order.
    ``proof_sha256`` is the hash of all siblings on the way from the leaf to
    the root, left to right in each level.  ``copies`` are the nodes of the
    version that the tampered leaf makes, lowest first and the root last
    (untampered: none); ``folded_root`` is that root, or the one recomputed
    from the leaf and its siblings; ``verified`` tells whether it is the root.

    Rows without id come first; rows of one id by their leaf (equal rows in any
    order, their results differ by their places).  An empty table gives none.
    """
    thin = cut(rows.select(F.col("doc").cast("long").alias("doc"), "grp", F.unhex("leaf").alias("leaf"),
                           F.unhex("tampered").alias("tampered")))
    leaves = numbered(thin, ["grp"], ["doc", "leaf"]).withColumn("block", F.expr(f"pos div {FAN ** DEPTH}"))
    block_roots = cut(leaves.select("grp", "block", "pos", "n", "leaf").groupBy("grp", "block").applyInArrow(
        _block_rows("grp"), "grp string, idx long, m long, node string"))
    most, groups = block_roots.agg(F.coalesce(F.max("m"), F.lit(0)), F.count_distinct("grp")).first()
    trees = _levels_up(block_roots, ["grp"], most)
    subroots = cut(numbered(trees[-1].select("grp", "node"), [], ["grp"]).select(
        "grp", F.col("pos").alias("idx"), F.col("n").alias("m"), "node"))
    upper = _levels_up(subroots.select("idx", "m", "node"), [], groups)
    ways = _paths_down(upper, [], lambda d: d.withColumn("way", F.array().cast("array<struct<left:string,right:string>>")))
    over = subroots.select(F.col("grp").alias("o_grp"), F.col("idx").alias("o_idx"), F.col("node").alias("subroot")).join(
        ways.select(F.col("idx").alias("w_idx"), F.col("way").alias("o_way")), F.col("o_idx") == F.col("w_idx"))
    over = cut(over.select("o_grp", "subroot", "o_way"))
    blocks = _paths_down(trees, ["grp"], lambda d: d.join(over, F.col("grp") == F.col("o_grp")).withColumn("way", F.col("o_way")))
    root = upper[-1].select("node").first()
    return _prove(leaves, blocks.join(over.select("o_grp", "subroot"), F.col("grp") == F.col("o_grp")).drop("o_grp"),
                  root["node"] if root else None)


def _prove(leaves: DataFrame, blocks: DataFrame, root: str | None) -> DataFrame:
    """Rows of :func:`manifest`: the leaves of every block with its way up."""
    def prove(key: tuple, mine: pa.Table, up: pa.Table) -> pa.Table:
        mine = mine.sort_by("pos")
        n, top = mine.column("n")[0].as_py(), up.to_pylist()[0]
        levels = block_levels([x.hex() for x in mine.column("leaf").to_pylist()], min(DEPTH, runs_up(n)))
        upper = [(w["left"], w["right"]) for w in top["way"]]
        upper_proof = "".join(x + y for x, y in upper)
        proofs, copies, folded = [], [], []
        untouched = path_copy(levels[-1][0], upper)  # the way up that untampered leaves of the block share
        for place, changed in enumerate(mine.column("tampered").to_pylist()):
            way = siblings(levels, place)
            proofs.append(digest("".join(x + y for x, y in way) + upper_proof))
            if changed is None:
                node = path_copy(levels[0][place], way)
                node = node[-1] if node else levels[0][place]
                folded.append((untouched[-1] if untouched else node) if node == levels[-1][0] else None)
                copies.append(None)
            else:
                copied = path_copy(changed.hex(), way + upper)
                folded.append(copied[-1] if copied else changed.hex())
                copies.append(copied)
        size = mine.num_rows
        return pa.table({
            "doc": mine.column("doc"), "leaf": pa.array(levels[0], pa.string()),
            "subroot": pa.array([top["subroot"]] * size, pa.string()), "root": pa.array([root] * size, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "copies": pa.array(copies, pa.list_(pa.string())),
            "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})

    left = leaves.select("grp", "block", "pos", "n", "doc", "leaf", "tampered").groupBy("grp", "block")
    right = blocks.select("grp", F.col("idx").alias("block"), "way", "subroot").groupBy("grp", "block")
    return left.cogroup(right).applyInArrow(
        prove, "doc long, leaf string, subroot string, root string, proof_sha256 string, copies array<string>, "
               "folded_root string, verified boolean")


def document_manifest(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                      id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """:func:`manifest` of documents, a tree per language; where ``tampered``
    holds, the text's A-Z are lower-cased after the manifest was made (null
    texts stay).  A null language is a group of its own, before all others.
    Only ``fields`` are hashed; other columns are not read.
    """
    changed = F.translate(docs[text_col], ASCII_UPPER, ASCII_LOWER)
    values = [docs[c] for c in fields]
    after = [changed if c == text_col else docs[c] for c in fields]
    grp = F.coalesce(F.concat(F.lit("1"), docs[group_col]), F.lit("0"))
    return manifest(docs.select(docs[id_col].alias("doc"), grp.alias("grp"), leaf(*values).alias("leaf"),
                                F.when(F.coalesce(tampered, F.lit(False)), leaf(*after)).alias("tampered")))
