"""Operator 5: sharding by balanced label propagation.

Documents that share a link key (here: equal texts) are linked.  Every
document starts in a shard by rank, so that all shards are even.  In each
round, a Spark aggregation counts the members of every link in every shard,
and a join tells each linked document the shard where most of its neighbours
are; it moves there if the round's quota lets it.  Quotas come from the free
places of the shards, with some more than the capacity while documents move,
and from opposite wishes, which swap; a group larger than a shard fills
several.  At the end, shards above their capacity hand the surplus, link by
link, to shards with room, and documents without links take the places that
are left, which makes the row counts of the shards differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.ranks import add_rank, dealt
from ledgerlens.llm.storage import cut

ROUNDS = 16
#: Steps in which a wish can be granted in part.
STEPS = 256
#: How far shards may be above their capacity between rounds.
SLACK = 0.25


def _buckets(rows: int) -> int:
    """Buckets to rank rows in: as many as each has rows, so that neither the
    rows of a bucket nor the buckets are many for one task."""
    return max(1, math.isqrt(rows))


def capacities(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard; they differ by one at most."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def grant(wishes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many steps of each wish to grant.

    ``wishes[i, j, step]`` rows want to move from shard i to j.  The granted
    steps are a prefix; no shard gains more than ``room`` on balance.
    """
    shards = len(room)
    total = wishes.sum(axis=2)
    allowed = np.minimum(total, total.T)  # swaps
    left = room.copy()
    for j in range(shards):
        for i in np.argsort(-(total[:, j] - allowed[:, j]), kind="stable"):
            more = min(int(left[j]), int(total[i, j] - allowed[i, j]))
            allowed[i, j] += more
            left[j] -= more
    sums = np.concatenate([np.zeros((shards, shards, 1), np.int64), np.cumsum(wishes, axis=2)], axis=2)
    steps = (sums <= allowed[:, :, None]).sum(axis=2) - 1
    while True:  # whole steps may leave a swap uneven: take steps back until all fits
        moved = np.take_along_axis(sums, steps[:, :, None], axis=2)[:, :, 0]
        over = moved.sum(axis=0) - moved.sum(axis=1) - room
        j = int(np.argmax(over))
        if over[j] <= 0:
            return steps
        i = int(np.argmax(moved[:, j]))
        steps[i, j] -= 1


def propagate(linked: DataFrame, capacity: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of moves of ``linked(..., link, spread, shard)``; a new ``shard``."""
    shards = len(capacity)
    state, idle = cut(linked), 0
    for turn in range(rounds):
        room = capacity - _loads(state, shards)
        tally = state.groupBy("link", "shard").agg(F.count("*").alias("n"))
        # the shard with most members, a hash settling ties; every other turn
        # only among shards with room
        pull = F.struct("n", F.xxhash64("link", "shard").alias("tie"), F.col("shard").alias("to"))
        open_to = F.lit([bool(r > 0) for r in room])[F.col("shard")] if turn % 2 == 0 else F.lit(True)
        by_link = Window.partitionBy("link")
        wishes = (tally.withColumn("own", pull).withColumn("best", F.max(F.when(open_to, pull)).over(by_link))
                  .where("best > own").select(F.col("link").alias("w_link"), F.col("shard").alias("w_shard"),
                                              F.col("best.to").alias("to"), F.col("n").alias("movers")))
        # a small group moves whole, a large one in parts
        whole = F.col("movers") <= F.lit(max(1, int(capacity.max()) // STEPS))
        step = F.pmod(F.when(whole, F.xxhash64("link", "shard", F.lit(turn))).otherwise(F.col("spread")), F.lit(STEPS))
        asked = (state.join(wishes, (F.col("link") == F.col("w_link")) & (F.col("shard") == F.col("w_shard")), "left")
                 .withColumn("step", F.when(F.col("to").isNotNull(), step).cast("int")))
        asked = cut(asked.drop("w_link", "w_shard", "movers"))
        table = np.zeros((shards, shards, STEPS), np.int64)
        for i, j, s, n in asked.where("to IS NOT NULL").groupBy("shard", "to", "step").count().collect():
            table[i, j, s] = n  # shards * shards * STEPS numbers at most
        steps = grant(table, room)
        moved = int(sum(table[i, j, :steps[i, j]].sum() for i in range(shards) for j in range(shards)))
        limit = F.lit(steps.ravel().tolist())[F.col("shard") * shards + F.col("to")]
        state = asked.withColumn("shard", F.when(F.col("to").isNotNull() & (F.col("step") < limit), F.col("to"))
                                 .otherwise(F.col("shard"))).drop("to", "step")
        idle = 0 if moved else idle + 1
        if idle == 2 or not table.any() and turn % 2:
            break
        if moved:
            state = cut(state)
    return state


def _loads(rows: DataFrame, shards: int) -> np.ndarray:
    load = np.zeros(shards, np.int64)
    for shard, n in rows.groupBy("shard").count().collect():  # a number per shard
        load[shard] = n
    return load


def _trim(placed: DataFrame, capacity: np.ndarray, order: list[Column]) -> DataFrame:
    """Move what shards hold above ``capacity`` to shards with room.

    Rows are ranked by link, so that a surplus is whole groups but for one,
    and those go to a shard together.
    """
    load = _loads(placed, len(capacity))
    if (load <= capacity).all():
        return placed
    placed = cut(placed)
    by_link = [F.xxhash64("link"), F.col("link"), *order]

    def bucket(rows: int) -> Column:  # of links; a large one is in several
        n = _buckets(rows)
        part = F.pmod(F.col("spread"), F.greatest(F.lit(1), F.expr(f"members div {n}")))
        return dealt(F.xxhash64("link", part), F.lit(n))

    ranked = cut(add_rank(placed, "rank", ["shard"], by_link, bucket(int(load.max()))))
    over = F.col("rank") >= F.lit(capacity.tolist())[F.col("shard")]
    ends = np.cumsum(np.maximum(capacity - load, 0))
    out = add_rank(ranked.where(over).drop("rank").withColumn("one", F.lit(0)), "rank", ["one"], by_link,
                   bucket(int(np.maximum(load - capacity, 0).sum())))
    to = F.size(F.filter(F.lit(ends.tolist()), lambda e: e <= F.col("rank"))).cast("int")
    return cut(ranked.where(~over).drop("rank").unionByName(out.withColumn("shard", to).drop("rank", "one")))


def balanced_shards(rows: DataFrame, link: Column, order: list[Column], shards: int = 16,
                    rounds: int = ROUNDS) -> DataFrame:
    """``rows`` with ``shard`` (0 .. shards - 1) and ``slot`` (0, 1, ... in each
    shard): row counts of the shards differ by one at most, rows with an equal
    ``link`` are together as far as that allows.

    Null links and links of a single row are no links.  ``order`` makes the
    result repeatable; rows equal in it and in ``link`` may swap places.  Own
    columns called ``link``, ``spread``, ``members``, ``shard`` or ``slot`` are
    an error.
    An empty table gives an empty result.
    """
    taken = {"link", "spread", "members", "shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} would be overwritten")
    base = rows.withColumn("link", link).withColumn("spread", F.xxhash64(*order))
    # a table of its own, so that Spark is free to split a hot link in the join
    shared = cut(base.where("link IS NOT NULL").groupBy(F.col("link").alias("s_link")).agg(F.count("*").alias("members"))
                 .where("members > 1"))
    marked = cut(base.join(shared, F.col("link") == F.col("s_link"), "left"))
    free = marked.where("s_link IS NULL").drop("s_link", "members")
    linked = marked.where("s_link IS NOT NULL").drop("s_link")
    n_linked, n = marked.agg(F.count("s_link"), F.count("*")).first()
    capacity = capacities(n, shards)

    start = add_rank(linked.withColumn("one", F.lit(0)), "rank", ["one"], order,
                     dealt(F.col("spread"), F.lit(_buckets(n_linked))))
    loose = capacity + np.ceil(SLACK * capacity).astype(np.int64)
    placed = propagate(start.withColumn("shard", (F.col("rank") % shards).cast("int")).drop("rank", "one"), loose, rounds)
    placed = _trim(placed, capacity, order)
    load = _loads(placed, shards)
    placed = add_rank(placed, "slot", ["shard"], order,
                      dealt(F.col("spread"), F.lit(_buckets(int(load.max())))))
    ends = np.cumsum(capacity - load)
    ranked = add_rank(free.withColumn("one", F.lit(0)), "rank", ["one"], order,
                      dealt(F.col("spread"), F.lit(_buckets(n - n_linked)))).drop("one")
    shard = F.size(F.filter(F.lit(ends.tolist()), lambda e: e <= F.col("rank")))
    starts = F.lit((load - np.concatenate([[0], ends[:-1]])).tolist())
    filled = (ranked.withColumn("shard", shard.cast("int"))
              .withColumn("slot", F.col("rank") + starts[F.col("shard")]).drop("rank"))
    return placed.drop("members").unionByName(filled).drop("link", "spread")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, size, text_crc32, shard, slot)`` for documents linked by equal
    texts; ``size`` is the UTF-8 bytes plus 1.

    Null texts have size 1 and no link; empty texts are equal texts.  Rows
    without id and repeated rows are documents like others; other columns are
    not read.  Only ids, sizes and hashes are shuffled.
    """
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("doc"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
                       F.when(text.isNotNull(), F.xxhash64(text)).alias("text_hash"))
    # 96 bits and the length: one hash of both is enough to group, and grouping alone depends on it
    link = F.when(F.col("text_hash").isNotNull(), F.xxhash64("text_hash", "text_crc32", "size"))
    out = balanced_shards(rows, link, [F.col("doc"), F.col("text_hash"), F.col("size")], shards)
    return out.select("doc", "size", "text_crc32", "shard", "slot")
