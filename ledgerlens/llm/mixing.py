"""Operator 6: mixing sources to target weights by subset-sum budgets.

Each source gets a budget of words.  Whole repeats of the source come first;
for the rest of the budget, documents are counted by exact length, every
length gives its share (rounded down), long lengths fill up, and a
bounded-knapsack dynamic programme over the words still missing finds the
length counts that meet the budget best.  Which documents of a length are
taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.ranks import add_rank, buckets_for, dealt
from ledgerlens.llm.storage import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words that the dynamic programme settles.
LAST_WORDS = 1 << 14
#: Rows of one length that one task ranks.
ROW_GROUP = 500


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def fit_budget(lengths: list[int], counts: list[int], budget: int, last: int = LAST_WORDS) -> list[int]:
    """How many documents of each length to take, at most ``counts``, so that
    their words come as near to ``budget`` as found; for a budget of up to
    ``last`` words, as near as any choice does."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not total or budget <= 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    took, left = [0] * len(lengths), budget
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    if budget > last:
        # every length's share, rounded down; then long documents until the
        # dynamic programme can settle the rest
        took = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
        left -= sum(n * k for n, k in zip(lengths, took, strict=True))
        for i in order:
            if left <= last:
                break
            if lengths[i]:
                more = min(counts[i] - took[i], (left - last) // lengths[i] + 1, left // lengths[i])
                took[i] += more
                left -= more * lengths[i]
    for i, more in _knapsack(lengths, [c - k for c, k in zip(counts, took, strict=True)], left, order).items():
        took[i] += more
    return took


def _knapsack(lengths: list[int], free: list[int], budget: int, order: list[int]) -> dict[int, int]:
    """Bounded knapsack: the sum nearest to ``budget`` (the lower one of two).

    The sums that can be reached, up to twice the budget, are the bits of a
    number; each step adds a power of two of a length.
    """
    full = (1 << (2 * budget + 1)) - 1
    reach, steps = 1, []
    for i in order:
        n = lengths[i]
        left = min(free[i], 2 * budget // n) if n else 0
        power = 1
        while left > 0:
            take = min(power, left)
            grown = (reach | (reach << (take * n))) & full
            if grown != reach:
                steps.append((i, take, reach))
                reach = grown
            left -= take
            power *= 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> budget
    at = below
    if above and budget - below > (gap := (above & -above).bit_length() - 1):
        at = budget + gap
    took: dict[int, int] = {}
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            took[i] = took.get(i, 0) + take
            at -= take * lengths[i]
    return took


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size)`` -> with ``target`` words.

    Sources, ordered by code points with null last, weigh ``weights`` in
    turn.  The targets share ``share`` times all sizes by weight; a target
    stops at ``most`` times its source's size and the excess is shared again
    until none is above.  The table has one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = cut(sources.withColumn("weight", F.lit([float(w) for w in weights])[(place - 1) % len(weights)]))
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    cap = F.lit(most) * F.col("source_size")
    level, spent, held = 0.0, 0.0, weighted.agg(F.sum("weight")).first()[0]
    while held:
        now = (total - spent) / held
        if now <= level:
            break
        level = now
        full = F.lit(level) * F.col("weight") > cap
        spent, held = weighted.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
                                   F.sum(F.when(~full, F.col("weight")))).first()
    goal = F.least(cap, F.lit(level) * F.col("weight")) if held else cap
    return weighted.select("source", "source_size", goal.cast("double").alias("target"))


def mix(docs: DataFrame, size: Column, seed: int = 0, share: float = 1.5, most: float = 2.0,
        weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(doc, source, size, source_size, target, taken)``, one row per row of
    ``docs``; ``taken`` counts the words the mix takes of the document: 0, once
    or several times its size, ``most`` times at most.

    A null source is a source of its own, after all others.  Documents of
    size 0 are taken 0 words.  Repeated rows are documents of their own; which
    of several equal rows is taken is open, how many are is not.  Rows without
    id are chosen by size alone.  An empty table gives an empty result.  Other
    columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc"), docs[source_col].cast("string").alias("source"), size.alias("size"))
    lengths = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    plan = cut(_plan(lengths, source_targets(sources, share, most, weights)))
    same = rows["source"].eqNullSafe(plan["source"]) & (rows["size"] == plan["size"])
    planned = rows.join(plan, same).drop(plan["source"]).drop(plan["size"])
    chance = F.xxhash64(F.lit(seed), "doc")
    ranked = add_rank(planned.withColumn("chance", chance), "rank", ["source", "size"], [F.col("chance"), F.col("doc")],
                      dealt(F.xxhash64("chance"), buckets_for(F.col("n"), ROW_GROUP)))
    times = F.col("repeats") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    return ranked.select("doc", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def _plan(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, size, n, source_size, target, repeats, extra)``: one task has
    one source's distinct lengths (at most the square root of twice its words)."""
    t = targets.withColumnRenamed("source", "t_source")
    both = lengths.join(t, lengths["source"].eqNullSafe(t["t_source"])).drop("t_source")
    schema = "source string, size long, n long, source_size long, target double, repeats long, extra long"
    return both.withColumn("none", F.col("source").isNull()).groupBy("none", "source").applyInPandas(_fit(), schema)


def _fit() -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        repeats = int(target // total) if total else 0
        budget = int(np.rint(target - repeats * total)) if total else 0
        extra = fit_budget(rows["size"].tolist(), rows["n"].tolist(), budget)
        return rows.assign(repeats=repeats, extra=extra)[
            ["source", "size", "n", "source_size", "target", "repeats", "extra"]]
    return fit
