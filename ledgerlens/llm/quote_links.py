"""Operator 10: chat formatting by quotation linking, in DataFrame functions.

Lines that start with ``>`` marks quote an earlier message; the number of
marks is the nesting level.  A passage is a run of lines of one level.  Each
of its lines, normalised (marks off, white space collapsed, lower-cased), is
hashed and joined to the own lines of earlier messages of the conversation;
the message with most of the passage's lines is its source, the latest of
several.  A message replies to the source of its first passage of the lowest level that has one,
else to the message before it.  Replies form a tree, and conversations come
out in reply order with the quotes taken out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.ranks import add_rank
from ledgerlens.llm.storage import cut

_MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
#: Messages of a conversation that one task orders.
BLOCK = 4096
#: Messages with a line that are listed for every passage that quotes it; the
#: votes of commoner lines are counted once for each set of them.
COMMON = 32
#: Rounds of path doubling: enough for branches 2^40 deep.
MAX_DOUBLINGS = 40


def quote_level(line: Column) -> Column:
    """Number of ``>`` marks a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def without_marks(line: Column) -> Column:
    return F.regexp_replace(line, _MARKS, "")


def normalised(line: Column) -> Column:
    """What quoted and original lines are compared by; empty for blank lines."""
    return F.trim(F.regexp_replace(F.lower(without_marks(line)), r"[\s\x{A0}]+", " "))


def own_text(text: Column) -> Column:
    """The text without its quoted lines, blank lines at its ends removed."""
    kept = F.array_join(F.filter(_lines(text), lambda x: quote_level(x) == 0), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"\A(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+\z", "")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, content, reply_to, position, depth, n_passages,
    n_linked, max_level)``, one row per message.

    ``content`` is the message without quotes, ``reply_to`` the turn it
    replies to (null for a conversation's first message), ``position`` its
    place in reply order from 0 (a message, then the replies that go on from
    it, then those that branch off; of several branches the later message's
    first), ``depth`` the number of branches above it, ``n_passages`` and
    ``n_linked`` its quoted passages and those with a source, ``max_level``
    the deepest nesting.

    Null texts are empty; a message of quotes alone has empty content.
    Messages with the same turn are ordered by role and text, a null turn
    comes first; rows equal in all of them may swap places.  A null
    ``conv_id`` is a conversation like others.  Quotes without a source
    (none, or only in later messages) link to nothing.  Other columns are not
    read.
    """
    rows = messages.select(messages[conv_col].alias("conv_id"), messages[turn_col].cast("long").alias("turn"),
                           messages[role_col].alias("role"), messages[text_col].alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = cut(add_rank(rows, "r", ["conv_id"], order, F.expr(f"coalesce(turn div {BLOCK}, -9223372036854775808)")))
    passages = _sources(ranked)
    by_message = passages.groupBy("conv_id", "r").agg(
        F.count("*").alias("n_passages"), F.count("source").alias("n_linked"), F.max("level").alias("max_level"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", "passage", "source"))).alias("first"))
    quotes = by_message.select(F.col("conv_id").alias("q_conv"), F.col("r").alias("q_r"), "n_passages", "n_linked",
                               "max_level", F.col("first.source").alias("source"))
    # texts stay behind: the tree is found on ranks alone
    ranks = ranked.select("conv_id", "turn", "r")
    linked = ranks.join(quotes, F.col("conv_id").eqNullSafe(F.col("q_conv")) & (F.col("r") == F.col("q_r")), "left")
    linked = (linked.withColumn("parent", F.coalesce("source", F.when(F.col("r") > 0, F.col("r") - 1)))
              .withColumn("starts", F.when((F.col("r") == 0) | (F.col("parent") != F.col("r") - 1), F.col("r")))
              .drop("q_conv", "q_r", "source"))
    chained = cut(_chains(linked))
    placed = _branch_places(chained)
    with_place = chained.join(placed, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("chain") == F.col("b_chain")))
    turns = ranks.select(F.col("conv_id").alias("t_conv"), F.col("r").alias("t_r"), F.col("turn").alias("reply_to"))
    placed = with_place.join(turns, F.col("conv_id").eqNullSafe(F.col("t_conv")) & (F.col("parent") == F.col("t_r")), "left").select(
        F.col("conv_id").alias("p_conv"), F.col("r").alias("p_r"), "reply_to",
        (F.col("first_place") + F.col("r") - F.col("chain")).alias("position"), "depth",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_passages", "n_linked", "max_level")])
    out = ranked.join(placed, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("r") == F.col("p_r")))
    return out.select("conv_id", "turn", "role", own_text(F.col("text")).alias("content"), "reply_to", "position",
                      "depth", "n_passages", "n_linked", "max_level")


def _sources(ranked: DataFrame) -> DataFrame:
    """``(conv_id, r, passage, level, source)``: quoted passages, numbered by
    their first line, and the message each of them comes from (null: none)."""
    def lines(rows: DataFrame) -> DataFrame:
        each = rows.select("conv_id", "r", F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
        return each.select("conv_id", "r", "line_no", quote_level(F.col("line")).alias("level"),
                           normalised(F.col("line")).alias("norm"))

    in_message = Window.partitionBy("conv_id", "r").orderBy("line_no")
    quoted = (lines(ranked.where(F.col("text").contains(">"))).where("level > 0")
              .withColumn("new", (F.lag("line_no").over(in_message).isNull()
                                  | (F.lag("line_no").over(in_message) != F.col("line_no") - 1)
                                  | (F.lag("level").over(in_message) != F.col("level"))).cast("int"))
              .withColumn("passage", F.sum("new").over(in_message.rowsBetween(Window.unboundedPreceding, 0))))
    quoted = cut(quoted.drop("new"))
    with_quotes = quoted.select(F.col("conv_id").alias("q_conv")).distinct()
    own = lines(ranked.join(with_quotes, F.col("conv_id").eqNullSafe(F.col("q_conv")), "left_semi")).where(
        "level = 0 AND norm != ''")
    h1, h2 = F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("line"), "norm").alias("h2")
    wanted = cut(quoted.where("norm != ''").groupBy("conv_id", "r", "passage", h1, h2).agg(F.count("*").alias("w")))
    asked = wanted.select(*_as("k", "conv_id", "h1", "h2")).distinct()
    own = own.select("conv_id", "r", h1, h2).distinct().join(asked, _same("k", "conv_id", "h1", "h2"), "left_semi")
    own = cut(own)
    common = cut(own.groupBy(*_as("c", "conv_id", "h1", "h2")).agg(F.count("*").alias("n_with")).where(
        f"n_with > {COMMON}").drop("n_with"))
    in_common = _same("c", "conv_id", "h1", "h2")
    best = _of_rare(wanted.join(common, in_common, "left_anti"), own.join(common, in_common, "left_anti"),
                    wanted.join(common, in_common, "left_semi"), own.join(common, in_common, "left_semi"))
    best = best.unionByName(_of_common(wanted.join(common, in_common, "left_semi"),
                                       own.join(common, in_common, "left_semi")))
    best = best.groupBy(*_as("v", "conv_id", "r", "passage")).agg(F.max("best").alias("best"))
    found = quoted.groupBy("conv_id", "r", "passage").agg(F.min("level").alias("level"))
    return found.join(best, _same("v", "conv_id", "r", "passage"), "left").select(
        "conv_id", "r", "passage", "level", F.col("best.source").alias("source"))


def _as(prefix: str, *names: str) -> list[Column]:
    return [F.col(n).alias(f"{prefix}_{n}") for n in names]


def _same(prefix: str, *names: str) -> Column:
    """Equal keys; only ``conv_id`` may be null."""
    return reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"{prefix}_{n}")) if n == "conv_id"
                                   else F.col(n) == F.col(f"{prefix}_{n}") for n in names])


def _of_rare(wanted: DataFrame, own: DataFrame, wanted_common: DataFrame, own_common: DataFrame) -> DataFrame:
    """``(conv_id, r, passage, best)``: votes of every earlier message that has
    a rare line of the passage; its common lines are looked up."""
    met = wanted.join(own.select(*_as("o", "conv_id", "h1", "h2"), F.col("r").alias("source")),
                      _same("o", "conv_id", "h1", "h2") & (F.col("source") < F.col("r")))
    votes = cut(met.groupBy("conv_id", "r", "passage", "source").agg(F.sum("w").alias("w")))
    also = votes.drop("w").join(wanted_common.select(*_as("a", "conv_id", "r", "passage"), "h1", "h2", "w"),
                                _same("a", "conv_id", "r", "passage"))
    also = also.join(own_common.select(*_as("o", "conv_id", "h1", "h2"), F.col("r").alias("o_r")),
                     _same("o", "conv_id", "h1", "h2") & (F.col("source") == F.col("o_r")), "left_semi")
    votes = votes.unionByName(also.select(*votes.columns)).groupBy(*votes.columns[:-1]).agg(F.sum("w").alias("n"))
    return votes.groupBy("conv_id", "r", "passage").agg(F.max(F.struct("n", "source")).alias("best"))


def _of_common(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """``(conv_id, r, passage, best)`` by the common lines alone.

    Passages with the same common lines are one set; each message's votes for
    a set are counted once, and a passage takes the most before it.  Blocks of
    :data:`BLOCK` ranks are scanned apart.
    """
    passages = cut(wanted.groupBy("conv_id", "r", "passage").agg(
        F.array_sort(F.collect_list(F.struct("h1", "h2", "w"))).alias("lines"))
        .withColumn("s1", F.xxhash64("lines")).withColumn("s2", F.xxhash64(F.lit("set"), "lines")))
    sets = passages.groupBy("conv_id", "s1", "s2").agg(F.first("lines").alias("lines")).select(
        "conv_id", "s1", "s2", F.inline("lines"))
    votes = (sets.join(own.select(*_as("o", "conv_id", "h1", "h2"), "r"), _same("o", "conv_id", "h1", "h2"))
             .groupBy("conv_id", "s1", "s2", "r").agg(F.sum("w").alias("n")))
    rows = cut(votes.select("conv_id", "s1", "s2", "r", F.lit(None).cast("long").alias("passage"),
                            F.struct("n", F.col("r").alias("source")).alias("vote"))
               .unionByName(passages.select("conv_id", "s1", "s2", "r", "passage"), allowMissingColumns=True)
               .withColumn("blk", F.expr(f"r div {BLOCK}")))
    key = ["conv_id", "s1", "s2", "blk"]
    tops = rows.groupBy(*key).agg(F.max("vote").alias("top"))
    earlier = Window.partitionBy(*key[:-1]).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*_as("t", *key), F.max("top").over(earlier).alias("carried"))
    inside = Window.partitionBy(*key).orderBy("r").rangeBetween(Window.unboundedPreceding, -1)
    scanned = rows.withColumn("seen", F.max("vote").over(inside)).where("passage IS NOT NULL")
    return scanned.join(tops, _same("t", *key)).select(
        "conv_id", "r", "passage", F.greatest("seen", "carried").alias("best")).where("best IS NOT NULL")


def _chains(linked: DataFrame) -> DataFrame:
    """Add ``chain``: rank of the message that a run of direct replies starts
    with; blocks of :data:`BLOCK` ranks are scanned apart."""
    rows = linked.withColumn("blk", F.expr(f"r div {BLOCK}"))
    tops = rows.groupBy("conv_id", "blk").agg(F.max("starts").alias("top"))
    earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("conv_id").alias("k_conv"), F.col("blk").alias("k_blk"), F.max("top").over(earlier).alias("carried"))
    inside = Window.partitionBy("conv_id", "blk").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("chain", F.max("starts").over(inside))
    return (scanned.join(tops, F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("blk") == F.col("k_blk")))
            .withColumn("chain", F.coalesce("chain", "carried")).drop("starts", "blk", "k_conv", "k_blk", "carried"))


def _branch_places(chained: DataFrame) -> DataFrame:
    """``(b_conv, b_chain, first_place, depth)`` of every chain in pre-order.

    A chain's path lists, from the root, where it and the chains above it
    branch off; paths are put together by doubling.
    """
    chains = chained.groupBy("conv_id", "chain").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("r") == F.col("chain"), F.col("parent"))).alias("parent"))
    above = chained.select(F.col("conv_id").alias("a_conv"), F.col("r").alias("a_r"), F.col("chain").alias("up"))
    tree = chains.join(above, F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("parent") == F.col("a_r")), "left").select(
        "conv_id", "chain", "n", "up",
        F.when(F.col("parent").isNotNull(), F.array(F.struct((-F.col("parent")).alias("off"), F.col("chain").alias("at"))))
        .otherwise(F.array().cast("array<struct<off:bigint,at:bigint>>")).alias("path"))
    tree = cut(tree)
    for _ in range(MAX_DOUBLINGS):
        if tree.where("up IS NOT NULL").isEmpty():
            break
        over = tree.select(F.col("conv_id").alias("o_conv"), F.col("chain").alias("o_chain"), F.col("up").alias("o_up"),
                           F.col("path").alias("o_path"))
        met = tree.join(over, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("up") == F.col("o_chain")), "left")
        tree = cut(met.select("conv_id", "chain", "n", F.col("o_up").alias("up"),
                              F.concat(F.coalesce("o_path", F.array().cast("array<struct<off:bigint,at:bigint>>")), "path")
                              .alias("path")))
    before = Window.partitionBy("conv_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return tree.select(F.col("conv_id").alias("b_conv"), F.col("chain").alias("b_chain"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_place"),
                       F.size("path").cast("long").alias("depth"))
