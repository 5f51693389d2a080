"""Operator 9: benchmark decontamination, in DataFrame functions only.

Test items are normalised to words and cut into windows of ``size`` words (a
shorter item is one window).  A 64-bit hash of every window goes into a
broadcast hash set; documents are scanned window by window against it, hits
are verified on the words themselves, and the words they cover are counted
and can be cut out.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.storage import cut

SIZE = 13
#: Windows that are broadcast at most (about 300 bytes each); more are joined
#: by a shuffle of the documents' windows.
MAX_BROADCAST = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased.
_RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = string.ascii_uppercase


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` is that for ASCII texts)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_list(text: Column) -> Column:
    """Words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), _BREAK), "")


def window_hash(hashes: str, at: str, size: int) -> Column:
    """Hash of the ``size`` word hashes from position ``at`` on."""
    return F.expr(f"xxhash64({', '.join(f'{hashes}[{at} + {i}]' for i in range(size))})")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(len, gram, items)``: distinct windows and the items with them.
    Items without words have none."""
    words = (items.select(items[id_col].cast("string").alias("item"), word_list(items[text_col]).alias("words"))
             .where("size(words) > 0").withColumn("len", F.least(F.size("words"), F.lit(size))))
    grams = words.select("item", "len", F.explode(F.expr(
        "transform(sequence(0, size(words) - len), i -> slice(words, i + 1, len))")).alias("gram")).distinct()
    return grams.groupBy("len", "gram").agg(
        F.array_sort(F.collect_set(F.coalesce("item", F.lit("null")))).alias("items"))


def scan(docs: DataFrame, items: DataFrame, keys: list[str], size: int = SIZE, text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(keys..., start, len, items, n_words)`` from one scan of the texts: a
    row for every occurrence of an item window, by word position (from 0), and
    one with ``start`` -1 for every row of ``docs``."""
    found = cut(item_windows(items, size, item_id, item_text))
    lengths = {r["len"]: r["n"] for r in found.groupBy("len").agg(F.count("*").alias("n")).collect()}  # size rows
    rows = docs.select(*[docs[k].alias(k) for k in keys], word_list(docs[text_col]).alias("words"))
    hashed = rows.withColumn("h", _hashes("words"))
    sizes = sorted(lengths) or [size]
    at = hashed.select(*keys, "words", "h", F.explode(F.sequence(
        F.lit(-1), F.greatest(F.size("h") - sizes[0], F.lit(-1)))).alias("start"))

    def window(n: int) -> Column:
        return F.when((F.col("start") >= 0) & (F.col("start") + n <= F.size("h")), window_hash("h", "start", n))

    if len(sizes) == 1:
        at = at.withColumn("w_len", F.lit(sizes[0])).withColumn("w_key", window(sizes[0]))
    else:  # one row for each length; the row of the text itself only once
        each = F.array(*[F.struct(F.lit(n).alias("w_len"), window(n).alias("w_key")) for n in sizes])
        at = at.select(*keys, "words", "start", F.inline(
            F.when(F.col("start") < 0, F.slice(each, 1, 1)).otherwise(each)))
    listed = None
    for n in lengths:
        part = found.where(F.col("len") == n).select(_hashes("gram").alias("h"), "gram", "items").select(
            F.lit(n).alias("len"), window_hash("h", "0", n).alias("key"), "gram", "items")
        listed = part if listed is None else listed.unionByName(part)
    if listed is None:
        listed = found.select("len", F.lit(None).cast("long").alias("key"), "gram", "items")
    if sum(lengths.values()) > max_broadcast:
        return _scan_shuffled(docs, at, listed, keys, text_col)
    met = at.join(F.broadcast(listed), F.col("w_key") == F.col("key"), "left").where((F.col("start") < 0) | (
        (F.col("w_len") == F.col("len")) & (F.slice("words", F.col("start") + 1, F.col("w_len")) == F.col("gram"))))
    return met.select(*keys, "start", "len", "items", F.size("words").cast("long").alias("n_words"))


def _scan_shuffled(docs: DataFrame, at: DataFrame, listed: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """:func:`scan` by a shuffle of the windows: they travel as hashes without
    their text, and a text meets the few that hit to verify them."""
    met = at.where("start >= 0").select(*keys, "start", "w_len", "w_key").join(
        listed, (F.col("w_key") == F.col("key")) & (F.col("w_len") == F.col("len")))
    hits = met.groupBy(*[F.col(k).alias(f"hit_{k}") for k in keys]).agg(
        F.collect_set(F.struct("start", "len", "gram", "items")).alias("hits"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"hit_{k}")) for k in keys])
    texts = docs.select(*[docs[k].alias(k) for k in keys], docs[text_col].alias("scanned"))
    rows = texts.join(hits, same, "left").select(*keys, "hits", word_list(F.col("scanned")).alias("words"))
    found = F.expr("""transform(filter(hits, x -> x.start + x.len <= size(words) AND slice(words, x.start + 1, x.len) = x.gram),
                      x -> struct(x.start, x.len, x.items))""")
    text_itself = F.expr("array(struct(-1 AS start, CAST(NULL AS int) AS len, CAST(NULL AS array<string>) AS items))")
    return rows.select(*keys, F.size("words").cast("long").alias("n_words"), F.inline(
        F.when(F.col("hits").isNull(), text_itself).otherwise(F.concat(text_itself, found)))).select(
        *keys, "start", "len", "items", "n_words")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(doc, text_hash, n_words, n_hit, items)``, one row per row of ``docs``:
    words, words inside any occurrence of an item window, ids of the items
    with occurring windows as sorted strings.

    Null and empty texts, and texts without words, have 0 words and no hits;
    items without words have no windows; a null item id reads ``null``.  Rows
    are told apart by id and text, so repeated rows and null ids each get
    their own text's result.  Other columns of both tables are not read.
    """
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("text_hash"),
                       docs[text_col].alias("text"))
    met = scan(rows, items, ["doc", "text_hash"], size, "text", item_id, item_text, max_broadcast)
    judged = met.groupBy("doc", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.size(_positions()).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("start") < 0).alias("copies"))
    return judged.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop(
        "copy", "copies")


def _positions() -> Column:
    """Positions of the words inside the occurrences of a text."""
    return F.array_distinct(F.flatten(F.collect_set(F.when(
        F.col("start") >= 0, F.expr("sequence(start, start + len - 1)")))))


def without_spans(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``(doc, text)``, one row per row of ``docs``: the texts without their
    hit words and without what stands between two of them.  Texts without
    hits stay as they are, null ones too."""
    rows = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    hit = (scan(rows, items, ["doc", "text_hash"], size, "text", item_id, item_text, max_broadcast).where("start >= 0")
           .groupBy(F.col("doc").alias("h_doc"), F.col("text_hash").alias("h_hash")).agg(_positions().alias("gone")))
    same = F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("text_hash") == F.col("h_hash"))
    # breaks and words take turns; word i is piece 2 i, or 2 i + 1 after a leading break
    pieces = F.regexp_extract_all("text", F.lit(f"{_RAW_BREAK}+|{_RAW_WORD}"), F.lit(0))
    joined = (rows.join(hit, same, "left").withColumn("pieces", F.when(F.col("gone").isNotNull(), pieces))
              .withColumn("lead", F.when(F.col("text").rlike(f"^{_RAW_BREAK}"), 1).otherwise(0)))
    kept = F.expr("""filter(pieces, (p, i) -> NOT CASE WHEN i % 2 = lead THEN array_contains(gone, i div 2)
                     ELSE array_contains(gone, (i - 1 - lead) div 2) AND i > lead
                          AND array_contains(gone, (i + 1 - lead) div 2) END)""")
    return joined.select("doc", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("text"))


def is_contaminated(n_hit: Column, n_words_: Column, parts: int = 20) -> Column:
    """At least one word in ``parts`` of the document is hit."""
    return (n_hit > 0) & (n_hit * parts >= n_words_)
