"""Operator 1: document fingerprints by MinHash.

A document's shingles are its runs of ``k`` words (A-Z lower-cased; a shorter
text is one shingle).  The fingerprint holds, for each of ``permutations``
universal hash functions ``a * x + b mod 2^64`` with odd ``a``, the upper half
of the smallest value over the shingles, computed for all functions at once
in numpy.  The share of equal entries of two fingerprints estimates the
Jaccard similarity of their shingle sets.  Near duplicates are found by
joining bands of the fingerprint in Spark and verifying the Jaccard
similarity of the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import bloom, grouped
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.jaccard_join import class_components, shingle_sizes
from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import U64, hash_words, map_arrow, mix64, parts_of, shingles, utf8, words_of

SHINGLE = 5
PERMUTATIONS = 64
BAND = 4
_EMPTY = np.uint32(0xFFFFFFFF)
#: Ranges of ids that texts are dealt to at most.
MAX_RANGES = 1 << 16
#: What is sent to a range: its documents, heads of others, and near ids.
_SPREAD = {"part": pa.int32(), "extra": pa.bool_(), "place": pa.int64(), "doc": pa.int64(), "packed": pa.binary(),
           "mark": pa.binary(), "near": pa.int64()}
#: Shingles that are permuted together (bounds the work space of long texts).
_STEP = 1024


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` universal hash functions."""
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:n] | U64(1), seeds[n:]


def signature(text: bytes | None, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of one text; all ones for a text without words."""
    x = shingles(hash_words(words_of(text)), k)
    if not len(x):
        return np.full(len(a), _EMPTY)
    least = np.full(len(a), U64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), _STEP):
        values = np.multiply.outer(a, x[i:i + _STEP])
        values += b[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> U64(32)).astype(np.uint32)


def likeness(x: bytes, y: bytes) -> float:
    """Share of equal entries of two fingerprints."""
    return float(np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)))


def fingerprints(docs: DataFrame, k: int = SHINGLE, n: int = PERMUTATIONS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc, fingerprint)``, one row per row of ``docs``: ``4 * n`` bytes.

    Equal texts have equal fingerprints; null counts as the empty text.
    Columns of ``docs`` other than the two named ones are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n)
        for whole in batches:
            for batch in parts_of(whole, "text"):
                out = [signature(t, k, a, b).tobytes() for t in utf8(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary())],
                                                 ["doc", "fingerprint"])
    return map_arrow(_texts(docs, id_col, text_col), run, "doc long, fingerprint binary")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 80, n: int = PERMUTATIONS,
                    band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, n_shingles, component)``: near-duplicate classes.

    Documents that agree in one of the ``n / band`` bands of their
    fingerprints are compared on their whole shingle sets; those with a
    Jaccard similarity of ``percent`` / 100 or more link, and ``component`` is
    the smallest id reachable (see ``grouped`` for how large groups are kept
    from listing pairs).  Of documents with equal sets, one is compared.  With 16 bands of 4, a pair at 0.8 meets with
    probability 0.9998, one at 0.9 or more practically always.

    Null and empty texts link with nothing; rows without id get the component
    of an equal text that has one, else null.  Repeated rows get equal results.
    """
    sizes = cut(shingle_sizes(docs, k, id_col, text_col))
    named = sizes.where("n_shingles > 0 AND doc IS NOT NULL")

    # copies get no signature (all but a few by a Bloom filter) and no place in a group
    firsts = cut(grouped.one_of_each(named))
    listed = docs.sparkSession.sparkContext.broadcast(bloom.build(firsts, "doc", firsts.count()).words)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n)
        first = bloom.BlockedBloom(listed.value)
        for whole in batches:
            for part in parts_of(whole, "text"):
                batch = part.filter(pa.array(first.hits(part.column("doc").to_numpy().view(U64))))
                marks = [signature(t, k, a, b) for t in utf8(batch, "text")]
                held = [i for i, m in enumerate(marks) if (m != _EMPTY).any()]
                if not held:
                    continue
                mark = np.array([marks[i] for i in held]).reshape(len(held), n // band, band).astype(U64)
                key = np.zeros(mark.shape[:2], U64) + np.arange(n // band, dtype=U64)
                for i in range(band):
                    key = mix64(key ^ mark[:, :, i])
                doc = np.repeat(np.asarray(batch.column("doc"))[held], n // band)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(doc)], ["key", "doc"])

    texts = _texts(docs, id_col, text_col)
    keys = map_arrow(texts.where("doc IS NOT NULL"), bands, "key long, doc long")
    members = cut(grouped.pivots(keys).join(firsts, "doc", "left_semi").select("pivot", "doc"))
    links = grouped.verified_links(members, named, texts, k, percent)
    return class_components(sizes, connected_components(links))


def edited_fingerprints(docs: DataFrame, k: int = SHINGLE, n: int = PERMUTATIONS,
                        id_col: str = "doc_id", text_col: str = "text", near: DataFrame | None = None) -> DataFrame:
    """Fingerprints of all texts and of an edited form of each.

    The next document is the one after it by descending id, the first after
    the last; the edited text has the last half of the code points (rounded
    down) replaced by as many first ones of the next text, or all it has.
    Returns ``doc, n_chars, edited_sha256, fingerprint, edited_fingerprint``
    (lowercase hex), ``near_edited, near_next`` (share of equal entries) and
    ``near_id``, one row per row of ``docs``.  ``near_id`` is what
    ``near(doc, component)``, a result of :func:`near_duplicates`, says of the
    id (null without it, and for rows without id).  Null texts are empty.  Rows without id come
    last; rows with the same id are ordered by a hash of their text.  A single
    row is its own next one.

    Texts are shuffled once, by ranges of the id.  The first row of each range
    also goes to the range above it, so no range needs more than its own rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"),
                       F.coalesce(docs[id_col].cast("long"), F.lit(-2**63)).alias("place"))
    n_ranges = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cut_points(rows, n_ranges)
    heads = _heads(rows, cuts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n)
        squeeze = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in parts_of(whole, "text"):
                out: list[list] = [[] for _ in _SPREAD]
                for doc, place, text in zip(batch.column("doc").to_pylist(),
                                            batch.column("place").to_pylist(), utf8(batch, "text"),
                                            strict=True):
                    text = text or b""
                    mark = signature(text, k, a, b).tobytes()
                    packed = squeeze.compress(text)
                    here = int(np.searchsorted(cuts, place, "right"))
                    for where, extra in [(here, False), *((w, True) for w in heads.get(place, ()))]:
                        for column, value in zip(out, (where, extra, place, doc, packed, mark, None), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, _SPREAD.values(), strict=True)], list(_SPREAD))

    def place_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            part = np.searchsorted(cuts, place, "right")
            blank = [pa.nulls(batch.num_rows, t) for t in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.zeros(len(part), bool)), batch.column("place"), *blank,
                 batch.column("near")], list(_SPREAD))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n)
        unpack = zstandard.ZstdDecompressor()
        before, component = None, (None, None)
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for part, extra, place, doc, packed, mark, near_id in zip(*cols, strict=True):
                if packed is None:  # what is near the documents of this place
                    component = (place, near_id)
                    continue
                row = (part, extra, doc, unpack.decompress(packed).decode(), mark,
                       component[1] if component[0] == place else None)
                if before is not None and before[0] == part and not before[1]:
                    out.append(_edited(before, row, k, a, b))
                before = row
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                     pa.float64(), pa.int64()))],
                ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                 "near_next", "near_id"])

    schema = "part int, extra boolean, place long, doc long, packed binary, mark binary, near long"
    marked = map_arrow(rows, spread, schema)
    if near is not None:
        of_id = near.where("doc IS NOT NULL").groupBy(F.col("doc").alias("place")).agg(F.min("component").alias("near"))
        marked = marked.unionByName(map_arrow(of_id.select("place", "near"), place_near, schema))
    dealt = marked.repartition("part").sortWithinPartitions(
        "part", "extra", F.desc("place"), F.asc_nulls_last("near"), F.xxhash64("packed"))
    return map_arrow(dealt, edit, "doc long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double, near_id long")


def _edited(row: tuple, following: tuple, k: int, a: np.ndarray, b: np.ndarray) -> tuple:
    _, _, doc, text, mark, near_id = row
    half = len(text) // 2
    edited = (text[:len(text) - half] + following[3][:half]).encode()
    edited_mark = signature(edited, k, a, b).tobytes()
    return (doc, len(text), hashlib.sha256(edited).hexdigest(), mark.hex(), edited_mark.hex(),
            likeness(mark, edited_mark), likeness(mark, following[4]), near_id)


def _cut_points(rows: DataFrame, parts: int) -> np.ndarray:
    """Ids that divide the rows into about equal ranges (few per task)."""
    found = rows.select(F.percentile_approx(
        "place", [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("cuts")).first()["cuts"]
    return np.unique(np.array(found or [], np.int64))


def _heads(rows: DataFrame, cuts: np.ndarray) -> dict[int, list[int]]:
    """Largest id of each range -> the ranges whose last row it follows."""
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            place = np.asarray(batch.column("place"))
            part = np.searchsorted(cuts, place, "right")
            for p in np.unique(part).tolist():
                most[p] = max(most.get(p, -2**63), int(place[part == p].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()),
                                          pa.array(list(most.values()), pa.int64())], ["part", "top"])
    found = sorted(tuple(r) for r in map_arrow(rows.select("place"), tops, "part int, top long")
                   .groupBy("part").agg(F.max("top")).collect())
    out: dict[int, list[int]] = {}
    for i, (part, _) in enumerate(found):
        out.setdefault(found[i - 1][1], []).append(part)  # of the lowest: the highest
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
