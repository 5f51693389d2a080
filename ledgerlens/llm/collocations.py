"""Operator 11: phrases whose words belong together, by sorted count streams.

**Counts.**  Tasks number the words of a buffer, pack every run of a length into
one 64-bit number and sort them, so a task sends a phrase once per buffer.
Spark adds the counts up; only phrases with ``least`` occurrences go on, since
no part of a candidate has fewer.  For the same reason words are counted first,
then pairs, and so on: a phrase is left out if its first or last words are a
rarer phrase.  A Bloom filter of the others (32 MB at most) tells, and one that
it lets through only costs a row.

**Streams.**  A phrase is the key ``word TAB word TAB ...``; no word holds a
tab, so in byte order all phrases that begin with a phrase follow it at once.
In this *prefix order* one pass with a stack of open phrases meets a
candidate's left parts (the phrases it begins with) and its right extensions
(those that begin with it).  The same pass over reversed keys, in *suffix
order*, meets right parts and left extensions.  The streams of all orders
(words, pairs, triples) run through each pass together, merged by the sort:
no lookup and no hash table of phrases.

**Ranges.**  A stream is one range shuffle and is kept as checkpoint files.
A hot word's phrases may cross ranges: of each range the open phrases at its
end and the largest counts of its first run are collected (a few phrases per
range), and give each range the phrases open at its start and, for those still
open at its end, the largest extension in later ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bloom import BlockedBloom, build
from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import U64, map_arrow, mix64, utf8

#: Bytes of text that a task counts before it sends its counts.
BUFFER = 32 << 20
#: Words that are packed and sorted at once.
WORDS = 1 << 20
#: Places whose phrases are looked up at once.
_PROBES = 1 << 16
#: Groups of a language's phrases whose best are found before the language's.
DEALT = (64, 4)
_CUTS, _COMMA = b".,;:!?\n\x0b\x0c\r", b","
_SPACE = re.compile(rb"[ \t]")
_TABLE = bytes(ord(",") if b in _CUTS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STREAM = "lang string, key binary, f long, heads array<long>, ext long, n long"


def words_and_cuts(text: bytes, at_once: int = 4 << 20) -> Iterator[list[bytes]]:
    """Words of a text with A-Z lower-cased, and a comma wherever a piece ends,
    as lists of the words of about ``at_once`` bytes."""
    start = 0
    while start < len(text):
        end = _SPACE.search(text, start + at_once)
        stop = end.start() if end else len(text)
        yield text[start:stop].translate(_TABLE).replace(_COMMA, b" , ").split()
        start = stop


def word_hashes(lang: str, words: Iterable[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], U64)


def count_phrases(texts: Iterable[bytes], length: int, lang: str = "", known: BlockedBloom | None = None) -> Iterator[pa.Table]:
    """``(key, f)`` tables of the phrases of ``length`` words of some texts,
    each phrase once per :data:`WORDS` words; beside single words, the empty key
    counts them all.  Of longer phrases, those whose first and last ``length -
    1`` words ``known`` may hold."""
    limit = min(WORDS, (1 << (63 // length)) - length)  # any ``length`` word numbers fit into 63 bits
    pending: list[bytes] = []
    for text in texts:
        for tokens in chain(words_and_cuts(text), [[_COMMA]]):
            pending += tokens
            while len(pending) >= limit + length:  # the last words complete the runs that begin before them
                yield _counted(pending[:limit + length - 1], limit, length, lang, known)
                del pending[:limit]
    yield _counted(pending, len(pending), length, lang, known)


def _counted(tokens: list[bytes], starts: int, length: int, lang: str, known: BlockedBloom | None) -> pa.Table:
    """Counts of the runs that begin at the first ``starts`` tokens."""
    numbers: dict[bytes, int] = {_COMMA: 0}
    ids = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    words = pa.array(numbers, pa.binary())
    bits = max(len(numbers) - 1, 1).bit_length()
    places = max(min(starts, len(ids) - length + 1), 0)
    packed = np.zeros(places, np.int64)
    alive = np.ones(places, bool)
    for m in range(length):
        step = ids[m:m + places]
        alive &= step > 0
        packed = (packed << bits) | step
    if known is not None and places:
        at = np.flatnonzero(alive)
        hashes = word_hashes(lang, numbers)[ids]
        for i in range(0, len(at), _PROBES):
            here = at[i:i + _PROBES]
            for shift in (0, 1):  # the first and the last words of the phrase
                part = [hashes[here + shift + j] for j in range(length - 1)]
                alive[here] &= known.hits(phrase_hashes(part))
    found, f = np.unique(packed[alive], return_counts=True)
    parts = [words.take(pa.array((found >> (bits * (length - 1 - j))) & ((1 << bits) - 1))) for j in range(length)]
    keys = [pc.binary_join_element_wise(*parts, b"", b"\t") if len(found) else pa.array([], pa.binary())]
    counts = [f.astype(np.int64)]
    if length == 1:
        keys.append(pa.array([b""], pa.binary()))
        counts.append(np.array([np.count_nonzero(alive)], np.int64))
    return pa.table({"key": pa.concat_arrays(keys), "f": pa.array(np.concatenate(counts))})


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from the hashes of their first, second, ... words."""
    out = np.full(len(words[0]), len(words), U64)
    for w in words:
        out = mix64(out * U64(0x9E3779B97F4A7C15) ^ w)
    return out


def _added_up(rows: DataFrame, length: int, known: Broadcast | None = None) -> DataFrame:
    """``(lang, key, f)`` of the phrases of a length in ``(lang, text)`` rows.

    Phrases are counted per buffer before the shuffle; a further aggregation on
    the map side would find few of them twice.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(known.value) if known is not None else None
        held: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for table in count_phrases(texts, length, lang, bloom):
                    for part in table.to_batches(max_chunksize=50_000):
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), *part.columns], ["lang", "key", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                held.setdefault(lang, []).append(text or b"")
                size += len(text or b"")
                if size >= BUFFER:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    counted = map_arrow(rows, count, "lang string, key binary, f long")
    return counted.repartition("lang", "key").groupBy("lang", "key").agg(F.sum("f").alias("f"))


def _filter_of(phrases: DataFrame) -> Broadcast:
    """A Bloom filter of ``(lang, key)`` phrases of one length."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(lang, key.split(b"\t")[:-1]) for lang, key in zip(
                batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            hashes = phrase_hashes(list(np.array(words, U64).T)) if words else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    named = phrases.where(F.octet_length("key") > 0).select("lang", "key")
    words = build(map_arrow(named, hashed, "hash long"), "hash", named.count()).words
    return phrases.sparkSession.sparkContext.broadcast(words)


def frequent_phrases(docs: DataFrame, longest: int, least: int, text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """``(lang, key, f)`` of every phrase of up to ``longest`` words with
    ``least`` occurrences in a language's texts; the empty key has the number
    of all words."""
    rows = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    found = cut(_added_up(rows, 1).where((F.col("f") >= least) | (F.octet_length("key") == 0)))
    out = found
    for length in range(2, longest + 1):
        found = cut(_added_up(rows, length, _filter_of(found)).where(F.col("f") >= least))
        out = out.unionByName(found)
    return out


def _sorted_stream(rows: DataFrame) -> DataFrame:
    """Rows in byte order of language and key, kept; a partition is a range."""
    return cut(rows.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key"))


def _above(key: bytes) -> list[bytes]:
    """The phrases that a phrase begins with, shortest first, itself included."""
    return [key[:0], *(key[:m.end()] for m in re.finditer(b"\t", key))]


def _ends(stream: DataFrame) -> list[tuple]:
    """Of each range with rows: its number, first and last (language, key), the
    open phrases at its end with their counts, and for each phrase above its
    first key the largest count of the range's phrases one word longer."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        own: list[tuple[bytes, int]] = []
        lead: dict[bytes, int] = {}
        for batch in batches:
            for now in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), batch.column("f").to_pylist(),
                           strict=True):
                lang, key, f = now
                if first is None:
                    first = (lang, key)
                    lead = dict.fromkeys(_above(key)[:-1], 0)
                if last is not None and last[0] != lang:
                    own = []
                own = [e for e in own if key.startswith(e[0])] + [(key, f)]
                last = (lang, key)
                if lang == first[0] and lead and key:
                    parent = _above(key)[-2]
                    if parent in lead:
                        lead[parent] = max(lead[parent], f)
        if first is not None:
            yield pa.RecordBatch.from_pylist([{
                "part": TaskContext.get().partitionId(), "first": first, "last": last,
                "own": own, "lead": list(lead.items())}], pa.schema(schema))

    edge = pa.struct([("lang", pa.string()), ("key", pa.binary())])
    entry = pa.list_(pa.struct([("key", pa.binary()), ("f", pa.int64())]))
    schema = [("part", pa.int32()), ("first", edge), ("last", edge), ("own", entry), ("lead", entry)]
    text = ("part int, first struct<lang:string,key:binary>, last struct<lang:string,key:binary>, "
            "own array<struct<key:binary,f:long>>, lead array<struct<key:binary,f:long>>")
    found = map_arrow(stream.select("lang", "key", "f"), ends, text).collect()
    return sorted((r["part"], (r["first"][0], bytes(r["first"][1])), (r["last"][0], bytes(r["last"][1])),
                   [(bytes(k), f) for k, f in r["own"]], {bytes(k): f for k, f in r["lead"]}) for r in found)


def _carried(ends: list[tuple]) -> dict[int, tuple[list[tuple[str, bytes, int]], dict[bytes, int]]]:
    """For each range: the phrases open at its start, and for the phrases open
    at its end the largest count of an extension in later ranges."""
    out, stack = {}, []
    for i, (part, first, last, own, _) in enumerate(ends):
        opened = [e for e in stack if e[0] == first[0] and first[1].startswith(e[1])]
        later: dict[bytes, int] = {}
        for key, _ in own:
            for _, nxt, _, _, lead in ends[i + 1:]:
                if nxt[0] != last[0] or not nxt[1].startswith(key):
                    break
                later[key] = max(later.get(key, 0), lead.get(key, 0))
        out[part] = (opened, later)
        stack = [e for e in opened if e[0] == last[0] and last[1].startswith(e[1])] + [(last[0], k, f) for k, f in own]
    return out


def _walk(rows: Iterable[tuple], opened: list[tuple[str, bytes, int]], later: dict[bytes, int]) -> Iterator[tuple]:
    """Each row ``(lang, key, f, ...)`` with its ``heads`` (counts of the
    phrases it begins with, shortest first, the empty one included) and ``ext``
    (largest count of the phrases one word longer that begin with it)."""
    stack: list[list] = [[lang, key, f, None, 0] for lang, key, f in opened]

    def close(entry: list, ext: int) -> tuple:
        return entry[3], [e[2] for e in stack], ext

    for row in rows:
        lang, key, f = row[:3]
        while stack and not (stack[-1][0] == lang and key.startswith(stack[-1][1])):
            entry = stack.pop()
            if entry[3] is not None:
                yield close(entry, entry[4])
        if stack:
            stack[-1][4] = max(stack[-1][4], f)
        stack.append([lang, key, f, row, 0])
    while stack:
        entry = stack.pop()
        if entry[3] is not None:
            yield close(entry, max(entry[4], later.get(entry[1], 0)))


def _reversed(key: bytes) -> bytes:
    return b"".join(w + b"\t" for w in reversed(key.split(b"\t")[:-1]))


def _prefix_pass(counts: DataFrame) -> DataFrame:
    """The stream of the second pass: keys reversed, with their left parts'
    counts (the empty phrase's, the words of the language, apart as ``n``)."""
    stream = _sorted_stream(counts.select("lang", "key", "f"))
    carried = stream.sparkSession.sparkContext.broadcast(_carried(_ends(stream)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, later = carried.value.get(TaskContext.get().partitionId(), ([], {}))
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(((row[0], _reversed(row[1]), row[2], heads[1:], ext, heads[0] if heads else row[2])
                             for row, heads, ext in _walk(rows, opened, later)), _STREAM_ARROW)

    return map_arrow(stream, walk, _STREAM)


def _suffix_pass(stream: DataFrame, least: int, percent: int) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score, kept)`` of every candidate."""
    stream = _sorted_stream(stream)
    carried = stream.sparkSession.sparkContext.broadcast(_carried(_ends(stream)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, later = carried.value.get(TaskContext.get().partitionId(), ([], {}))
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(_scored(_walk(rows, opened, later), least, percent), _SCORED_ARROW)

    return map_arrow(stream, walk, "lang string, phrase string, a long, l long, r long, n long, score long, kept boolean")


def _scored(walked: Iterable[tuple], least: int, percent: int) -> Iterator[tuple]:
    for (lang, key, a, lefts, ext_right, n), heads, ext_left in walked:
        rights = heads[1:]  # counts of the last 1, 2, ... words
        if not rights or a < least:
            continue
        cuts = ((1_000_000 * a * a // (left * right), left, right)
                for left, right in zip(lefts, reversed(rights), strict=True))
        score, left, right = min(cuts, key=lambda c: c[0])  # the first of equal ones: the smallest cut
        inside = max(ext_left, ext_right)
        kept = inside < least or 100 * inside < percent * a
        yield lang, _reversed(key)[:-1].replace(b"\t", b" ").decode(), a, left, right, n, score, kept


_STREAM_ARROW = [("lang", pa.string()), ("key", pa.binary()), ("f", pa.int64()), ("heads", pa.list_(pa.int64())),
                 ("ext", pa.int64()), ("n", pa.int64())]
_SCORED_ARROW = [("lang", pa.string()), ("phrase", pa.string()), *((c, pa.int64()) for c in ("a", "l", "r", "n", "score")),
                 ("kept", pa.bool_())]


def _batches(rows: Iterable[tuple], schema: list, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), schema, strict=True)], [n for n, _ in schema])

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def candidates(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, text_col: str = "text",
               lang_col: str = "lang") -> DataFrame:
    """``(lang, phrase, a, l, r, n, score, kept)`` of every phrase of 2 to
    ``longest`` words with ``least`` occurrences in its language.

    ``a``: occurrences, overlapping ones included; ``l``, ``r``: those of the
    two parts at the cut with the lowest ``score`` = floor(1000000 a a / (l r)),
    the smallest cut of equal ones, in whole numbers of any size; ``n``: words
    of the language.  ``kept``: no longer candidate that holds the phrase has
    ``percent`` of its occurrences (a longer one has no more than one that is
    one word longer, so these decide).

    A-Z are lower-cased; texts are cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at spaces and tabs.  A null text has no word, a null
    language is ``und``; repeated rows count as often as they stand; an empty
    table has no phrase.  Other columns are not read.
    """
    frequent = frequent_phrases(docs, longest, least, text_col, lang_col)
    return _suffix_pass(_prefix_pass(frequent), least, percent)


def best_phrases(found: DataFrame, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` kept candidates by score, occurrences (both
    descending) and phrase (byte order), with their ``rank`` from 1.

    A task sends ``top`` rows of a language at most; groups of phrases are
    reduced to their first ones before one task ranks a language's.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = found.where("kept").drop("kept")
    for groups in DEALT:
        dealt = few.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
        few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order)))
        few = few.where(F.col("rank") <= top).drop("rank", "dealt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
