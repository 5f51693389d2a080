"""Operator 13: token ids in files of word-aligned packed words.

Documents are put in ascending order of their id by one range shuffle of the
texts, encoded by the tokenizer's library, and written as segments: rows of
whole documents with at least :data:`SEGMENT` ids (the last of a part fewer; a
longer document is a segment by itself).  The ids of a segment are one
Simple-8b array (:mod:`ledgerlens.llm.simple8b`), whose block offsets let a
reader decode any range of it.

A token file set is a Parquet dataset, so Spark's own writer commits it and a
lost executor leaves no half file; its columns:

    part int         place of the range of document ids
    segment int      place of the segment in its part
    first long       ids of the part before the segment
    n_ids long       ids in the segment
    docs array<long>, lengths array<long>   its documents, in order, and their ids
    payload binary   the ids

Parts follow each other in the order of document ids, so an id's place in the
whole is the sum of all parts before, ``first`` and its place in the segment.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import simple8b
from ledgerlens.llm.token_counts import drops_white_space
from ledgerlens.llm.words import map_arrow, parts_of, utf8
from ledgerlens.llm.workers import kept

#: Ids after which a segment is full.
SEGMENT = 1 << 16
#: Pre-tokens whose ids a worker keeps in each of two generations.
CACHE = 500_000
#: Longest pre-token that is kept, in bytes.
KEPT_BYTES = 64
#: Words of Latin-1 characters but its two white-space ones, as UTF-8.
_LATIN = re.compile(rb"(?:[\x00-\x7f]|\xc2[\x80-\x84\x86-\x9f\xa1-\xbf]|\xc3[\x80-\xbf])+")
SCHEMA = ("part int, segment int, first long, n_ids long, docs array<long>, lengths array<long>, payload binary")


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The library's ids of a list of texts, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a byte's own character where that is printable,
    else the next one from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + others.index(b)) for b in others}


def latin_splitter(path: str) -> regex.Pattern | None:
    """The tokenizer's own pattern of a pre-token, if words of Latin-1 come to
    its model as the pattern's matches in lower case: normalisers that change
    no other thing in them, and bytes mapped to the byte-level alphabet without
    another split."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("normalizer") or {}
    steps = before.get("normalizers", [before])
    first, *after = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s["pattern"] == {"Regex": "\\s+"})
                for s in steps) and any(s.get("type") == "Lowercase" for s in steps)
    mapped = [(s.get("type"), s.get("use_regex"), s.get("add_prefix_space")) for s in after] == [("ByteLevel", False, False)]
    return regex.compile(first["pattern"]["Regex"]) if plain and mapped else None


def _lower(text: bytes) -> bytes:
    """A text in lower case if that is all the normaliser would do to it: one
    of Latin-1 characters without a special string."""
    if b"<|" in text:
        return text
    if text.isascii():
        return text.lower()
    chars = text.decode()
    try:
        chars.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return chars.lower().encode()


class PreTokens:
    """Ids of texts, word by word, for a tokenizer that drops white space: no
    step of it crosses that, so texts are cut there and every word is encoded
    once.

    A word of Latin-1 characters is split by the tokenizer's own pattern and its
    pieces go to the library's model directly, which is what the library's
    normaliser and splitter would hand it; others, and those that may hold a
    special string, go through the library as a whole.  Words are kept in two
    generations: when the new one is full, the old one is dropped, so those in
    use stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.encode = encoder(path)
        self.split = latin_splitter(path)
        tokenizer = Tokenizer.from_file(path)
        self.tokenize = tokenizer.model.tokenize
        self.as_bytes = [_as_bytes([i]) for i in range(tokenizer.get_vocab_size())]
        self.alphabet = byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        """The text's ids as little-endian 32-bit numbers."""
        words = _lower(text).split()
        missing = set(words).difference(self.new)
        if missing:
            if len(self.new) + len(missing) > CACHE:
                self.old, self.new = self.new, {}
                missing = set(words)
            self._learn(missing)
        out = b"".join(map(self.new.__getitem__, words))
        for w in missing:
            if len(w) > KEPT_BYTES:
                del self.new[w]
        return out

    def _learn(self, words: set[bytes]) -> None:
        hard = []
        for w in words:
            if (ids := self.old.get(w)) is not None:
                self.new[w] = ids
            elif self.split is None or b"<|" in w or not _LATIN.fullmatch(w):
                hard.append(w)
            elif w.isalpha():  # ASCII letters: one piece
                self.new[w] = self._piece(w.lower())
            else:
                pieces = self.split.findall(w.decode().lower())
                self.new[w] = b"".join([self._piece(p.encode()) for p in pieces])
        for i in range(0, len(hard), 4096):
            part = hard[i:i + 4096]
            self.new.update(zip(part, map(_as_bytes, self.encode([w.decode() for w in part])), strict=True))

    def _piece(self, piece: bytes) -> bytes:
        ids = self.new.get(piece) or self.old.get(piece)
        if ids is None:
            letters = piece.decode("latin-1")
            if not piece.isalpha():
                letters = letters.translate(self.alphabet)
            ids = b"".join([self.as_bytes[t.id] for t in self.tokenize(letters)])
            if len(piece) <= KEPT_BYTES:
                self.new[piece] = ids
        return ids


def encode_texts(texts: list[bytes], encode: Callable, pieces: PreTokens | None) -> Iterator[bytes]:
    """The ids of every text as little-endian 32-bit numbers, by pre-tokens or
    by whole texts."""
    if pieces is not None:
        yield from map(pieces.ids, texts)
        return
    for i in range(0, len(texts), 64):
        for ids in encode([t.decode() for t in texts[i:i + 64]]):
            yield _as_bytes(ids)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    """Write the ids of every whole text, each followed by ``end_id``, to ``folder``.

    ``path`` names a tokenizer file (``.json`` or ``.model``) that every
    executor can open.  Documents go by ascending id; rows without id come
    first, rows with one id by a hash of their text (equal rows in any order:
    they are the same).  A null or empty text has the end id alone.  Every row
    is kept, repeated ones too; other columns are not read.  A hot id is cut
    by text hash and row.  An empty table gives a set without rows.
    """
    cut_up = drops_white_space(path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(("token_files", path, "pieces"), lambda: PreTokens(path)) if cut_up else None
        encode = pieces.encode if pieces else kept(("token_files", path), lambda: encoder(path))
        end = _as_bytes([end_id])
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        lengths: list[int] = []
        total = 0
        for whole in batches:
            for batch in parts_of(whole, "text"):
                found = encode_texts([t or b"" for t in utf8(batch, "text")], encode, pieces)
                for name, raw in zip(batch.column("doc").to_pylist(), found, strict=True):
                    ids += (raw, end)
                    names.append(name)
                    lengths.append(len(raw) // 4 + 1)
                    total += lengths[-1]
                    if total >= SEGMENT:
                        yield _segment(part, segment, first, names, lengths, ids)
                        segment, first, total = segment + 1, first + total, 0
                        ids, names, lengths = [], [], []
        if names:
            yield _segment(part, segment, first, names, lengths, ids)

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")).withColumns(
        {"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc", "text_hash", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "text")
    map_arrow(ordered, encoded, SCHEMA).write.option("compression", "none").parquet(folder)


def _segment(part: int, segment: int, first: int, names: list, lengths: list[int], ids: list[bytes]) -> pa.RecordBatch:
    numbers = np.frombuffer(b"".join(ids), "<u4")
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
         pa.array([len(numbers)], pa.int64()), pa.array([names], pa.list_(pa.int64())),
         pa.array([lengths], pa.list_(pa.int64())), pa.array([simple8b.pack(numbers)], pa.binary())],
        ["part", "segment", "first", "n_ids", "docs", "lengths", "payload"])


def _part_starts(files: DataFrame) -> dict[int, int]:
    """Ids before each part: a number per part, from the narrow columns."""
    starts, before = {}, 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts[part], before = before, before + n
    return starts


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc, start, ids)`` of every document of a token file set: the ids of
    all documents before it, and its own ids, the end id included, as
    little-endian unsigned 32-bit numbers."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    starts = spark.sparkContext.broadcast(_part_starts(files))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                base = starts.value[row["part"]] + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(begins + base, pa.int64()),
                     pa.array([ids[b:e].tobytes() for b, e in zip(begins, ends, strict=True)], pa.binary())],
                    ["doc", "start", "ids"])

    return map_arrow(files.select("part", "first", "docs", "lengths", "payload"), decoded,
                     "doc long, start long, ids binary")


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``(start, ids)``: the ids at places ``start`` to ``stop`` of the whole
    set, a row per segment that has some, decoded from the blocks they lie in.

    Segments outside the range are left out by the scan's own filters.
    """
    files = spark.read.schema(SCHEMA).parquet(folder)
    starts = _part_starts(files)
    after = [*sorted(starts.values())[1:], float("inf")]
    bounds = [(p, start - s, stop - s) for (p, s), e in zip(sorted(starts.items()), after, strict=False)
              if s < stop and e > start]
    wanted = F.lit(False)
    for part, low, high in bounds:
        wanted |= (F.col("part") == part) & (F.col("first") < high) & (F.col("first") + F.col("n_ids") > low)
    base = spark.sparkContext.broadcast(starts)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = base.value[row["part"]] + row["first"]
                low, high = max(start - at, 0), stop - at
                ids = simple8b.unpack(row["payload"], low, high).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([at + low], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                                                 ["start", "ids"])

    return map_arrow(files.where(wanted).select("part", "first", "payload"), decoded, "start long, ids binary")
