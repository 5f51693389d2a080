"""Operator 2: token counts by a two-tier lookup on the map side.

A pre-token is a run between ASCII white space; no normalisation, special
string or merge of the supported tokenizers crosses that white space, so the
count of a text is the sum over its pre-tokens.  Tier one is a compact table
``pre-token -> length`` of the corpus's frequent pre-tokens, broadcast to all
tasks.  Tier two is a worker's cache; what it misses is encoded by the
library, each distinct pre-token of a batch once.  Pre-tokens are never
shuffled: the frequent ones come from bounded per-task summaries of all
texts (counters that drop their rarest entries when full), which are merged.
The table only saves work; counts don't depend on what it holds.

Tokenizers that keep white space (byte-level ones, sentencepiece) are counted
on whole texts, with a cache of texts' counts left out.
"""

from __future__ import annotations

import json
import os
import sys
import types
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import map_arrow, parts_of, utf8

#: Pre-tokens in the broadcast table (about 20 bytes each).
TABLE = 8_000
#: Counters a task holds before it drops the rarer half.
SUMMARY = 100_000
#: Pre-tokens a worker caches (about 150 bytes each); when full, it starts again.
CACHE = 1_000_000
#: Summaries that are merged at once.
FAN_IN = 32


def drops_white_space(path: str) -> bool:
    """Whether the tokenizer's pre-tokens never hold white space, so that a
    text may be cut there: its pre-tokenizer keeps only matches of classes
    without ``\\s``, and its normaliser works on single characters."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    split = steps[0]
    kept = (split.get("pattern") or {}).get("Regex", "")
    return (split.get("type") == "Split" and split.get("behavior") == "Removed" and bool(split.get("invert"))
            and r"[^\s\p{L}\p{N}]+" in kept and " " not in kept and not spec.get("post_processor")
            and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in spec.get("added_tokens", [])))


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """The library's own token counts of a list of texts."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _worker_state(path: str) -> dict:
    """What a Python worker keeps from task to task: the tokenizer and the cache."""
    name = "_ledgerlens_token_counts"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    state = module.__dict__.setdefault("state", {})
    if path not in state:
        state[path] = {"count": counter(path), "cache": {}}
    return state[path]


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", table: int = TABLE,
                        summary: int = SUMMARY) -> list[str]:
    """About the ``table`` most frequent pre-tokens of all texts, commonest first."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for batch in parts_of(whole, "text"):
                for text in utf8(batch, "text"):
                    seen.update((text or b"").split())
                    if len(seen) > 2 * summary:
                        seen = Counter(dict(seen.most_common(summary)))
        top = [(w, n) for w, n in seen.most_common(table) if len(w) <= 64]
        yield _summary(TaskContext.get().partitionId(), top)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for words, counts in zip(frame["words"], frame["counts"], strict=True):
            for w, n in zip(words, counts, strict=True):
                seen[w] += n
        top = seen.most_common(table)
        return pd.DataFrame({"part": [key[0]], "words": [[w for w, _ in top]], "counts": [[n for _, n in top]]})

    schema = "part int, words array<binary>, counts array<long>"
    texts = docs.select(docs[text_col].alias("text"))
    parts = map_arrow(texts, summarise, schema)
    left = texts.rdd.getNumPartitions()
    while left > 1:  # a tree of merges: no group holds more than FAN_IN summaries
        left = -(-left // FAN_IN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("part").applyInPandas(
            merge, schema)
    parts = parts.collect()
    seen: Counter = Counter()
    for row in parts:  # one row of ``table`` entries
        for w, n in zip(row["words"], row["counts"], strict=True):
            seen[bytes(w)] += n
    order = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table]
    return [w.decode() for w, _ in order]


def _summary(group: int, top: list[tuple[bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int32()), pa.array([[w for w, _ in top]], pa.list_(pa.binary())),
         pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["part", "words", "counts"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", table: int = TABLE) -> DataFrame:
    """``(doc, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``path`` names a tokenizer file (``.json`` or ``.model``) that every
    executor can open.  Counts equal the library's for the whole text, without
    begin, end or added special tokens; special strings inside texts are
    taken as the library takes them.  ``over_limit``: more tokens than
    ``limit``.  Null and empty texts have 0 bytes and tokens.  Repeated rows
    and null ids stay as they are; other columns are not read.
    """
    cut_up = drops_white_space(path)
    words = frequent_pre_tokens(docs, text_col, table) if cut_up else []
    lengths = counter(path)(words) if words else []
    shared = docs.sparkSession.sparkContext.broadcast(
        ("\n".join(words).encode(), bytes(min(n, 255) for n in lengths)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _worker_state(path)
        cache, encode = state["cache"], state["count"]
        packed, sizes = shared.value
        known = {w: n for w, n in zip(packed.split(b"\n"), sizes, strict=True) if n < 255} if sizes else {}
        for whole in batches:
            for batch in parts_of(whole, "text"):
                texts = [t or b"" for t in utf8(batch, "text")]
                if cut_up:
                    n_tokens = _by_pre_token(texts, known, cache, encode)
                else:
                    n_tokens = [n for i in range(0, len(texts), 64)
                                for n in encode([t.decode() for t in texts[i:i + 64]])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(n_tokens, pa.int64())], ["doc", "n_bytes", "n_tokens"])

    counted = map_arrow(docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")), count,
                        "doc long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def _by_pre_token(texts: list[bytes], known: dict, cache: dict, encode) -> list[int]:
    """Token counts of texts, missing pre-tokens encoded once and cached."""
    split = [t.split() for t in texts]
    missing = {w for words in split for w in words if w not in known and w not in cache}
    if missing:
        if len(cache) + len(missing) > CACHE:
            cache.clear()
            missing = {w for words in split for w in words if w not in known}
        new = list(missing)
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            cache.update(zip(part, encode([w.decode() for w in part]), strict=True))
    get = known.get
    out = []
    for words in split:
        total = 0
        for w in words:
            n = get(w)
            total += cache[w] if n is None else n
        out.append(total)
    return out
