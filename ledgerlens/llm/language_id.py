"""Operator 8: language identification with word-first backoff.

A word the model knows adds its log frequency in each language.  A word it
doesn't know is scored by its character n-grams, longest first: each position
takes the longest n-gram the model knows that starts there, falling back to
shorter ones.  The sums give a probability per language.

The model is fitted on a bounded sample of labelled documents: for each
language about ``sample`` of them, those whose ids hash lowest.  It keeps
the ``max_words`` and ``max_grams`` most frequent entries of each language, so
what is broadcast has a bound too.  Every document is predicted from its whole
text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.storage import cut
from ledgerlens.llm.words import map_arrow, parts_of

#: Labelled documents per language that the model learns from.
SAMPLE = 2_000
MAX_WORDS = 20_000
MAX_GRAMS = 20_000
LONGEST = 5
#: Rare entries say little; they are left to the n-grams.
LEAST_COUNT = 2
UNDETERMINED = "und"
#: Words whose scores a task keeps (about 200 bytes each).
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")
#: Marks of a word's ends; alone they say nothing.
_ENDS = ("<", ">")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies: ``scores`` has a column for each language and a row for
    each entry; ``tables[0]`` gives the rows of words, ``tables[n]`` those of
    character n-grams."""

    languages: list[str]
    tables: list[dict[str, int]]
    scores: np.ndarray

    def packed(self) -> tuple:
        """Compact form for the broadcast: the rows' names in order."""
        return self.languages, ["\n".join(t) for t in self.tables], self.scores

    @staticmethod
    def unpacked(data: tuple) -> Model:
        languages, names, scores = data
        tables, start = [], 0
        for text in names:
            entries = text.split("\n") if text else []
            tables.append(dict(zip(entries, range(start, start + len(entries)), strict=True)))
            start += len(entries)
        return Model(languages, tables, scores)

    def rows_of(self, word: str) -> list[int]:
        """Rows that score a word: its own, or those of its n-grams; none if
        the model knows nothing of it."""
        known = self.tables[0].get(word)
        if known is not None:
            return [known]
        marked, found = f"<{word}>", []
        for i in range(len(marked)):
            for n in range(min(LONGEST, len(marked) - i), 0, -1):
                gram = marked[i:i + n]
                row = self.tables[n].get(gram)
                if row is not None:
                    if gram not in _ENDS:
                        found.append(row)
                    break
        return found


class Predictor:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.blank = len(model.scores)
        self.rows = np.concatenate([model.scores, np.zeros((1, len(model.languages)), np.float32)])
        self.known: dict[str, int] = {}
        self.scores = np.empty((1024, len(model.languages)), np.float32)

    def word_scores(self, new: list[str]) -> np.ndarray:
        """Scores of words: the mean of the rows that each is scored by."""
        starts, rows = [], []
        for w in new:
            starts.append(len(rows))
            rows.extend(self.model.rows_of(w) or (self.blank,))
        count = np.diff(starts, append=len(rows))
        return np.add.reduceat(self.rows[rows], starts, axis=0) / count[:, None]

    def learn(self, met: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(met.difference(self.known))
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            first = len(self.known)
            while first + len(part) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[first:first + len(part)] = self.word_scores(part)
            self.known.update(zip(part, range(first, first + len(part)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability of each text; undetermined (0)
        without letters."""
        found = [words(t or "") for t in texts]
        if self.model.languages:
            self.learn(set().union(*found))
        return [self._judge(f) for f in found]

    def _judge(self, found: list[str]) -> tuple[str, float]:
        languages = self.model.languages
        if not languages or not any(any(map(str.isalpha, w)) for w in found):
            return UNDETERMINED, 0.0
        rows = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        total = self.scores[rows].sum(axis=0, dtype=np.float64)
        # words of a text are not independent: the evidence counts as its square root
        total /= np.sqrt(len(found))
        weight = np.exp(total - total.max())
        best = int(np.argmax(weight))
        return languages[best], float(weight[best] / weight.sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Model from labelled documents; rows with a null label, text or id are
    left out.  Without any the model knows no language."""
    rows = docs.select(F.xxhash64(docs[id_col]).alias("place"), docs[text_col].alias("text"),
                       docs[lang_col].alias("lang")).where(
        docs[id_col].isNotNull() & docs[text_col].isNotNull() & docs[lang_col].isNotNull())
    # about ``sample`` of a language's rows have a hash below its limit
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one per language
    limits = {lang: min(2**63 - 1, 2**64 * sample // n - 2**63) for lang, n in held.items()}
    if not limits:
        return Model([], [{} for _ in range(LONGEST + 1)], np.empty((0, 0), np.float32))
    last = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
    chosen = rows.where(F.col("place") <= last[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            out: Counter = Counter()
            for lang, found in seen.items():
                for w, c in found.items():
                    out[lang, 0, w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            out[lang, n, g] += c
            keys = list(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.string()), pa.array(list(out.values()), pa.int64())],
                ["lang", "n", "entry", "c"])

    counts = cut(map_arrow(chosen, count, "lang string, n int, entry string, c long")
                 .groupBy("lang", "n", "entry").agg(F.sum("c").alias("c")))
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
    by_count = Window.partitionBy("lang", "n").orderBy(F.desc("c"), "entry")
    top = (counts.where((F.col("c") >= LEAST_COUNT) | (F.col("n") == 1))
           .withColumn("nth", F.row_number().over(by_count))
           .where(F.col("nth") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams)))
    return _model(sorted(limits), top.select("lang", "n", "entry", "c").orderBy("n", "entry").toArrow(), totals.collect())


def _model(languages: list[str], top: pa.Table, totals: list) -> Model:
    """Log frequencies with half a count for entries a language doesn't have."""
    at = {lang: i for i, lang in enumerate(languages)}
    size = np.ones((LONGEST + 1, len(languages)))
    for r in totals:
        size[r["n"], at[r["lang"]]] = r["total"] + 0.5 * r["kinds"]
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    n = top.column("n").to_numpy()
    place = np.empty(top.num_rows, np.int64)
    last, row = None, -1
    for i, entry in enumerate(top.column("entry").to_pylist()):  # sorted by n and entry
        if (n[i], entry) != last:
            last, row = (n[i], entry), row + 1
            tables[n[i]][entry] = row
        place[i] = row
    found = np.full((row + 1, len(languages)), 0.5)
    column = np.array([at[x] for x in top.column("lang").to_pylist()], np.int64)
    found[place, column] = top.column("c").to_numpy()
    of_row = np.repeat(np.arange(LONGEST + 1), [len(t) for t in tables])
    return Model(languages, tables, np.log(found / size[of_row]).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred",
            score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability (0 to 1).

    Null texts and texts without a letter get ``und`` and 0; so does every
    text if the model knows no language.  Ties go to the language that sorts
    first.  Other columns pass unchanged; ``pred_col`` and ``score_col``
    replace columns of the same name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    kept = [f for f in docs.schema.fields if f.name not in (pred_col, score_col)]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*[docs[f.name].alias(n) for f, n in zip(kept, names, strict=True)],
                       docs[text_col].alias("read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Predictor(Model.unpacked(shared.value))
        for whole in batches:
            for batch in parts_of(whole, "read", 2 << 20):
                got = judge(batch.column("read").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(kept))], pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())], [*names, "pred", "prob"])

    schema = rows.drop("read").schema.add("pred", "string").add("prob", "double")
    done = map_arrow(rows, run, schema)
    return done.select(*[F.col(n).alias(f.name) for f, n in zip(kept, names, strict=True)],
                       F.col("pred").alias(pred_col), F.col("prob").alias(score_col))


def held_out(doc_id: Column, fold: int = 1, folds: int = 3) -> Column:
    """Whether a document is kept from learning: by the crc32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
