"""Language of texts: script ranges, per-word scores, Viterbi spans.

Every word gets a score for each learned language from the frequencies of its
letter n-grams.  The script of a word narrows its languages to those that use
the script.  The best path through the words of a text, with a penalty for each
change of language, labels spans; the language with most letters is the answer
and its share of the letters the score.

The model is fitted on a bounded sample (``DOCS_PER_LANGUAGE`` labelled rows of
each language, chosen by a hash of the id, in expectation) and holds at most
``MAX_GRAMS`` n-grams of each, so that a small language keeps its own; all rows are scored.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0;
words of a script that no learned language uses are neutral; ties go to the
language first in the alphabet; without any labelled row every text is ``und``;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.llm.common import ship
from sectionflow.llm.wordtable import WordTable, code_points
from sectionflow.session import materialize

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 600
MAX_GRAMS = 30_000  # of each language
SCRIPT_SHARE = 0.01  # of a language's letters that make a script one of its own
SWITCH = 8.0  # penalty of a change of language, in nats
SMOOTH = 0.5
OUTSIDE = -1000.0  # score of a language that does not use the word's script
MEMO_WORDS = 300_000
CHUNK_CHARS = 2_000_000  # texts are labelled together up to this size

# First code point of each script range; letters before the first are Latin.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_NUMBERS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS(text.lower()) if text else []


def scripts_of(first: np.ndarray) -> np.ndarray:
    """Numbers of the script names of letters."""
    return _SCRIPT_NUMBERS[np.searchsorted(_STARTS, first, "right") - 1]


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter 1- to 3-grams of words with marked ends: keys by order and place, 0 where there is none.

    Also the start of each word among the places and the numbers of the scripts of
    the words' first letters.
    """
    points, lengths = code_points([f"^{w}$" for w in words])
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # places up to the word's end
    keys = np.zeros((3, len(points)), np.uint64)
    keys[0] = np.where((left > 1) & (left < np.repeat(lengths, lengths)), points, 0)
    keys[1, :-1] = np.where(left[:-1] > 1, points[:-1] << np.uint64(21) | points[1:], 0)
    keys[2, :-2] = np.where(left[:-2] > 2, keys[1, :-2] << np.uint64(21) | points[2:], 0)
    return keys, starts, scripts_of(points[starts + 1])


class Model:
    """Log probabilities of n-grams and shares of scripts, by language."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        """counts: language, key, count; the key of an n-gram is positive, that of script k is -1 - k."""
        self.languages = sorted({c[0] for c in counts})
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.keys = np.array(sorted({c[1] for c in counts if c[1] > 0}), np.uint64)
        table, scripts = np.zeros((len(self.keys), len(at))), np.zeros((len(SCRIPT_NAMES), len(at)))
        place = {int(k): i for i, k in enumerate(self.keys)}
        for lang, key, n in counts:
            if key > 0:
                table[place[key], at[lang]] += n
            else:
                scripts[-1 - key, at[lang]] += n
        logs = np.log(table + SMOOTH) - np.log(table.sum(axis=0) + SMOOTH * (len(table) + 1))
        if len(at):
            logs -= logs.max(axis=1, keepdims=True)
        self.logs = np.vstack([logs, np.zeros((1, len(at)))]).astype(np.float32)  # last: unknown n-grams
        self.uses = (scripts >= SCRIPT_SHARE * scripts.sum(axis=0)) & (scripts > 0)
        self.table = WordTable(self.scores, len(at), MEMO_WORDS)

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each word for each language."""
        keys, starts, script = gram_keys(words)
        total = np.zeros((keys.shape[1], len(self.languages)), np.float32)
        for order in keys:
            row = np.minimum(np.searchsorted(self.keys, order), len(self.keys) - 1)
            total += self.logs[np.where(self.keys[row] == order, row, len(self.keys))]
        total = np.maximum(np.add.reduceat(total, starts, axis=0), OUTSIDE / 2)
        uses = self.uses[script]
        known = uses.any(axis=1, keepdims=True)
        return np.where(known, np.where(uses, total, OUTSIDE), 0)


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of many sequences at once; ``scores`` holds them one after the other."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # sequences longer than t
    stay, top = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    value = np.zeros((len(lengths), scores.shape[1]), np.float32)
    for t in range(longest):
        n = alive[t]
        rows = starts[:n] + t
        if t:
            old = value[:n]
            jump = old.max(axis=1, keepdims=True) - penalty
            top[rows] = old.argmax(axis=1)
            stay[rows] = old >= jump
            np.maximum(old, jump, out=old)
        value[:n] += scores[rows]
        if t % 64 == 0:
            value[:n] -= value[:n].max(axis=1, keepdims=True)
    path, state = np.zeros(len(scores), np.int32), value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        rows = starts[:n] + t
        path[rows] = state[:n]
        if t:
            state[:n] = np.where(stay[rows, state[:n]], state[:n], top[rows])
    return path


class Labeller:
    """Labels the words of texts."""

    def __init__(self, model: Model):
        self.model = model

    def paths(self, texts: list[str | None]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """Index, words and labels of each text, in order."""
        block: list[list[str]] = []
        first = chars = 0
        for i, text in enumerate(texts):
            block.append(words_of(text))
            chars += len(text or "")
            if chars >= CHUNK_CHARS or i == len(texts) - 1:
                yield from self._label(first, block)
                block, first, chars = [], i + 1, 0

    def _label(self, first: int, block: list[list[str]]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        lengths = np.array([len(w) for w in block])
        if self.model.languages:
            rows = self.model.table.rows([w for words in block for w in words])
            path = best_paths(self.model.table.table[rows], lengths, SWITCH)
        else:
            path = np.zeros(int(lengths.sum()), np.int32)
        for k, (end, words) in enumerate(zip(np.cumsum(lengths), block)):
            yield first + k, words, path[end - len(words) : end]

    def language(self, words: list[str], path: np.ndarray) -> tuple[str, float]:
        """Language with most letters and its share of them."""
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        letters = np.bincount(path, np.fromiter(map(len, words), np.float64, len(words)), len(self.model.languages))
        best = int(letters.argmax())
        return self.model.languages[best], float(letters[best] / letters.sum())

    def languages(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and share of each text."""
        found = [self.language(words, path) for _, words, path in self.paths(texts)]
        return [x[0] for x in found], [x[1] for x in found]

    def spans(self, words: list[str], path: np.ndarray) -> list[tuple[int, int, str]]:
        """First word, last word (exclusive) and language of each span of one language."""
        cuts = np.flatnonzero(np.diff(path)) + 1
        edges = [0, *cuts.tolist(), len(words)] if words else [0]
        return [(a, b, self.model.languages[path[a]]) for a, b in zip(edges, edges[1:])] if self.model.languages else []


def fit(docs: DataFrame, train: Column, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Model of the labelled rows that ``train`` selects.

    Rows of each language are thinned to about ``per_language`` by a hash of the
    id; their n-grams are counted in tasks and summed by Spark, and the most
    frequent ``MAX_GRAMS`` of each language are fetched.
    """
    rows = docs.where(train & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    # Written, so that the few rows go to the texts, not the texts to them.
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("n") < F.lit(per_language << 20)
    sample = rows.join(sizes, "lang").where(drawn).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for lang, texts in batch.groupby("lang")["text"]:
                words = [w for text in texts for w in words_of(text)]
                if not words:
                    continue
                keys, _, script = gram_keys(words)
                grams, n = np.unique(keys[keys > 0], return_counts=True)
                letters = np.bincount(script, np.fromiter(map(len, words), np.float64, len(words)))
                used = np.flatnonzero(letters)
                parts.append(pd.DataFrame({"lang": lang, "key": grams.astype(np.int64), "n": n}))
                parts.append(pd.DataFrame({"lang": lang, "key": -1 - used, "n": letters[used].astype(np.int64)}))
            yield from parts

    counts = sample.mapInPandas(count, "lang string, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.when(F.col("key") < 0, 0).otherwise(1), F.desc("n"), "key")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_GRAMS).select("lang", "key", "n")
    top = top.orderBy("lang", "key")
    return Model([tuple(r) for r in top.collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, lang_pred, score; one row per row."""
    shared = ship(docs.sparkSession, model)  # bounded by MAX_GRAMS for each language

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared())
        for batch in batches:
            names, shares = labeller.languages(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(kernel, "doc_id long, lang_pred string, score double")


def in_one_language(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language has at least the given share of the letters."""
    shared = ship(docs.sparkSession, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared())
        for batch in batches:
            names, shares = labeller.languages(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and x >= least for n, x in zip(names, shares)], pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, first_word, end_word, lang: the spans of mixed-language texts."""
    shared = ship(docs.sparkSession, model)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared())
        for batch in batches:
            ids, rows = batch["doc_id"].tolist(), []
            for i, words, path in labeller.paths(batch["text"].tolist()):
                rows += [(ids[i], *span) for span in labeller.spans(words, path)]
            yield pd.DataFrame(rows, columns=["doc_id", "first_word", "end_word", "lang"])

    return docs.select("doc_id", "text").mapInPandas(kernel, "doc_id long, first_word long, end_word long, lang string")
