"""Quality classifier: averaged hashed subword vectors and a softmax.

A word's vector is the mean of the hashed vectors of the word itself and of its
letter n-grams; a document's vector is the mean over its words; a linear layer
with softmax gives the classes.  All parameters are learned by stochastic
gradient descent in numpy from at most ``SAMPLE`` labelled documents, chosen by
a hash of the id.  Documents reach the driver as sparse feature weights, never
as texts; the model has ``BUCKETS`` x ``DIM`` numbers whatever the input.

Defined cases: NULL and empty texts have the zero vector, hence the score of the
bias alone; labels that are NULL or have no document are ignored, contradicting
labels of one id are averaged; without labels every score is 0.5; repeated rows
give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionflow.llm.common import fold, ship
from sectionflow.llm.wordtable import WordTable, code_points

SAMPLE = 2000
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 12
RATE = 0.3
GRAMS = (3, 4)
WORD_CHARS = 40  # longer words are not remembered
BULK_CHARS = 4096  # longer words are read in pieces of this size
MEMO_WORDS = 1_000_000
REPEATED = "\x00="  # stands for every pair of equal words, the only word 2-grams used
CHUNK_CHARS = 8_000_000

# Odd constants of the rolling hash; products wrap at 64 bits.
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(BULK_CHARS + 4, 0xC2B2AE3D27D4EB4F, np.uint64), dtype=np.uint64)


def tokens(text: str | None) -> list[str]:
    """Words of a text, and one sign for each word that repeats the one before it."""
    words = (text or "").split()
    return words + [REPEATED] * sum(map(eq, words, words[1:]))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams, one word after the other, and their number for each word.

    For words of at most ``BULK_CHARS`` letters.
    """
    points, lengths = code_points([f"<{w}>" for w in words])
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # places up to the word's end
    rank = np.repeat(lengths, lengths) - left
    owner = np.repeat(np.arange(len(words)), lengths)
    hashes = [np.add.reduceat(points * _POWERS[rank], ends - lengths) if words else np.zeros(0, np.uint64)]
    owners = [np.arange(len(words))]
    for n in GRAMS:
        h = np.full(len(points), n, np.uint64)
        for k in range(n):
            h[: len(points) - k] = h[: len(points) - k] * _BASE + points[k:]
        whole = left >= n
        hashes.append(h[whole])
        owners.append(owner[whole])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return _bucket(np.concatenate(hashes))[order], np.bincount(at, minlength=len(words))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _SPREAD >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def long_word_features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a word of any length and of its n-grams, and how often each occurs; read in pieces."""
    counts, whole, power = np.zeros(BUCKETS, np.int64), np.zeros(1, np.uint64), np.ones(1, np.uint64)
    end, more = len(word) + 2, max(GRAMS) - 1
    for start in range(0, end, BULK_CHARS):
        stop = min(start + BULK_CHARS, end)
        # the word with its signs, and as much of the next piece as an n-gram needs
        piece = "<" * (start == 0) + word[max(start - 1, 0) : stop - 1 + more] + ">" * (stop + more >= end)
        points, _ = code_points([piece])
        own = stop - start
        whole += power * (points[:own] * _POWERS[:own]).sum(dtype=np.uint64)
        power *= _POWERS[own - 1]
        for n in GRAMS:
            h = np.full(max(0, min(own, len(points) - n + 1)), n, np.uint64)
            for k in range(n):
                h = h * _BASE + points[k : k + len(h)]
            counts += np.bincount(_bucket(h), minlength=BUCKETS)
    counts[_bucket(whole)] += 1
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def bulks(words: list[str]) -> Iterator[list[str]]:
    """The words in order, in lists of bounded size."""
    held, chars = [], 0
    for word in words:
        held.append(word)
        chars += len(word)
        if chars >= CHUNK_CHARS // 8:
            yield held
            held, chars = [], 0
    if held:
        yield held


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to 1 (none for a text without words)."""
    words = Counter(tokens(text))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    total, weight = words.total(), np.zeros(BUCKETS)
    for part in bulks([w for w in words if len(w) <= BULK_CHARS]):
        buckets, sizes = word_features(part)
        share = np.fromiter(map(words.__getitem__, part), np.float64, len(part)) / total / sizes
        weight += np.bincount(buckets, np.repeat(share, sizes), BUCKETS)
    for word in (w for w in words if len(w) > BULK_CHARS):
        ids, counts = long_word_features(word)
        weight[ids] += counts * (words[word] / total / counts.sum())
    ids = np.flatnonzero(weight)
    return ids.astype(np.int32), weight[ids].astype(np.float32)


class Model:
    """Vectors of the buckets, and weights and bias of the second class against the first."""

    def __init__(self, seed: int = 7):
        self.vectors = np.random.default_rng(seed).normal(scale=0.1, size=(BUCKETS, DIM)).astype(np.float32)
        self.weights, self.bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        self.table = WordTable(self.word_vectors, DIM, MEMO_WORDS)

    def word_vectors(self, words: list[str]) -> np.ndarray:
        buckets, sizes = word_features(words)
        return np.add.reduceat(self.vectors[buckets], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]

    def long_words(self, words: Counter[str]) -> np.ndarray:
        """Sum of the vectors of words that are not remembered, each as often as it occurs."""
        total = np.zeros(DIM)
        for part in bulks([w for w in words if len(w) <= BULK_CHARS]):
            total += np.fromiter(map(words.__getitem__, part), np.float64, len(part)) @ self.word_vectors(part)
        for word in (w for w in words if len(w) > BULK_CHARS):
            ids, counts = long_word_features(word)
            total += counts @ self.vectors[ids].astype(np.float64) * (words[word] / counts.sum())
        return total

    def probability(self, hidden: np.ndarray) -> np.ndarray:
        logits = (hidden @ self.weights + self.bias).astype(np.float64)
        shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return (shifted / shifted.sum(axis=-1, keepdims=True))[..., 1]


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, with a falling rate."""
    model, rng = Model(seed), np.random.default_rng(seed)
    steps = EPOCHS * len(samples)
    order = (i for _ in range(EPOCHS) for i in rng.permutation(len(samples)))
    for step, i in enumerate(order):
        ids, weight, label = samples[i]
        rate = np.float32(RATE * (1 - step / steps))
        rows = model.vectors[ids]
        hidden = weight @ rows if len(ids) else np.zeros(DIM, np.float32)
        p = np.float32(model.probability(hidden))
        error = np.array([p - label, label - p], np.float32)  # of the two classes: minus the gradient
        back = model.weights @ error
        model.weights += rate * np.outer(hidden, error)
        model.bias += rate * error
        if len(ids):  # weights are means, so a step is scaled by the number of features
            model.vectors[ids] = rows + rate * np.minimum(weight * len(ids), 4)[:, None] * back
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Model of at most ``sample`` labelled documents outside the held-out fold."""
    wanted = labels.where((fold(F.col("doc_id"), folds) != held_out) & F.col("quality").isNotNull())
    wanted = wanted.groupBy("doc_id").agg(F.avg("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most ``sample`` short rows

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [document_features(t) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "label": (batch["q"] >= 0.5).astype("int32"), "ids": [x[0] for x in found], "w": [x[1] for x in found]}
            )

    # an id may come with several rows; the sample stays bounded
    rows = picked.mapInPandas(extract, "doc_id long, label int, ids array<int>, w array<float>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids")).limit(sample).toArrow()
    parts = zip(rows["ids"], rows["w"], rows["label"].to_pylist())
    return train([(i.values.to_numpy(), w.values.to_numpy(), y) for i, w, y in parts])


def text_blocks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """The texts that are not empty with their places, in blocks of bounded size."""
    block, chars = [], 0
    for i, text in enumerate(texts):
        if text:
            block.append((i, text))
            chars += len(text)
        if block and (chars >= CHUNK_CHARS or i == len(texts) - 1):
            yield block
            block, chars = [], 0


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Columns doc_id, score, predicted; one row per row."""
    shared = ship(docs.sparkSession, model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        table = model.table
        for batch in batches:
            hidden = np.zeros((batch.num_rows, DIM), np.float32)
            for block in text_blocks(batch.column("text").to_pylist()):
                words = {i: w for i, text in block if (w := tokens(text))}
                short = {i: [w for w in own if len(w) <= WORD_CHARS] for i, own in words.items()}
                rows = table.rows([w for own in short.values() for w in own])
                end = 0
                for i, own in words.items():
                    end += len(short[i])
                    total = table.table[rows[end - len(short[i]) : end]].sum(axis=0, dtype=np.float64)
                    if len(short[i]) < len(own):
                        total += model.long_words(Counter(w for w in own if len(w) > WORD_CHARS))
                    hidden[i] = total / len(own)
            p = model.probability(hidden)
            columns = [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, score double, predicted int")
