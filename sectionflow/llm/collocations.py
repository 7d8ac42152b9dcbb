"""Collocations: phrases of two or three words that occur together more often than their parts would by chance.

Two passes over the texts.  The first finds which phrases can be frequent.  Keys of phrases
(hashes of their words and language) are dealt to hash partitions; a task counts the keys
of its texts and sends each partition its counts.  A partition merges them into a
Misra-Gries summary: a table of at most ``capacity`` counters; when there are more keys,
the count of rank capacity + 1 is taken from all of them and what is not above 0 goes.
As the capacity exceeds the partition's mass divided by the threshold, no key loses as
much as the threshold, and what a summary has taken away is known, so a phrase that
occurs often enough always survives.  Summaries merge in any order.

The second pass counts exactly.  Survivors are told by a table of bits, of a bounded size,
in which each partition owns a stretch; phrases whose bit is set are counted, in tasks
first, then by the phrase itself.  A wrong bit costs time only, as rare phrases are dropped
by their exact counts.  Inside a block of text phrases are told apart by 64-bit hashes: two
of the n phrases of a block are confused with a probability of n * n / 2 ** 65, below 1e-6
for the sizes used here.

Scores are integers from decimals of 38 digits, exact for counts below 9e15.

Defined cases: NULL and empty texts have no words; a NULL language is ``und``; letters A-Z
are lowered, others are left alone; repeated rows count as often as they occur; phrases of
one score and count are ranked by their bytes; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.llm.common import ship
from sectionflow.session import materialize

UNKNOWN = "und"
BLOCK_BYTES = 1 << 20  # text whose phrases are counted at once; a longer text is cut between words
HELD_KEYS = 1_500_000  # different keys a task holds before it hands their counts on
PART_MASS = 4_000_000  # phrases, repeats included, of a partition, about
MOST_PARTS = 1 << 20
SPARE = 4  # capacity of a summary, in multiples of the least that is right
LOW = np.uint64((1 << 40) - 1)  # bits of a key by which a partition tells its keys apart
STRETCH_BYTES = 1 << 17  # bits of a partition
TABLE_BYTES = 1 << 26  # bits of all partitions

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# Bytes that end a piece of text, and that part its words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _B
    return x ^ x >> np.uint64(29)


_KIND = np.zeros(256, np.uint8)  # 0 inside a word, 1 blank, 2 break
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = 1, 2
_GAP = re.compile(b"[" + re.escape(BREAKS + BLANKS) + b"]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_OF_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _A)


class Powers:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_A), -1, 1 << 64))
            self.up, self.down = (np.r_[np.uint64(1), np.full(n - 1, x)].cumprod(dtype=np.uint64) for x in (_A, inverse))


class Block:
    """The words of some texts: where they are, their hashes and pieces, and keys of their phrases.

    Phrases that end within the first ``old`` words are those of the block before.
    """

    def __init__(self, texts: list[bytes], seeds: list[int], powers: Powers, old: int = 0):
        self.old = old
        joined = b"\n".join(texts)  # a text ends like a piece
        data = _LOWER[np.frombuffer(joined, np.uint8)]
        kind = _KIND[data]
        word = np.r_[False, kind == 0, False]
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.begins, self.ends = edges[::2], edges[1::2]
        self.data = data
        breaks = np.cumsum(kind == 2)
        self.piece = breaks[self.begins] if len(self.begins) else np.zeros(0, np.int64)
        powers.grow(len(data) + 1)
        sums = np.r_[np.uint64(0), np.cumsum(_OF_BYTE[data] * powers.up[: len(data)], dtype=np.uint64)]
        self.hashes = _mixed((sums[self.ends] - sums[self.begins]) * powers.down[self.begins] + _A)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(starts, self.begins, side="right") - 1
        self.seeds = np.array(seeds, np.uint64)[self.text] if len(seeds) else np.zeros(0, np.uint64)

    def keys(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length in words, keys and first words of all phrases of up to ``longest`` words."""
        key = self.seeds
        for size in range(1, longest + 1):
            n = len(self.hashes) - size + 1
            if n < 1:
                return
            key = _mixed((key[:n] ^ self.hashes[size - 1 :]) * _A + np.uint64(size))
            first = np.flatnonzero(self.piece[:n] == self.piece[size - 1 :])
            first = first[first + size > self.old]
            yield size, key[first], first

    def phrases(self, first: np.ndarray, size: int) -> pa.StringArray:
        """The phrases of ``size`` words that begin at the words ``first``, a space between words."""
        lengths = self.ends - self.begins
        starts = np.cumsum(lengths + 1) - lengths - 1  # in a text with one space after each word
        spaced = np.full(int((lengths + 1).sum()), ord(" "), np.uint8)
        spaced[_ranges(starts, lengths)] = self.data[_ranges(self.begins, lengths)]
        sizes = starts[first + size - 1] + lengths[first + size - 1] - starts[first]
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        content = spaced[_ranges(starts[first], sizes)]
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(content))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def blocks(batches: Iterable[pa.RecordBatch], longest: int) -> Iterator[tuple[list[str], Block]]:
    """Blocks of the texts and the languages of these; phrases have up to ``longest`` words."""
    powers = Powers()
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            content = text.as_py() or b""
            if len(content) > BLOCK_BYTES:
                yield from _cut_text(content, lang, powers, longest)
                continue
            texts.append(content)
            langs.append(lang)
            size += len(content)
            if size >= BLOCK_BYTES:
                yield langs, Block(texts, _seeds(langs), powers)
                texts, langs, size = [], [], 0
    if texts:
        yield langs, Block(texts, _seeds(langs), powers)


def _seeds(langs: list[str]) -> list[int]:
    known = {x: xxhash.xxh64_intdigest(x) for x in set(langs)}
    return [known[x] for x in langs]


def _cut_text(text: bytes, lang: str, powers: Powers, longest: int) -> Iterator[tuple[list[str], Block]]:
    """Blocks of one long text; each begins with the last words of the one before, as phrases may go on."""
    begin = end = old = 0
    while end < len(text):
        gap = _GAP.search(text, min(end + BLOCK_BYTES, len(text)))
        end = gap.start() + 1 if gap else len(text)
        block = Block([text[begin:end]], _seeds([lang]), powers, old)
        yield [lang], block
        old = min(longest - 1, len(block.begins))
        begin = begin + int(block.begins[-old]) if old else end


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their added counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, each too low by ``taken`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Add counts of keys, or the counters of another summary and what that has taken away."""
        keys, counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        self.taken += taken
        if len(keys) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            counts = counts - least
            keys, counts = keys[counts > 0], counts[counts > 0]
            self.taken += least
        self.keys, self.counts = keys, counts

    def possible(self, threshold: int) -> np.ndarray:
        """The keys that may occur ``threshold`` times; never leaves out one that does."""
        return self.keys[self.counts + self.taken >= threshold]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each key; keys in order are in order of their partitions."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """The low 40 bits of the keys, five bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    keys = np.zeros((len(data) // 5, 8), np.uint8)
    keys[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return keys.reshape(-1).view("<u8")


def bit_of(keys: np.ndarray, stretch: int) -> np.ndarray:
    """Place of the low 40 bits of the keys in a stretch of so many bytes."""
    return ((keys & LOW) * np.uint64(8 * stretch) >> np.uint64(40)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))


def partial_counts(docs: DataFrame, longest: int, parts: int) -> DataFrame:
    """Columns part, keys, counts: what each task has counted, a row for each partition and time it hands on."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def handed() -> pa.RecordBatch:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            ends = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
            used = [i for i in range(parts) if ends[i] < ends[i + 1]]
            rows = [(packed(keys[ends[i] : ends[i + 1]]), counts[ends[i] : ends[i + 1]].astype("<i4").tobytes()) for i in used]
            columns = [pa.array(used, pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"])

        for _, block in blocks(batches, longest):
            found = [keys for _, keys, _ in block.keys(longest)]
            if found:
                held.append(np.unique(np.concatenate(found), return_counts=True))
                n += len(held[-1][0])
            if n > HELD_KEYS:
                held, n = [summed(*(np.concatenate(x) for x in zip(*held)))], 0
                if len(held[0][0]) > HELD_KEYS // 2:
                    yield handed()
                    held = []
                else:
                    n = len(held[0][0])
        if held:
            yield handed()

    return _texts(docs).mapInArrow(kernel, "part int, keys binary, counts binary")


def survivors(counted: DataFrame, threshold: int, stretch: int) -> DataFrame:
    """Columns part, bits: the keys of each partition that may occur ``threshold`` times, as a table of bits.

    A partition holds the counts of about ``PART_MASS`` phrases, however often one of them occurs.
    """

    def kernel(group: pa.Table) -> pa.Table:
        counts = [np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in group.column("counts")]
        mass = sum(int(c.sum()) for c in counts)
        summary = Summary(SPARE * (mass // threshold + 1))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for keys, own in zip(group.column("keys"), counts):  # as many at once as the summary holds
            held.append((unpacked(keys.as_py()), own))
            if sum(len(c) for _, c in held) > summary.capacity:
                summary.merge(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            summary.merge(*map(np.concatenate, zip(*held)))
        bits = np.zeros(8 * stretch, np.uint8)
        bits[bit_of(summary.possible(threshold), stretch)] = 1
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return counted.groupBy("part").applyInArrow(kernel, "part int, bits binary")


def exact_counts(docs: DataFrame, longest: int, threshold: int) -> DataFrame:
    """Columns lang, size, phrase, f: all phrases of up to ``longest`` words that occur ``threshold`` times in a
    language, and a row of size 0 with the number of its words."""
    spark = docs.sparkSession
    # words take two bytes each at least, their blank included
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(MOST_PARTS, max(1, text_bytes * longest // 6 // PART_MASS)))
    stretch = max(8, min(STRETCH_BYTES, TABLE_BYTES // parts))
    table = np.zeros((parts, stretch), np.uint8)
    for row in survivors(partial_counts(docs, longest, parts), threshold, stretch).collect():
        table[row.part] = np.frombuffer(row.bits, np.uint8)
    shared = ship(spark, table)  # bounded by TABLE_BYTES

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared()

        def batch(lang: pa.Array, size: int, phrases: pa.Array, n: Iterable[int]) -> pa.RecordBatch:
            columns = [lang, pa.array(np.full(len(lang), size, np.int32)), phrases, pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])

        for langs, block in blocks(batches, longest):
            totals: dict[str, int] = {}
            for lang, n in zip(langs, np.bincount(block.text[block.old :], minlength=len(langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            yield batch(pa.array(list(totals), pa.string()), 0, pa.array([""] * len(totals)), list(totals.values()))
            names = pa.array(langs, pa.string())
            for size, keys, first in block.keys(longest):
                at = bit_of(keys, stretch)
                kept = bits[part_of(keys, parts), at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0
                _, spot, n = np.unique(keys[kept], return_index=True, return_counts=True)
                spot = first[kept][spot]
                yield batch(names.take(pa.array(block.text[spot])), size, block.phrases(spot, size), n)

    found = _texts(docs).mapInArrow(kernel, "lang string, size int, phrase string, f long")
    counts = found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return counts.where((F.col("f") >= threshold) | (F.col("size") == 0))


def _cut(words: Column, size: int, k: int) -> Column:
    return F.struct(
        F.lit(k).alias("k"),
        F.array_join(F.slice(words, 1, k), " ").alias("left"),
        F.array_join(F.slice(words, k + 1, size - k), " ").alias("right"),
    )


def collocations(docs: DataFrame, least: int, longest: int, top: int, covered: int) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of each language.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is cut after each
    of its words; with parts that occur l and r times its score is a million times a * a
    by l * r, rounded down, of the lowest cut.  Phrases that lie in a longer one which
    occurs ``covered`` per cent as often or more are left out; n is the number of words.
    """
    counts = materialize(exact_counts(docs, longest, least), "phrases")
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where("size > 0").select("lang", "phrase", "f")
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = F.lit(None)
    for size in range(2, longest + 1):
        cuts = F.when(F.col("size") == size, F.array(*(_cut(F.col("w"), size, k) for k in range(1, size)))).otherwise(cuts)
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    a, l, r = (F.col(x).cast("decimal(15,0)") for x in "alr")
    scored = scored.withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * a * a, "by": l * r})
    scored = scored.withColumn("score", F.expr("up div by"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    lowest = lowest.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = [
        F.when((F.col("size") > size) & (F.col("size") >= start + size - 1), F.array_join(F.slice("w", start, size), " "))
        for size in range(2, longest)
        for start in range(1, longest - size + 2)
    ]
    if inner:
        longer = phrases.select("lang", "f", F.explode(F.array_compact(F.array(*inner))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
        lowest = lowest.join(longer, ["lang", "phrase"], "left")
        lowest = lowest.where(F.col("cover").isNull() | (100 * F.col("cover") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
