"""Removal of repeated passages with FM-indexes over shards of the corpus.

A word goes if it is covered by a window of ``WINDOW`` words whose sequence also
starts in a document with a smaller id.

Shards follow content, not documents, so that a document is streamed to the few
shards that can hold its passages.  A window's anchor is the smallest hash of its
runs of ``ANCHOR`` words; equal windows have equal anchors, and consecutive
windows with one anchor form a segment.  Anchors that only one document has are
left out.  The segments of the others meet by anchor; those of an anchor with more
than ``ANCHOR_SEGMENTS`` are cut into windows, which meet by the hash of the whole
window, so that no group grows with the corpus.  Each shard builds an
FM-index of its segments (a wavelet matrix of packed bits over the transform of
suffixes sorted by their first 16 words) and a backward search gives for every
window the interval of its occurrences and so the smallest document.

Rows of copies are combined in the tasks before each shuffle: an anchor, or a
segment of identical words, leaves a task once however many documents share it.
Words travel as 40 bits of their hash.

Defined cases: NULL and empty texts have no words; shorter texts than the window
have nothing to remove; a NULL doc_id is neither smaller nor larger than any, so
such rows keep everything; rows with one id are not repeats of each other, and each
loses its own repeats; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.session import materialize

WINDOW = 13
ANCHOR = 4
SORTED = 16  # words by which suffixes are sorted; at least WINDOW, a power of two
SYMBOL_BYTES = 5
ANCHOR_MASK = (1 << 48) - 1
BLOCK_SEGMENTS = 500_000  # segments that a task combines before they leave it
INDEX_SYMBOLS = 3_000_000  # symbols of a block, copies counted; a group of one anchor is not parted
ANCHOR_SEGMENTS = 50_000  # segments around one anchor that meet as they are
LONG_WORD = 256  # bytes
CHUNK_BYTES = 2 << 20  # text hashed at once

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _random(seed: int, n: int) -> np.ndarray:
    """Fixed 64-bit numbers that look random."""
    x = np.arange(1, n + 1, dtype=np.uint64) * _A + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_OF_BYTE = np.where(_IN_WORD, _random(1, 256), np.uint64(0))
_OF_PLACE = _random(2, LONG_WORD) | np.uint64(1)


def hashed_words(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text; short texts are hashed together."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield from _hash_together(held)
            held, size = [], 0
    if held:
        yield from _hash_together(held)


def _hash_together(texts: list[bytes]) -> list[np.ndarray]:
    """Hash of a word: sum over its bytes of a number of the byte times one of its place; longer ones by XXH64."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    inside = _IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    hashes = np.zeros(len(starts), np.uint64)
    cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(data), CHUNK_BYTES)), len(starts)])
    for a, b in zip(cuts, cuts[1:]):
        low, high = starts[a], starts[b] if b < len(starts) else len(data)
        own = starts[a:b] - low
        sizes = np.diff(np.r_[own, high - low])  # up to the next word, white space counts nothing
        place = np.arange(high - low) - np.repeat(own, sizes)
        values = _OF_BYTE[data[low:high]] * _OF_PLACE[np.minimum(place, LONG_WORD - 1)]
        hashes[a:b] = np.add.reduceat(values, own)
        for i in np.flatnonzero(sizes > LONG_WORD):
            word = data[low + own[i] : low + own[i] + sizes[i]].tobytes().split()[0]
            if len(word) > LONG_WORD:
                hashes[a + i] = xxhash.xxh64_intdigest(word)
    hashes = (hashes ^ hashes >> np.uint64(32)) * _B
    hashes ^= hashes >> np.uint64(29)
    return np.split(hashes, np.searchsorted(starts, ends[:-1]))


def segments(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each segment."""
    n = len(words) - WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    runs = np.zeros(len(words) - ANCHOR + 1, np.uint64)
    for i in range(ANCHOR):
        runs = (runs ^ words[i : len(words) - ANCHOR + 1 + i]) * _A
        runs ^= runs >> np.uint64(29)
    runs *= _B
    runs ^= runs >> np.uint64(32)
    low = runs[:n].copy()
    for i in range(1, WINDOW - ANCHOR + 1):
        np.minimum(low, runs[i : n + i], out=low)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return (low[first] & np.uint64(ANCHOR_MASK)).astype(np.int64), first, np.diff(np.r_[first, n])


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest document that shares the key of each row."""
    order = np.argsort(keys, kind="stable")
    starts = _runs(keys[order])
    sizes = np.diff(np.r_[starts, len(keys)])
    low, high = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    if len(keys):
        low[order] = np.repeat(np.minimum.reduceat(docs[order], starts), sizes)
        high[order] = np.repeat(np.maximum.reduceat(docs[order], starts), sizes)
    return low, high


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Columns anchor, doc, n, shared: anchors of every document and their segments, combined in each task.

    A row that is shared already has company in its task and needs none elsewhere;
    the row of the smallest document is there twice, once to be found by others.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            anchors, owners, counts = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.int64)]) for i in range(3))
            low, high = _smallest(anchors, owners)
            shared, open_ = low < high, owners == low
            columns = [np.concatenate([x[shared], x[open_]]) for x in (anchors, owners, counts)]
            told = np.r_[np.ones(shared.sum(), bool), np.zeros(open_.sum(), bool)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(told)], ["anchor", "doc", "n", "shared"])

        for batch in batches:
            texts = (text.as_py() or b"" for text in batch.column("text"))
            for doc, words in zip(batch.column("doc").to_pylist(), hashed_words(texts)):
                anchors, counts = np.unique(segments(words)[0], return_counts=True)
                held.append((anchors, np.full(len(anchors), doc), counts))
                size += len(anchors)
                if size >= BLOCK_SEGMENTS:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return _texts(docs).mapInArrow(kernel, "anchor long, doc long, n long, shared boolean")


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """Columns doc, h, packed: compressed texts, for the joins that move them, and their hashes, as ids may repeat."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([pack(x.as_py() or b"") for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("h"), packed], ["doc", "h", "packed"])

    text = F.col("text").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.mapInArrow(kernel, "doc long, h long, packed binary")


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Columns doc, anchors (anchor, n): for each document its anchors that other documents have too."""
    rows = anchor_rows(docs)
    # rows known to be shared need no meeting: they are spread by document
    group = F.struct(F.when(~F.col("shared"), F.col("anchor")), F.when(F.col("shared"), F.xxhash64("doc", "anchor")))
    w = Window.partitionBy(group.alias("g"))
    met = rows.withColumn("low", F.min("doc").over(w)).withColumn("high", F.max("doc").over(w))
    met = met.where(F.col("shared") | (F.col("low") < F.col("high")))
    return met.groupBy("doc").agg(F.collect_set(F.struct("anchor", "n")).alias("anchors"))


def busy_anchors(anchors: DataFrame, most: int) -> np.ndarray:
    """The anchors with more than ``most`` segments, in order; their number is at most that of all segments by ``most``."""
    each = anchors.select(F.explode("anchors").alias("a")).groupBy("a.anchor").agg(F.sum("a.n").alias("n"))
    return np.sort(each.where(F.col("n") > most).select("anchor").toArrow()["anchor"].to_numpy())


def segment_rows(docs: DataFrame, anchors: DataFrame, busy: np.ndarray) -> DataFrame:
    """Columns anchor, doc, h, at, n, words: segments with shared anchors, combined in each task.

    Those of a busy anchor are cut into their windows, with the hash of a window for an anchor.

    A segment that a smaller document has word by word in the same task is decided:
    it has no words and an anchor that only spreads it.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            if not held:
                return pa.RecordBatch.from_pylist([], schema)
            anchor, doc, at, n, key, own = (np.concatenate([h[i] for h in held]) for i in range(6))
            contents = [c for h in held for c in h[6]]
            low, _ = _smallest(key, doc)
            decided = doc > low
            cut = np.flatnonzero(np.isin(anchor, busy) & ~decided)
            if len(cut):
                keep = np.delete(np.arange(len(anchor)), cut)
                windows = n[cut]
                offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                parts = [contents[i][a * SYMBOL_BYTES : (a + WINDOW) * SYMBOL_BYTES] for i, m in zip(cut.tolist(), windows.tolist()) for a in range(m)]
                part_key = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
                part_doc = np.repeat(doc[cut], windows)
                part_low, _ = _smallest(part_key, part_doc)
                anchor = np.r_[anchor[keep], (part_key & np.uint64(ANCHOR_MASK)).astype(np.int64)]
                doc, at = np.r_[doc[keep], part_doc], np.r_[at[keep], np.repeat(at[cut], windows) + offset]
                own = np.r_[own[keep], np.repeat(own[cut], windows)]
                n, key = np.r_[n[keep], np.ones(len(parts), np.int64)], np.r_[key[keep], part_key]
                decided = np.r_[decided[keep], part_doc > part_low]
                contents = [contents[i] for i in keep.tolist()] + parts
            words = pa.array([None if d else c for d, c in zip(decided.tolist(), contents)], pa.binary())
            spread = np.where(decided, -1 - ((key ^ doc.astype(np.uint64) * _A) & np.uint64(ANCHOR_MASK)).astype(np.int64), anchor)
            return pa.RecordBatch.from_arrays([*map(pa.array, (spread, doc, own, at, n)), words], schema=schema)

        for batch in batches:
            texts = (unpack(packed.as_py()) for packed in batch.column("packed"))
            ids = zip(batch.column("doc").to_pylist(), batch.column("h").to_pylist())
            for (doc, h), words, own in zip(ids, hashed_words(texts), batch.column("anchors")):
                anchor, at, n = segments(words)
                kept = np.isin(anchor, own.values.field("anchor").to_numpy())
                anchor, at, n = anchor[kept], at[kept], n[kept]
                raw = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL_BYTES].tobytes()
                contents = [raw[a * SYMBOL_BYTES : (a + m + WINDOW - 1) * SYMBOL_BYTES] for a, m in zip(at.tolist(), n.tolist())]
                key = np.fromiter(map(xxhash.xxh64_intdigest, contents), np.uint64, len(contents))
                held.append((anchor, np.full(len(at), doc), at, n, key, np.full(len(at), h), contents))
                size += len(at)
                if size >= BLOCK_SEGMENTS:
                    yield flush()
                    held, size = [], 0
        yield flush()

    schema = pa.schema([*((c, pa.int64()) for c in ("anchor", "doc", "h", "at", "n")), ("words", pa.binary())])
    rows = packed_texts(docs.where("doc_id is not null")).join(anchors, "doc")
    return rows.mapInArrow(kernel, "anchor long, doc long, h long, at long, n long, words binary")


class WaveletMatrix:
    """Sequence of symbols below ``2 ** levels`` as packed bits with counts for ranks."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.bits, self.counts, self.zeros, self.levels = [], [], [], levels
        self.begin = np.arange(1 << levels)  # symbols; becomes where each symbol's stretch begins
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        starts = _runs(symbols)
        self.begin = np.zeros(1 << levels, np.int64)
        self.begin[symbols[starts]] = starts

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each end."""
        at = end
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at - self.begin[symbol]


class FMIndex:
    """Index of segments of symbols; symbol 0 stands after each segment."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while step < SORTED:  # ranks by the first 2, 4, 8, ... symbols
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            pair = rank * (n + 2) + ahead
            self.order = np.argsort(pair, kind="stable")
            ordered = pair[self.order]
            rank[self.order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            step *= 2
        levels = max(1, int(text.max()).bit_length())
        self.before = np.searchsorted(np.sort(text), np.arange((1 << levels) + 1))  # smaller symbols in the text
        self.last = WaveletMatrix(text[self.order - 1], levels)

    def backward(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the occurrences of each run of ``length`` symbols that starts in the indexed text.

        Intervals of runs that occur more than once are places in ``order``.  A run
        whose end occurs once is not followed further and keeps that interval of
        length 1; runs that are equal so far take a step as one.
        """
        symbol = text[starts + length - 1]
        low, high = self.before[symbol], self.before[symbol + 1]
        for i in reversed(range(length - 1)):
            many = np.flatnonzero(high - low > 1)
            symbol = text[starts[many] + i]
            _, one, place = np.unique(low[many] * len(self.before) + symbol, return_index=True, return_inverse=True)
            symbol, one = symbol[one], many[one]
            low[many], high[many] = (
                (self.before[symbol] + self.last.rank(symbol, bound[one]))[place] for bound in (low, high)
            )
        return low, high


def search_block(doc: np.ndarray, n: np.ndarray, code: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For the segments of a shard: number of the segment and offset of every window that a smaller document has.

    ``code`` is the number of a segment's words in ``contents``; equal segments are
    indexed and searched once, for the smallest of their documents.
    """
    first_doc, windows = np.full(len(contents), np.iinfo(np.int64).max), np.zeros(len(contents), np.int64)
    np.minimum.at(first_doc, code, doc)
    windows[code] = n
    raw = np.frombuffer(b"".join(contents), np.uint8).reshape(-1, SYMBOL_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :SYMBOL_BYTES] = raw
    _, symbols = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    lengths = windows + WINDOW - 1
    owner = np.repeat(np.arange(len(contents)), lengths)
    text = np.zeros(len(symbols) + len(contents), np.int64)
    places = np.arange(len(symbols)) + owner  # one sign after each segment before
    text[places] = symbols + 1
    index = FMIndex(text)
    owners = np.full(len(text) + 1, np.iinfo(np.int64).max)
    owners[places] = first_doc[owner]
    begin = np.cumsum(windows) - windows
    within = np.repeat(np.arange(len(contents)), windows)
    starts = (np.cumsum(lengths + 1) - lengths - 1 - begin)[within] + np.arange(len(within))
    smallest = first_doc[within]  # of windows that only one segment has
    low, high = index.backward(text, starts, WINDOW)
    runs = np.flatnonzero(high - low > 1)
    if len(runs):
        # intervals of one length are equal or apart
        first, place = np.unique(low[runs], return_inverse=True)
        ends = np.zeros(len(first), np.int64)
        ends[place] = high[runs]
        ordered = np.r_[owners[index.order], owners[-1]]
        smallest[runs] = np.minimum.reduceat(ordered, np.stack([first, ends], axis=1).ravel())[::2][place]
    segment = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    repeated = smallest[begin[code[segment]] + offset] < doc[segment]
    return segment[repeated], offset[repeated]


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Columns doc, h, start, end: words of a text covered by windows that a smaller document has."""

    def search(table: pa.Table) -> pa.RecordBatch:
        doc, h, at, n = (table.column(k).to_numpy() for k in ("doc", "h", "at", "n"))
        open_ = table.column("words").is_valid().to_numpy()
        spans = [np.stack([doc[~open_], h[~open_], at[~open_], at[~open_] + n[~open_] + WINDOW - 1])]
        if open_.any():
            words = table.column("words").drop_null().combine_chunks().dictionary_encode()
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            code = words.indices.to_numpy().astype(np.int64)
            segment, offset = search_block(doc[open_], n[open_], code, words.dictionary.to_pylist())
            # consecutive windows make one span
            cut = np.flatnonzero(np.r_[True, (np.diff(segment) != 0) | (np.diff(offset) != 1)]) if len(segment) else segment
            last = np.r_[cut[1:], len(segment)] - 1 if len(segment) else segment
            base = at[open_][segment]
            own = segment[cut]
            spans.append(np.stack([doc[open_][own], h[open_][own], (base + offset)[cut], (base + offset)[last] + WINDOW]))
        found = np.concatenate(spans, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["doc", "h", "start", "end"])

    def symbols(rows: pa.RecordBatch | pa.Table) -> int:
        return (pc.sum(pc.binary_length(rows.column("words"))).as_py() or 0) // SYMBOL_BYTES

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += symbols(batch)
            if size >= INDEX_SYMBOLS:
                table = pa.Table.from_batches(held)
                keys = table.column("anchor").to_numpy()
                end = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
                if end:
                    yield search(table.slice(0, end))
                rest = table.slice(end).combine_chunks()
                held, size = rest.to_batches(), symbols(rest)
        if held:
            yield search(pa.Table.from_batches(held))

    sorted_rows = rows.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_rows.mapInArrow(kernel, "doc long, h long, start long, end long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept (words joined by a space), kept_sha256; one row per row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            total, gone, kept = [], [], []
            for packed, spans in zip(batch.column("packed"), batch.column("spans").to_pylist()):
                words = unpack(packed.as_py()).split()
                total.append(len(words))
                if not spans:
                    gone.append(0)
                    kept.append(b" ".join(words))
                    continue
                change = np.zeros(len(words) + 1, np.int64)
                for span in spans:
                    change[span["start"]] += 1
                    change[span["end"]] -= 1
                stays = np.cumsum(change[:-1]) == 0
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(compress(words, stays.tolist())))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            columns = [batch.column("doc"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    anchors = materialize(shared_anchors(docs), "shared-anchors")
    spans = repeated_spans(segment_rows(docs, anchors, busy_anchors(anchors, ANCHOR_SEGMENTS)))
    spans = spans.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = packed_texts(docs).join(spans, ["doc", "h"], "left")
    return joined.mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
