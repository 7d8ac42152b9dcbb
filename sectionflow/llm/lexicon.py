"""Encoding and decoding by a byte-pair vocabulary with word ends, through a minimal acyclic transducer.

The words of all texts are counted and the most frequent ones compiled, with the ids that
the vocabulary's merges give them, into an automaton that shares prefixes and suffixes:
each arc carries a number, and the sum along a word's path is its place in a table of id
sequences.  Automaton and table are one file of sorted arrays; Spark brings it to every
executor, whose workers map it into memory and follow the arcs of all words of a batch
together.  Words that the automaton does not accept are merged exactly, lowest rank first,
so the lexicon never changes a result.

Defined cases: NULL and empty texts have no ids and decode to an empty text; strings of
special tokens inside a text are those tokens, as the vocabulary's library does by default;
white space is lost in decoding, which writes tokens separated by a space, word ends
included; repeated rows give repeated results; other columns are not read; an empty table
gives an empty result.  Letters and numbers are told as the installed ``regex`` and
``unicodedata`` do, which may differ from the library for characters that Unicode has added
in its latest versions.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.llm.common import ship
from sectionflow.llm.token_counts import byte_letters
from sectionflow.session import materialize, scratch_dir

WORDS = 100_000  # in the lexicon
WORD_BYTES = 64  # longer words are not in it
COUNTED_WORDS = 400_000  # different words a task holds before it hands their counts on
MEMO_WORDS = 100_000  # words outside the lexicon that a worker remembers
LONG_TEXT = 1 << 20  # characters; longer texts are cut at spaces, which no piece holds

# Fixed value: how vocabularies of this family cut a text into words.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The vocabulary file's own settings, which no other file may differ in.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRE_TOKENIZERS = ["Split", "ByteLevel"]

# The same for lower-case texts of ASCII and the Latin letters up to U+017F, for the faster standard module.
_LETTER = "a-zß-öø-ſ"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTER}]*")
_PLAIN_PIECES = re.compile(
    PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r {_LETTER}0-9]")
    .replace(r"[\p{L}]", f"[{_LETTER}]")
    .replace(r"[\p{N}]", "[0-9]")
)


class Vocabulary(NamedTuple):
    """Tokens by id, the ids of single bytes inside and at the end of a word, (rank, id made) of each pair of ids."""

    tokens: list[str]
    inside: list[int]
    last: list[int]
    pairs: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of this family; others are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"].get("end_of_word_suffix")
    kinds = []
    for name, steps in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        kinds.append([x["type"] for x in (spec[name] or {}).get(steps, [])])
    pattern = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex") if kinds[1] else None
    odd = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")]
    if kinds != [NORMALIZERS, PRE_TOKENIZERS] or pattern != PIECES or spec["decoder"] or not end or any(odd):
        raise ValueError("only vocabularies of words with an end mark, in lower case and without a decoder, are read")
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
    tokens = {i: t for t, i in (ids | special).items()}
    return Vocabulary(
        [tokens.get(i, "") for i in range(max(tokens) + 1)],
        [ids[letters[b]] for b in range(256)],
        [ids[letters[b] + end] for b in range(256)],
        pairs,
        special,
    )


def merged(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of a word: of all adjacent pairs the one of lowest rank, leftmost among equals, is merged until none is left."""
    ids = [vocabulary.inside[b] for b in word]
    if word:
        ids[-1] = vocabulary.last[word[-1]]
    find, n = vocabulary.pairs.get, len(ids)
    heap = [(*found, i) for i, pair in enumerate(zip(ids, ids[1:])) if (found := find(pair))]
    heapq.heapify(heap)
    following, preceding = [*range(1, n + 1)], [*range(-1, n - 1)]
    while heap:
        rank, made, i = heapq.heappop(heap)
        j = following[i]
        if ids[i] < 0 or j >= n or find((ids[i], ids[j])) != (rank, made):
            continue  # one of the two is part of another merge by now
        ids[i], ids[j], k = made, -1, following[j]
        following[i] = k
        if k < n:
            preceding[k] = i
            if found := find((made, ids[k])):
                heapq.heappush(heap, (*found, i))
        h = preceding[i]
        if h >= 0 and (found := find((ids[h], made))):
            heapq.heappush(heap, (*found, h))
    return [x for x in ids if x >= 0]


def cut(text: str | None) -> Iterator[str]:
    """The text in parts of bounded length, unless it has no space for long."""
    begin = 0
    while text and begin < len(text):
        end = text.find(" ", begin + LONG_TEXT)
        end = end if end >= 0 else len(text)
        yield text[begin:end]
        begin = end


class Splitter:
    """Cuts a text into the pieces that are merged, each by itself; special tokens stay whole."""

    def __init__(self, special: Iterable[str]):
        longest = sorted(special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pieces = regex.compile(PIECES)

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.special or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)  # every other one is a special token
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # letter by letter, so a capital sigma is the same everywhere in a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (_PLAIN_PIECES if _PLAIN.fullmatch(text) else self.pieces).findall(text)


def minimal_automaton(words: Iterable[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States (final, arcs as (byte, state)) of the smallest automaton that accepts the sorted words, and its start.

    The words are added in order; what follows the prefix shared with the next word is
    complete, and replaced by an equal state seen before if there is one.
    """
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}
    path: list[tuple[bool, list]] = [(False, [])]  # the states of the last word that may still change
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            number = known.setdefault(state, len(states))
            if number == len(states):
                states.append(state)
            path[-1][1].append((before[len(path) - 1], number))

    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
        close(shared)
        path += [(i == len(word), []) for i in range(shared + 1, len(word) + 1)]
        if not word:
            path[0] = (True, path[0][1])
        before = word
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    return states, len(states) - 1


def compiled(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of the words and their ids as one file.

    Arcs are sorted by state and byte; an arc's number is how many words its state
    accepts before those that take this arc, so numbers add up to a word's place.
    """
    words = sorted(entries)
    states, start = minimal_automaton(words)
    accepted = [0] * len(states)
    keys, targets, numbers = [], [], []
    for state, (final, arcs) in enumerate(states):  # arcs lead to earlier states
        passed = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(passed)
            passed += accepted[target]
        accepted[state] = passed
    finals = [final for final, _ in states]
    ends = np.cumsum([0, *(len(entries[w]) for w in words)])
    ids = [i for w in words for i in entries[w]]
    parts = [
        np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(numbers, "<i4"), np.array(finals, "u1"),
        ends.astype("<i4"), np.array(ids, "<u4"),
    ]
    head = struct.pack(f"<{len(parts) + 2}q", start, max(map(len, words), default=0), *map(len, parts))
    padded = (p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
    return head + b"".join(padded)


class Lexicon:
    """A compiled file, mapped into memory."""

    KINDS = ("<i8", "<i4", "<i4", "u1", "<i4", "<u4")

    def __init__(self, path: str):
        with open(path, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = struct.unpack_from(f"<{len(self.KINDS) + 2}q", held)
        self.start, self.longest, at = head[0], head[1], 8 * len(head)
        parts = []
        for kind, n in zip(self.KINDS, head[2:], strict=True):
            parts.append(np.frombuffer(held, kind, n, at))
            at += -(-parts[-1].nbytes // 8) * 8
        self.keys, self.targets, self.numbers, self.finals, self.ends, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table, -1 for those that the automaton does not accept."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum(sizes) - sizes
        state, place = np.full(len(words), self.start), np.zeros(len(words), np.int64)
        state[sizes > self.longest] = -1
        on = np.flatnonzero(sizes <= self.longest)
        for step in range(self.longest):
            on = on[sizes[on] > step]
            if not len(on) or not len(self.keys):
                break
            wanted = state[on] << 8 | letters[begins[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            met = self.keys[arc] == wanted
            state[on] = np.where(met, self.targets[arc], -1)
            place[on] += np.where(met, self.numbers[arc], 0)
            on = on[met]
        accepted = (state >= 0) & (self.finals[state] == 1) & ((sizes == 0) | (len(self.keys) > 0))
        return np.where(accepted, place, -1)

    def coded(self, places: np.ndarray) -> list[bytes]:
        """The ids of the words at these places, as bytes."""
        data = memoryview(self.ids).cast("B")
        ends = self.ends.astype(np.int64) * 4
        return [bytes(data[a:b]) for a, b in zip(ends[places].tolist(), ends[places + 1].tolist())]


class Coder:
    """Encodes and decodes texts; held in a broadcast value, it lives as long as the worker process."""

    def __init__(self, vocabulary: Vocabulary, file: str):
        self.vocabulary, self.file = vocabulary, file
        self.split, self.memo = Splitter(vocabulary.special), {}
        self.special = {t: struct.pack("<I", i) for t, i in vocabulary.special.items()}
        self.lexicon: Lexicon | None = None

    def __reduce__(self):
        return Coder, (self.vocabulary, self.file)

    def _merged(self, word: bytes) -> bytes:
        found = self.memo.get(word)
        if found is None:
            found = np.array(merged(word, self.vocabulary), "<u4").tobytes()
            if len(word) <= WORD_BYTES:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.lexicon is None:
            self.lexicon = Lexicon(SparkFiles.get(self.file))
        out = []
        for text in texts:
            if text and len(text) > LONG_TEXT:
                out.append(b"".join(x for part in cut(text) for x in self._coded([part])))
            else:
                out.append(text)
        short = iter(self._coded([x for x in out if not isinstance(x, bytes)]))
        return [x if isinstance(x, bytes) else next(short) for x in out]

    def _coded(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.split(text) for text in texts]
        known = dict.fromkeys(itertools.chain.from_iterable(pieces))
        words = [w.encode() for w in known]
        places = self.lexicon.places(words)
        stored = iter(self.lexicon.coded(places[places >= 0]))
        for piece, word, place in zip(known, words, places.tolist()):
            known[piece] = next(stored) if place >= 0 else self.special.get(piece) or self._merged(word)
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Columns word, n: the pieces of all texts up to ``WORD_BYTES`` bytes; special tokens are none."""
    special = vocabulary.special

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Splitter(special), Counter()

        def handed() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if w not in special and len(w.encode()) <= WORD_BYTES}
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})

        for batch in batches:
            for text in batch.column("text"):
                for part in cut(text.as_py()):
                    counts.update(split(part))
                    if len(counts) > COUNTED_WORDS:
                        yield handed()
        yield handed()

    counted = docs.select("text").mapInArrow(kernel, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = WORDS) -> str:
    """Name of the file with the ``words`` most frequent words (ties by word), which every executor can open.

    Words are counted over all texts and merged in tasks; the lexicon that the driver
    compiles is bounded by ``words`` words of ``WORD_BYTES`` bytes.
    """
    spark = docs.sparkSession
    shared = ship(spark, vocabulary)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [merged(w.as_py().encode(), shared()) for w in batch.column("word")]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    counts = materialize(word_counts(docs, vocabulary), "words")
    # counts in some hundred classes tell how often a word must occur, so that not all words are sorted
    classes = counts.groupBy(F.floor(8 * F.log2("n")).alias("class")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    left, least = words, 1
    for row in sorted(classes.collect(), reverse=True):
        least, left = row.least, left - row.words
        if left <= 0:
            break
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words).select("word")
    rows = top.mapInArrow(kernel, "word string, ids array<int>").collect()
    return publish(spark, compiled({r.word.encode(): r.ids for r in rows}), "lexicon")


def publish(spark: SparkSession, content: bytes, label: str) -> str:
    """Write a file to the shared scratch folder and have Spark bring it to every executor; returns its name there."""
    name = f"{label}-{uuid.uuid4().hex}"
    folder = f"{scratch_dir(spark)}/sectionflow/{spark.sparkContext.applicationId}/files"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(content)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def round_trip(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """Columns doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded (those ids as text again)."""
    vocabulary = read_vocabulary(path)
    shared = ship(docs.sparkSession, Coder(vocabulary, compile_lexicon(docs, vocabulary, words)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared()
        for batch in batches:
            ids = coder.encode(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(kernel, "doc_id long, ids binary, decoded string")


def encode(docs: DataFrame, path: str, words: int = WORDS) -> DataFrame:
    """Columns doc_id, ids of every text."""
    return round_trip(docs, path, words).select("doc_id", "ids")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Columns doc_id, decoded of rows with ids as ``encode`` gives them; NULL ids decode to an empty text."""
    tokens = ship(coded.sparkSession, read_vocabulary(path).tokens)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (np.frombuffer(x.as_py() or b"", "<u4").tolist() for x in batch.column("ids"))
            texts = pa.array([" ".join(map(tokens().__getitem__, ids)) for ids in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, decoded string")
