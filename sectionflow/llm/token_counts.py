"""Token counts by byte-pair merging with a heap and a linked list.

The merges of a published byte-level vocabulary are applied to every piece of a
text: the adjacent pair of lowest rank is popped from a heap until none is left.
A piece has as many tokens as it has bytes, less the merges made; identifiers
are never looked up.

Defined cases: NULL and empty texts have 0 tokens and 0 bytes; strings of added
tokens inside a text count one token each, as the vocabulary's library does by
default; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sectionflow.llm.common import ship

# Fixed value: how byte-level vocabularies of this family cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same for texts of ASCII and the Latin letters up to U+017F only, for the faster standard module.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTER}]*")
_PLAIN_PIECES = re.compile(
    PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r {_LETTER}0-9]")
    .replace(r"\p{L}", f"[{_LETTER}]")
    .replace(r"\p{N}", "[0-9]")
    .replace(r"\s", r"[\t-\r ]")
    .replace(r"\S", r"[^\t-\r ]")
)

MEMO_PIECES = 1_000_000  # pieces remembered by a worker
MEMO_CHARS = 64  # longer pieces are not remembered


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges(NamedTuple):
    """For each symbol the ranks of the pairs that it starts, by the second symbol; the symbol each rank makes.

    Bytes are the symbols 0 to 255; ``added`` are the strings of added tokens.
    """

    ranks: list[dict[int, int]]
    made: list[int]
    added: list[str]


def read_merges(path: str) -> Merges:
    """Merges of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError("only byte-level vocabularies without a normalizer or prefix space are read")
    numbers = {letter: byte for byte, letter in byte_letters().items()}
    pairs, made = [], []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made.append(numbers.setdefault(left + right, len(numbers)))
        pairs.append((numbers[left], numbers[right], rank))
    ranks: list[dict[int, int]] = [{} for _ in numbers]
    for left, right, rank in pairs:
        ranks[left][right] = rank
    return Merges(ranks, made, [t["content"] for t in spec["added_tokens"]])


def merged_length(symbols: list[int], rank: list[Callable[[int], int | None]], made: list[int]) -> int:
    """Symbols left after all merges: lowest rank first, leftmost first among equals.

    ``rank[a](b)`` is the rank of a pair.  A heap entry is rank * n + place.
    """
    left = n = len(symbols)
    heap = [r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank[a](b)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    while heap:
        entry = pop(heap)
        r = entry // n
        i = entry - r * n
        j = after[i]
        if j >= n or (a := symbols[i]) < 0 or rank[a](symbols[j]) != r:
            continue  # one of the two has been merged since
        a = symbols[i] = made[r]
        symbols[j] = -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank[a](symbols[k])) is not None:
                push(heap, r * n + i)
        if (h := before[i]) >= 0 and (r := rank[symbols[h]](a)) is not None:
            push(heap, r * n + h)
    return left


class PieceLengths(dict):
    """Tokens of a piece, computed at first sight and remembered within bounds."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.rank, self.made = [d.get for d in merges.ranks], merges.made

    def __missing__(self, piece: str) -> int:
        n = merged_length([*piece.encode()], self.rank, self.made)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts for one vocabulary.

    Held in a broadcast value it lives as long as the worker process, so that tasks
    that run one after the other share the pieces seen.
    """

    def __init__(self, merges: Merges):
        self.merges, self.lengths = merges, PieceLengths(merges)
        added = sorted(merges.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pieces = regex.compile(PIECES)

    def __reduce__(self):
        return Counter, (self.merges,)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.added.split(text) if self.added else [text]
        length = self.lengths.__getitem__
        pieces = (_PLAIN_PIECES if _PLAIN.fullmatch(text) else self.pieces).findall
        return len(parts) - 1 + sum(sum(map(length, pieces(p))) for p in parts)


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Column with the number of tokens; the vocabulary file is read once, on the driver.

    What is broadcast is the merges of one vocabulary file, whose size does not
    depend on the data.
    """
    shared = ship(spark, Counter(read_merges(vocabulary)))

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = shared()
        for batch in batches:
            yield batch.map(counter).astype("int64")

    return count(text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text has more than ``limit`` tokens; one row per row."""
    whole = F.coalesce("text", F.lit(""))
    counted = docs.select(
        "doc_id",
        F.octet_length(whole).cast("long").alias("n_bytes"),
        token_count(docs.sparkSession, whole, vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
