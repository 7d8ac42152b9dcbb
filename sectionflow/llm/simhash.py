"""Near-duplicate documents: SimHash fingerprints linked by vantage-point partitions.

Two fingerprints are linked when they differ in at most ``radius`` bits.  A
vantage point splits fingerprints by their Hamming distance to it; by the
triangle inequality a pair within the radius has distances that differ by no
more than it, so after a split only the rows near the boundary meet those of the
other side.

On whole 64-bit fingerprints of unlike texts, which are close to uniform, a
distance of 4 cannot be told from the spread of the distances themselves, and a
vantage point would send two thirds of all rows both ways.  The first level
therefore measures the distance in disjoint blocks of bits: of ``radius + 2``
blocks at least two have distance 0 for any linked pair, so a shard holds the
fingerprints at distance 0 from one vantage value in two blocks, and the tree
inside a shard splits by the distance of whole fingerprints.

Defined cases: a text without words (NULL, empty, only white space) has
fingerprint 0 and is linked like any other; a NULL doc_id has a fingerprint but
never names a component unless no other member has an id (then NULL); repeated
rows give repeated results; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.llm.components import connected_components
from sectionflow.session import materialize

SEED = 42
BITS = 64
SMALL_SHARD = 16  # shards up to this size are compared row by row
LEAF = 64  # fingerprints in a leaf of the tree
CHUNK = 2048  # rows of a block of distances held at once


def text_fingerprint(text: bytes | None, size: int) -> int:
    """Majority bits of the hashes of all runs of ``size`` words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(run), SEED) for run in runs), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """Columns doc_id, row (hash of id and text), fp (the 64 bits as a signed long); one row per row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (text_fingerprint(x.as_py(), size) for x in batch.column("text")), np.uint64, batch.num_rows
            )
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row"), F.col("text").cast("binary"))
    return rows.mapInArrow(kernel, "doc_id long, row long, fp long")


def row_hash() -> Column:
    """Hash of id and text, which stands for a document."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def block_cells(fp: Column, radius: int) -> Column:
    """Array of the shards of a fingerprint: one for each two of ``radius + 2`` blocks of bits."""
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    part = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    return F.array(
        *(
            F.shiftleft(F.lit(i).cast("long"), 2 * width).bitwiseOR(F.shiftleft(part[a], width)).bitwiseOR(part[b])
            for i, (a, b) in enumerate(combinations(range(blocks), 2))
        )
    )


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two arrays within the radius, in bounded blocks."""
    for i in range(0, len(a), CHUNK):
        for j in range(0, len(b), CHUNK):
            x, y = np.nonzero(np.bitwise_count(a[i : i + CHUNK, None] ^ b[None, j : j + CHUNK]) <= radius)
            if len(x):
                yield x + i, y + j


class Labels:
    """Smallest connected index of each point of a shard."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.of[x], self.of[y]
            open_ = a != b
            if not open_.any():
                return
            low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(self.of, high, low)
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up


def link_shard(points: np.ndarray, radius: int) -> np.ndarray:
    """Label of every point of one shard by a vantage-point tree over it."""
    labels, todo = Labels(len(points)), [np.arange(len(points))]
    while todo:
        ids = todo.pop()
        own = points[ids]
        if len(ids) > LEAF:
            far = np.bitwise_count(own ^ own[0]).astype(np.int64)
            if far.max() <= radius // 2:  # all are within the radius of each other
                labels.link(ids, np.full(len(ids), ids[0]))
                continue
            cut = int(np.median(far))
            inner, outer = far <= cut, far > cut
            if inner.any() and outer.any():
                todo += [ids[inner], ids[outer]]
                a, b = ids[inner & (far > cut - radius)], ids[outer & (far <= cut + radius)]
                for x, y in near_pairs(points[a], points[b], radius):
                    labels.link(a[x], b[y])
                continue
        for x, y in near_pairs(own, own, radius):
            labels.link(ids[x], ids[y])
    return labels.of


def shard_links(cells: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected inside each shard; rows come sorted by shard."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(cells)])
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat(sizes <= SMALL_SHARD, sizes)
    for step in range(1, min(SMALL_SHARD, len(cells))):
        same = (cells[step:] == cells[:-step]) & small[step:]
        near = np.flatnonzero(same & (np.bitwise_count(points[step:] ^ points[:-step]) <= radius))
        a.append(points[near + step])
        b.append(points[near])
    for k in np.flatnonzero(sizes > SMALL_SHARD):
        own = points[starts[k] : starts[k] + sizes[k]]
        label = link_shard(own, radius)
        moved = np.flatnonzero(label != np.arange(len(own)))
        a.append(own[moved])
        b.append(own[label[moved]])
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Columns a, b: links among distinct fingerprints ``fp`` that keep every component together."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 2), np.int64)
        for rows, last in _last_marked(batches):
            rows = np.concatenate([kept, rows])
            # the last shard may go on in the next batch
            end = len(rows) if last else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            a, b = shard_links(rows[:end, 0], rows[:end, 1].astype(np.uint64), radius)
            kept = rows[end:]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    cells = distinct.select(F.explode(block_cells(F.col("fp"), radius)).alias("cell"), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(kernel, "a long, b long")


def _last_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bool]]:
    """Batches as arrays of (cell, fp), the last one marked."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if before is not None:
            yield before, False
        before = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1)
    if before is not None:
        yield before, True


def components(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """Columns doc_id, row, fp, root (smallest linked fingerprint), component_id; one row per row."""
    rows = materialize(fingerprints(docs, size), "fingerprints")
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(named.select("fp"), radius), "fingerprint-links")
    linked = named.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(linked.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id; one row per row of ``docs``."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return components(docs, size, radius).select("doc_id", digits, "component_id")


def one_of_each_group(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """The row with the smallest doc_id of each component, unchanged; a row without id only if all have none."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = components(docs, size, radius).groupBy("root").agg(first)
    return named_rows(docs, kept.select("first.row"))


def named_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, each once, whose hash is in ``kept(row)``."""
    kept = materialize(kept.select(F.col("row").alias("simhash_row")), "group-firsts")
    rows = docs.withColumn("simhash_row", row_hash()).join(kept, "simhash_row", "left_semi")
    # equal rows are one group; they come together by the join already
    number = F.row_number().over(Window.partitionBy("simhash_row").orderBy("simhash_row"))
    return rows.withColumn("simhash_no", number).where("simhash_no = 1").select(*docs.columns)
