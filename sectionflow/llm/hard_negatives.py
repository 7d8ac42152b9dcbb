"""Hard negatives: for an anchor and a positive, the best rows of another label in a window of scores.

Scores are integer inner products.  Anchors are cut into blocks, all rows into shards,
and every block meets every shard.  A block and a shard meet in tiles; a tile is one
matrix product by Strassen's recursion over int64 (seven products of halves for eight,
halves padded with zeros), whose additions are integer additions and so exact.

What leaves a tile is merged into heaps of fixed size: one of the best positives of each
anchor, then, when the positives of all shards are known, one for the window of scores of
each anchor and positive.  Heaps merge in any order, first those of a task's tiles and
then those of the shards, so nothing grows with the number of rows but the tiles.

Defined cases: rows whose id, label or vector is NULL, or whose vector holds a NULL or
non-finite component, take no part; equal rows count once; rows with the anchor's id are
its own and neither positives nor negatives; rows of one id with different vectors or
labels are anchors each; vectors are compared with those of the same length; ties go to
the smaller id; an anchor without a positive, and a pair without a negative in its
window, give no row; other columns are not read; an empty table gives an empty result.
Scores must stay below 2 ** 62.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.session import materialize

SHARD = 8192  # rows of a shard, about
BLOCK = 4096  # anchors of a block, about
TILE = 512, 4096  # anchors and candidates multiplied at once
LEAF = 32  # side at which Strassen's recursion ends
LOWEST = np.iinfo(np.int64).min  # an empty place of a heap

KEYS = ["d", "shard", "block"]


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain product; in doubles where all sums are below 2 ** 53 and therefore exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for int64 matrices of any shape."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _leaf(a, b)
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    (i, j), l = (s // 2 for s in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    both = strassen(a11 + a22, b11 + b22)
    low_a = strassen(a21 + a22, b11)
    right_b = strassen(a11, b12 - b22)
    low_b = strassen(a22, b21 - b11)
    top_a = strassen(a11 + a12, b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = both + low_b - top_a + strassen(a12 - a22, b21 + b22)
    out[:i, l:] = right_b + top_a
    out[i:, :l] = low_a + low_b
    out[i:, l:] = both - low_a + right_b + strassen(a21 - a11, b11 + b12)
    return out[:m, :n]


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` rows: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), LOWEST)
        self.ids = np.zeros((n, k), np.int64)

    def merge(self, at: slice | np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take other heaps into those of the rows ``at``."""
        scores, ids = np.concatenate([self.scores[at], scores], axis=1), np.concatenate([self.ids[at], ids], axis=1)
        order = np.lexsort((ids, ~scores))[:, : self.scores.shape[1]]
        self.scores[at], self.ids[at] = (np.take_along_axis(x, order, axis=1) for x in (scores, ids))

    def push(self, at: slice | np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take the allowed cells of a tile, whose columns are in order of their ids, into the heaps of its rows ``at``."""
        left, rows = np.where(allowed, scores, LOWEST), np.arange(len(scores))
        found = np.zeros((2, len(scores), min(self.scores.shape[1], len(ids))), np.int64)
        for place in range(found.shape[2]):
            best = left.argmax(axis=1)  # the first of the highest has the smallest id
            found[0, :, place], found[1, :, place] = left[rows, best], ids[best]
            left[rows, best] = LOWEST
        self.merge(at, *found)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, id and score of what the heaps hold."""
        row, place = np.nonzero(self.scores != LOWEST)
        return row, self.ids[row, place], self.scores[row, place]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), -1)


def _tiles(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tile: its anchors, the ids of its candidates, scores, which labels agree, which rows are not the anchor's."""
    order = np.argsort(rows.column("vec_id").to_numpy(), kind="stable")
    ids, labels = (rows.column(c).to_numpy()[order] for c in ("vec_id", "label"))
    across = _matrix(rows.column("v"))[order].T
    own, own_labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
    down = _matrix(anchors.column("v"))
    for i in range(0, len(own), TILE[0]):
        part = slice(i, i + TILE[0])
        for j in range(0, len(ids), TILE[1]):
            near = slice(j, j + TILE[1])
            yield (
                part,
                ids[near],
                strassen(down[part], across[:, near]),
                own_labels[part, None] == labels[None, near],
                own[part, None] != ids[None, near],
            )


def _met(rows: DataFrame, anchors: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel`` over every shard of rows and block of anchors that hold vectors of one length."""
    shards, blocks = (max(1, -(-t.count() // n)) for t, n in ((rows, SHARD), (anchors, BLOCK)))

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v", "label"), F.lit(n)).cast("int")

    left = rows.select("*", part(shards).alias("shard"), spread(blocks).alias("block"))
    right = anchors.select("*", spread(shards).alias("shard"), part(blocks).alias("block"))
    empty = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")]).empty_table()

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        return kernel(one, two) if len(one) and len(two) else empty

    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all shards merged: the ``k`` first rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def labelled_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """Columns vec_id, label, v (floor(scale * x) of every component), d (their number); the rows that take part, once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v")).distinct()
    return rows.withColumn("d", F.size("v"))


def best_positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """Columns anchor, anchor_id, rank, vec_id, score: the ``k`` best other rows of each anchor's label."""

    def kernel(shard: pa.Table, block: pa.Table) -> pa.Table:
        heaps = Heaps(len(block), k)
        for part, ids, scores, same, other in _tiles(shard, block):
            heaps.push(part, scores, ids, same & other)
        row, ids, scores = heaps.rows()
        keys = [block.column(c).to_numpy()[row] for c in ("anchor", "vec_id")]
        return pa.table([pa.array(x) for x in (*keys, ids, scores)], names=["anchor", "anchor_id", "vec_id", "score"])

    found = _met(rows, anchors, kernel, "anchor long, anchor_id long, vec_id long, score long")
    return _first(found, ["anchor", "anchor_id"], k)


def window_negatives(rows: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Columns anchor, anchor_id, place, rank, vec_id, score: for each positive score of an anchor (by its place in
    the array ``positives``) the ``k`` best rows of other labels with low * positive <= 100 * score <= high * positive."""

    def kernel(shard: pa.Table, block: pa.Table) -> pa.Table:
        sizes = block.column("positives").combine_chunks().value_lengths().to_numpy()
        wanted = block.column("positives").combine_chunks().flatten().to_numpy()
        begins = np.cumsum(sizes) - sizes
        heaps = Heaps(len(wanted), k)
        for part, ids, scores, same, other in _tiles(shard, block):
            apart = ~same & other
            for place in range(int(sizes[part].max(initial=0))):
                own = np.flatnonzero(sizes[part] > place)
                at = begins[part][own] + place
                least, most = -(-low * wanted[at] // 100), high * wanted[at] // 100
                inside = scores[own]
                allowed = apart[own] & (inside >= least[:, None]) & (inside <= most[:, None])
                heaps.push(at, inside, ids, allowed)
        pair, ids, scores = heaps.rows()
        row = np.repeat(np.arange(len(block)), sizes)[pair]
        keys = [block.column(c).to_numpy()[row] for c in ("anchor", "vec_id")]
        columns = [*keys, pair - begins[row], ids, scores]
        return pa.table([pa.array(x) for x in columns], names=["anchor", "anchor_id", "place", "vec_id", "score"])

    found = _met(rows, anchors, kernel, "anchor long, anchor_id long, place long, vec_id long, score long")
    return _first(found, ["anchor", "anchor_id", "place"], k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id;
    the window of negatives is given in hundredths of the positive's score.
    """
    rows = materialize(labelled_vectors(vectors), "vectors")
    anchors = rows.where(is_anchor).withColumn("anchor", F.xxhash64("v", "label"))
    best = materialize(best_positives(rows, anchors, positives), "positives")
    keys = ["anchor", "anchor_id"]
    scores = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    scores = scores.select("anchor", F.col("anchor_id").alias("vec_id"), F.col("p.score").alias("positives"))
    asked = materialize(anchors.join(scores, ["anchor", "vec_id"]), "anchors")
    found = window_negatives(rows, asked, negatives, low, high)
    taken = best.select(
        *keys, (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    joined = found.join(taken, [*keys, "place"])
    return joined.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
