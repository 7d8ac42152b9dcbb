"""Exact top-k by inner product with an impact-ordered index, score at a time.

Vectors are cut into shards, queries into blocks; every block meets every shard.
A shard turns each dimension into two lists of impacts that are not negative (how
far a component lies above the shard's smallest, and below its largest), for
positive and negative query weights, so every posting adds to a score.  An impact is
the sum of its binary digits, and the postings with one digit are a segment;
segments are processed from the highest digit, for all queries of a block at once,
and after each one every vector has a lower bound and an upper one, which is what all
lower digits together could add.  Processing stops when the bounds prove all but a
few vectors out of reach, or at the last digit, when the bounds are the scores; the
possible members are scored exactly.  No shard and no member is left out by any
other rule.

Defined cases: rows whose id is NULL, whose vector is NULL, or that hold a NULL or
non-finite component take no part; equal rows count once; rows with the query's
id are its own and no candidates; vectors are compared with those of the same
length; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.session import materialize

SHARD = 8192  # vectors of a shard, about
BLOCK = 4096  # queries of a block, about
BATCH = 256  # queries scored at once
ENOUGH = 16  # possible members for each wanted one at which exact scores are cheaper


def integer_components(vector: Column) -> Column:
    """floor(256 * x) of every component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def _number_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The fastest type in which all sums are exact."""
    most = float(np.abs(queries).sum(axis=1, dtype=np.float64).max(initial=0)) * 2 * (float(np.ptp(vectors)) if vectors.size else 0)
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64


class ImpactIndex:
    """Postings of one shard by the binary digits of their impacts."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        low, high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        impacts = np.concatenate([self.vectors - low, high - self.vectors], axis=1)
        self.impacts = impacts
        self.digits = int(impacts.max(initial=0)).bit_length()

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Mask of vectors that may be among the k best of each query; never leaves out one that is."""
        kind = _number_type(queries, self.vectors)
        weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).astype(kind)
        total = weights.sum(axis=1, keepdims=True)
        floor = np.zeros((len(queries), len(self.ids)), kind)
        barred = own[:, None] == self.ids[None]
        mask = ~barred
        if len(self.ids) <= k:
            return mask
        for digit in reversed(range(self.digits)):
            segment = (self.impacts >> digit & 1).astype(kind)
            floor += (weights @ segment.T) * kind(1 << digit)
            sure = np.where(barred, kind(-1), floor)
            kth = np.partition(sure, len(self.ids) - k, axis=1)[:, len(self.ids) - k, None]
            mask = (floor + total * kind((1 << digit) - 1) >= kth) & ~barred
            if mask.sum() <= ENOUGH * k * len(queries):
                break
        return mask

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and exact score of the k best vectors of each query."""
        query, member = np.nonzero(self.possible(queries, own, k))
        score = np.zeros(len(query), np.int64)
        for i in range(0, len(query), 65536):
            part = slice(i, i + 65536)
            score[part] = np.einsum("ij,ij->i", queries[query[part]], self.vectors[member[part]])
        order = np.lexsort((self.ids[member], -score, query))
        query, member, score = query[order], member[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        return tuple(x[place < k] for x in (query, self.ids[member], score))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(table), -1)


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k best candidates of each query.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.  Every
    vector is copied to each block of queries and every query to each shard.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long"), integer_components(F.col("embedding")).alias("v")).distinct()
    rows = materialize(rows.withColumn("d", F.size("v")), "vectors")
    queries = rows.where(is_query)
    shards, blocks = max(1, -(-rows.count() // SHARD)), max(1, -(-queries.count() // BLOCK))
    hashed = F.xxhash64("vec_id", "v")

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    index = rows.select("d", F.pmod(hashed, shards).cast("int").alias("shard"), spread(blocks).alias("block"), "vec_id", "v")
    asked = queries.select("d", spread(shards).alias("shard"), F.pmod(hashed, blocks).cast("int").alias("block"), "vec_id", "v", hashed.alias("query"))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            own = right.column("vec_id").to_numpy()
            vectors_, weights = _matrix(left, "v"), _matrix(right, "v")
            shard = ImpactIndex(left.column("vec_id").to_numpy(), vectors_)
            keys = right.column("query").to_numpy()
            for i in range(0, len(own), BATCH):
                q, ids, score = shard.search(weights[i : i + BATCH], own[i : i + BATCH], k)
                parts.append(np.stack([own[i + q], keys[i + q], ids, score]))
        found = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
        return pa.table([pa.array(x) for x in found], names=["query_id", "query", "vec_id", "score"])

    keys = ["d", "shard", "block"]
    best = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        kernel, "query_id long, query long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
