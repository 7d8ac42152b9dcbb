"""Splitting a long axis into bounded chunks.

A hot group (one block over the whole stack, one pixel column over a million
sections) is never handed to one task whole: rows are keyed by a chunk of the
axis, and a halo of neighbouring rows is copied where an operator looks sideways.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 4096
SMALL = 1_000_000  # rows of a few numbers that every executor may hold
TASK_ROWS = 500_000  # pixels that a task sorts, pairs or adds up


def checked_broadcast(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of at most ``rows`` narrow rows if that is few enough; else the planner joins it."""
    return F.broadcast(small) if rows <= SMALL else small


def enough_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions that leave ``TASK_ROWS`` rows to each; never fewer than the session's own number.

    The session's number does not follow the data, so a task's memory would.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows hashed by ``keys``, into the session's number of partitions if none is given."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def with_halo(
    df: DataFrame, step: int, before: int = 0, after: int = 0, axis: str = "z", chunk: str = "chunk"
) -> DataFrame:
    """Copy each row to every chunk that needs it.

    Chunk q owns ``[q*step, (q+1)*step)`` and also reads ``before`` positions
    below and ``after`` above.  Axis values are non-negative.
    """
    ids = F.expr(f"sequence(greatest({axis} - {after}, 0L) div {step}, ({axis} + {before}) div {step})")
    if before == 0 and after == 0:
        return df.withColumn(chunk, F.expr(f"{axis} div {step}"))
    return df.withColumn(chunk, F.explode(ids))


def owned(step: int, axis: str = "z", chunk: str = "chunk") -> Column:
    """True for rows in the chunk's own range, false for halo copies."""
    return F.expr(f"{axis} div {step} = {chunk}")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, step: int = CHUNK
) -> DataFrame:
    """Inclusive running maximum of ``value`` along ``order`` within ``keys``.

    Two levels: chunk maxima are scanned first (one row per chunk), then each
    chunk is scanned on its own with the carry of the chunks before it.  The small
    carry table is hashed by chunk again, so that the join does not gather a whole
    group of the large side where the carry was scanned.
    """
    keys = list(keys)
    marked = df.withColumn("_chunk", F.expr(f"{order} div {step}"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        marked.groupBy(*keys, "_chunk")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_chunk", F.max("_top").over(before).alias("_carry"))
        .repartition(*keys, "_chunk")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.join(carry, [*keys, "_chunk"])
        .withColumn(out, F.greatest(F.max(value).over(inside), F.col("_carry")))
        .drop("_chunk", "_carry")
    )


def row_rank(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, step: int = CHUNK
) -> DataFrame:
    """0-based rank of ``value`` (then ``tie``) within ``keys``, in two levels.

    Approximate quantiles cut a group's values into buckets of about ``step`` rows.  Rows
    whose value is a cut have buckets of their own, which the tie cuts further: they share
    one value, so the tie alone orders them, and no bucket grows with the rows of a value.
    """
    keys = list(keys)
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // step)
    marked = df.withColumns({"_cut": F.lit(0), "_sub": F.lit(0).cast("bigint")})
    if parts > 1:
        share = F.array(*(F.lit(i / parts) for i in range(1, parts)))
        cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, share, F.lit(max(10000, 8 * parts)))).alias("_cuts"))
        # binary-search free: cuts are in order, so the count below a value is its place
        below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
        on = F.array_contains("_cuts", F.col(value))
        marked = df.join(cuts, keys).withColumn("_cut", 2 * below + F.when(on, 1).otherwise(0))
        marked = marked.withColumn("_sub", F.when(on, F.expr(f"{tie} div {step}")).otherwise(F.lit(0))).drop("_cuts")
    bucket = ["_cut", "_sub"]
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        marked.groupBy(*keys, *bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        .repartition(*keys, *bucket)
    )
    inside = Window.partitionBy(*keys, *bucket).orderBy(value, tie)
    return (
        marked.join(base, [*keys, *bucket])
        .withColumn(out, F.row_number().over(inside) - 1 + F.col("_base"))
        .drop(*bucket, "_base")
    )
