"""Section stacks in Parquet: load, mask, channels, write, report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.functions.stats import present

KEYS = ("z", "x", "y")
FOLDERS = 1000  # of a stack, unless the caller says how many sections a folder holds
FOLDER_PIXELS = 1 << 17  # in a folder of small sections


def as_pixels(df: DataFrame, value: str = "v") -> DataFrame:
    """Bring a table to ``pixels(z, x, y, v)`` types with NaN turned into NULL."""
    return df.select(
        *(F.col(k).cast("bigint").alias(k) for k in KEYS), present(F.col(value).cast("double")).alias("v")
    )


def load_sections(
    spark: SparkSession, path: str, start: int | None = None, stop: int | None = None, keep_path: bool = False
) -> DataFrame:
    """Sections ``start <= z < stop`` of a stack, renumbered from 0.

    The range reaches the scan as a filter (a partition filter when the stack was
    written by ``write_sections``).  ``keep_path`` adds the source file of each row.
    """
    raw = spark.read.parquet(path)
    grouped = {"z_from", "z_to"} <= set(raw.columns)
    if start is not None:
        raw = raw.where(F.col("z") >= start)
        raw = raw.where(F.col("z_to") > start) if grouped else raw
    if stop is not None:
        raw = raw.where(F.col("z") < stop)
        raw = raw.where(F.col("z_from") < stop) if grouped else raw
    source = [F.col("_metadata.file_path").alias("path")] if keep_path else []
    number = F.col("z").cast("bigint") - F.lit(start or 0)
    return raw.select(
        number.alias("z"),
        *(F.col(k).cast("bigint").alias(k) for k in ("x", "y")),
        present(F.col("v").cast("double")).alias("v"),
        *source,
    )


def section_order(pixels: DataFrame, partitions: int | None = None) -> DataFrame:
    """Partitions that are contiguous in z (then in pixel position)."""
    cols = [F.col(k) for k in KEYS]
    return pixels.repartitionByRange(partitions, *cols) if partitions else pixels.repartitionByRange(*cols)


def unpack_pixels(packed: DataFrame, width: int, pixels: str = "px") -> DataFrame:
    """Row-major arrays (one per z) to one row per pixel."""
    return packed.select("z", F.posexplode(pixels).alias("_i", "_v")).select(
        F.col("z").cast("bigint").alias("z"),
        F.expr(f"cast(_i % {width} as bigint)").alias("x"),
        F.expr(f"cast(_i div {width} as bigint)").alias("y"),
        present(F.col("_v").cast("double")).alias("v"),
    )


def linear_index(width: int) -> Column:
    """Row-major position of a pixel."""
    return F.col("y") * width + F.col("x")


def load_masked(pixels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Add ``weight`` from a mask table; no mask, or no mask row, means 1."""
    if mask is None:
        return pixels.withColumn("weight", F.lit(1.0))
    # A mask is small on disk for the rows it has, so the planner would take it for one to broadcast.
    weights = mask.select(*KEYS, F.col("v").cast("double").alias("weight")).hint("merge")
    return pixels.join(weights, list(KEYS), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def stack_channels(channels: Mapping[str, DataFrame]) -> DataFrame:
    """Several aligned stacks as one table with a ``channel`` column."""
    parts = [df.select(F.lit(name).alias("channel"), *KEYS, "v") for name, df in channels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pack_channels(stacked: DataFrame, names: list[str]) -> DataFrame:
    """One row per pixel with one column per channel, in the given order."""
    picks = [F.max(F.when(F.col("channel") == n, F.col("v"))).alias(n) for n in names]
    return stacked.groupBy(*KEYS).agg(*picks)


def write_sections(
    pixels: DataFrame,
    path: str,
    single: bool = False,
    per_folder: int | None = None,
    mode: str = "errorifexists",
    band: int | None = None,
) -> None:
    """Write a stack as one folder per section, or per run of sections, pixels sorted inside it.

    A range split on (z, y, x) spreads one oversized section over several tasks
    and leaves each task few open folders.  ``single`` narrows values to float.
    ``per_folder`` puts that many sections into a folder, for very many small ones; by
    default the least number that needs at most ``FOLDERS`` folders, as each folder costs
    a file and its entry in the driver, whatever it holds.
    With ``band`` that many pixel rows of a folder make a file and meet by hash; a
    range split samples its input first, so it computes a lazy stack twice, and so does
    looking up the range of z, which ``per_folder`` saves.
    """
    out = pixels.withColumn("v", F.col("v").cast("float")) if single else pixels
    if per_folder is None:
        low, high = pixels.agg(F.min("z"), F.max("z")).first()
        per_folder = 1 if low is None else sections_per_folder(high - low + 1)
    by_band = F.expr(f"z div {per_folder}"), F.expr(f"y div {band or 1}")
    dealt = out.repartition(*by_band) if band else out.repartitionByRange("z", "y", "x")
    ordered = dealt.sortWithinPartitions("z", "y", "x")
    if per_folder == 1:
        ordered.write.mode(mode).partitionBy("z").parquet(path)
        return
    first = F.expr(f"z div {per_folder} * {per_folder}")
    ordered = ordered.withColumns({"z_from": first, "z_to": first + per_folder})
    ordered.write.mode(mode).partitionBy("z_from", "z_to").parquet(path)


def sections_per_folder(sections: int, pixels: int | None = None) -> int:
    """The least number of sections to a folder that needs at most ``FOLDERS`` folders, wherever the first one begins.

    With the ``pixels`` of a section also the least that leaves ``FOLDER_PIXELS`` to a folder:
    writing and listing one costs the same whatever it holds.
    """
    least = 1 if sections <= FOLDERS else -(-sections // (FOLDERS - 1))
    return max(least, -(-FOLDER_PIXELS // pixels)) if pixels else least


def write_report(expected: DataFrame, written: DataFrame) -> DataFrame:
    """(z, pixels, ok) for every expected section, compared with what was read back."""
    want = expected.groupBy("z").agg(F.count(F.lit(1)).alias("expected"))
    have = written.groupBy(F.col("z").cast("bigint").alias("z")).agg(F.count(F.lit(1)).alias("pixels"))
    return want.join(have, "z", "left").select(
        "z",
        F.coalesce("pixels", F.lit(0)).cast("bigint").alias("pixels"),
        (F.coalesce("pixels", F.lit(0)) == F.col("expected")).alias("ok"),
    )


def full_report(written: DataFrame, sections: int, pixels: int) -> DataFrame:
    """(z, pixels, ok) for every section from 0, each of which should have the given number of pixels."""
    have = written.groupBy(F.col("z").cast("bigint").alias("z")).agg(F.count(F.lit(1)).alias("pixels"))
    every = written.sparkSession.range(sections).select(F.col("id").alias("z"))
    found = F.coalesce("pixels", F.lit(0)).cast("bigint")
    return every.join(have, "z", "left").select("z", found.alias("pixels"), (found == pixels).alias("ok"))


def extent(pixels: DataFrame) -> tuple[int, int, int]:
    """(sections, width, height): one row of maxima, read by the driver."""
    top = pixels.agg(*(F.max(k) for k in KEYS)).first()
    return tuple(0 if t is None else int(t) + 1 for t in top)
