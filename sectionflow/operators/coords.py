"""Coordinate tables: start values, grid transfer, gate, status, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectionflow.functions.chunks import CHUNK, SMALL, checked_broadcast
from sectionflow.functions.grid import Grid
from sectionflow.functions.stats import weighted_mean
from sectionflow.operators.grid import block_grid, block_sections, grid_translate

BLOCK = ("bx", "by")
FAILED = 127


def init_coords(spark: SparkSession, sections: int) -> DataFrame:
    """lut with c(z) = z for the single block (0, 0)."""
    zero = F.lit(0).cast("bigint")
    return spark.range(sections).select(
        zero.alias("bx"), zero.alias("by"), F.col("id").alias("z"), F.col("id").cast("double").alias("c")
    )


def grid_mapping(spark: SparkSession, new: Grid, old: Grid) -> DataFrame:
    """map(bx, by, px, py): each new block's position in the old grid, a row a block."""
    return checked_broadcast(grid_translate(block_grid(spark, new), old).select("bx", "by", "px", "py"), new.size)


def join_blocks(rows: DataFrame, blocks: DataFrame, grid: Grid, sections: int, how: str, step: int = CHUNK) -> DataFrame:
    """Join (bx, by, z) rows, or pairs with z1, to a table with a row for each block of ``grid``.

    A table of few blocks goes to every executor.  A larger one is repeated for every z
    chunk, so that the rows of a block stay spread over its chunks.
    """
    if grid.size <= SMALL:
        return rows.join(F.broadcast(blocks), list(BLOCK), how)
    z = "z" if "z" in rows.columns else "z1"
    chunks = F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, sections - 1) // step).cast("bigint"))
    keyed = rows.withColumn("_chunk", F.expr(f"{z} div {step}"))
    return keyed.join(blocks.withColumn("_chunk", F.explode(chunks)), [*BLOCK, "_chunk"], how).drop("_chunk")


def interp_nearest(lut: DataFrame, mapping: DataFrame) -> DataFrame:
    """Take the old block nearest to each new one; off-grid blocks are dropped.

    Halves round up, also below zero.  A mapping of few blocks is broadcast (see
    ``grid_mapping``), so coordinates stay where they are.
    """
    nearest = mapping.select(
        "bx",
        "by",
        F.floor(F.col("px") + 0.5).cast("bigint").alias("obx"),
        F.floor(F.col("py") + 0.5).cast("bigint").alias("oby"),
    )
    old = lut.select(F.col("bx").alias("obx"), F.col("by").alias("oby"), "z", "c")
    return nearest.join(old, ["obx", "oby"]).select("bx", "by", "z", "c")


def interp_linear(lut: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bilinear transfer, weights renormalised over the blocks that exist.

    A corner with no coordinate but some weight makes the result missing.
    """
    corner = F.explode(
        F.array(
            *(
                F.struct(
                    (F.floor("px") + i).cast("bigint").alias("obx"), (F.floor("py") + j).cast("bigint").alias("oby")
                )
                for i in (-1, 0, 1)
                for j in (-1, 0, 1)
            )
        )
    )
    dx, dy = F.abs(F.col("px") - F.col("obx")), F.abs(F.col("py") - F.col("oby"))
    corners = (
        mapping.select("bx", "by", "px", "py", corner.alias("k"))
        .select("bx", "by", "px", "py", "k.*")
        .where((dx <= 1) & (dy <= 1))
        .withColumn("w", (1 - dx) * (1 - dy))
    )
    old = lut.select(F.col("bx").alias("obx"), F.col("by").alias("oby"), "z", "c")
    lost = F.max((F.col("c").isNull() & (F.col("w") > 0)).cast("int"))
    return (
        corners.join(old, ["obx", "oby"])
        .groupBy("bx", "by", "z")
        .agg(F.when(lost == 0, weighted_mean(F.col("c"), F.col("w"))).alias("c"))
    )


def quality_gate(sim: DataFrame, grid: Grid, sections: int, reach: int) -> DataFrame:
    """(bx, by, ok): every in-band pair has a similarity other than 0.

    Counting good pairs against the number a full band holds finds absent rows too.
    """
    r = min(reach, sections - 1)
    full = sum(sections - d for d in range(1, r + 1))
    good = sim.where((F.col("z1") - F.col("z2")) <= reach).groupBy(*BLOCK).agg(
        F.count(F.when(F.col("s") != 0, F.lit(1))).alias("_good")
    )
    return (
        block_grid(sim.sparkSession, grid)
        .select(*BLOCK)
        .join(good, list(BLOCK), "left")
        .select(*BLOCK, (F.coalesce("_good", F.lit(0)) == full).alias("ok"))
    )


def full_sections(lut: DataFrame, grid: Grid, sections: int) -> DataFrame:
    """Every (z, block) of the grid; failed or absent blocks are NULL."""
    spine = block_sections(lut.sparkSession, grid, sections)
    return spine.join(lut.select("bx", "by", "z", "c"), ["bx", "by", "z"], "left")


def cols_to_sections(columns: DataFrame, grid: Grid, sections: int) -> DataFrame:
    """Packed columns (bx, by, z0, cs) to one row per (z, block)."""
    rows = columns.select("bx", "by", "z0", F.posexplode("cs").alias("i", "c")).select(
        "bx", "by", (F.col("z0") + F.col("i")).alias("z"), "c"
    )
    return full_sections(rows, grid, sections)


def sections_to_cols(lut: DataFrame, length: int = CHUNK) -> DataFrame:
    """Pack coordinates into arrays ordered by z: (bx, by, z0, cs).

    A column is cut into segments of ``length`` sections that start at z0, so
    one block over a very long stack is not gathered into one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("z", "c")))
    return (
        lut.groupBy("bx", "by", F.expr(f"z div {length} * {length}").alias("z0"))
        .agg(ordered.alias("zc"))
        .select("bx", "by", F.expr("zc[0].z").alias("z0"), F.expr("transform(zc, e -> e.c)").alias("cs"))
    )


def block_order(lut: DataFrame, step: int = CHUNK) -> DataFrame:
    """(bx, by, sections, rising): how many sections of a block have a coordinate, and whether each of these lies above the one before it.

    Missing coordinates are passed over.  Two levels: each chunk is compared inside, then
    its last coordinate with the first one of the chunks after it, a row a chunk.
    """
    known, chunk = F.when(F.col("c").isNotNull(), F.col("z")), [*BLOCK, "_chunk"]
    inside = Window.partitionBy(*chunk, F.col("c").isNull()).orderBy("z")
    along = Window.partitionBy(*BLOCK, F.col("_head").isNull()).orderBy("_chunk")
    chunks = (
        lut.withColumn("_chunk", F.expr(f"z div {step}"))
        .withColumn("_next", F.lead("c").over(inside))
        .groupBy(*chunk)
        .agg(
            F.count("c").alias("_n"),
            F.min(F.coalesce(F.col("_next") > F.col("c"), F.lit(True))).alias("_rising"),
            F.min_by("c", known).alias("_head"),
            F.max_by("c", known).alias("_tail"),
        )
        .withColumn("_joined", F.coalesce(F.lead("_head").over(along) > F.col("_tail"), F.lit(True)))
    )
    return chunks.groupBy(*BLOCK).agg(F.sum("_n").alias("sections"), F.min(F.col("_rising") & F.col("_joined")).alias("rising"))


def failed_blocks(lut: DataFrame) -> DataFrame:
    return lut.where("c IS NULL").select(*BLOCK).distinct()


def status_grid(lut: DataFrame, grid: Grid, fail: int = FAILED) -> DataFrame:
    """(bx, by, status): ``fail`` where the block's coordinates are missing, else 0."""
    bad = failed_blocks(lut).withColumn("_bad", F.lit(True))
    return (
        block_grid(lut.sparkSession, grid)
        .select(*BLOCK)
        .join(bad, list(BLOCK), "left")
        .select(*BLOCK, F.when(F.col("_bad"), fail).otherwise(0).cast("tinyint").alias("status"))
    )


def lut_to_images(lut: DataFrame, grid: Grid, sections: int) -> DataFrame:
    """(z, bx, by, c) with 0 where nothing was given; blocks off the grid are ignored."""
    sums = lut.where(grid.contains(F.col("bx"), F.col("by"))).groupBy("bx", "by", "z").agg(F.sum("c").alias("c"))
    spine = block_sections(lut.sparkSession, grid, sections)
    return spine.join(sums, ["bx", "by", "z"], "left").select(
        "z", "bx", "by", F.coalesce("c", F.lit(0.0)).alias("c")
    )
