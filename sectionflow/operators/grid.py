"""Block grid and pixel-to-block membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.functions.grid import Grid, explode_range, member_range


STRIP = 256  # block columns
VALUES = 1 << 16  # that a column has in one partition; a file's dictionary holds twice as many


def block_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """blocks(bx, by, cx, cy); generated in parallel, strip by strip of ``STRIP`` columns, row-major inside.

    A stretch of rows then has few values in any column, and partitions follow the rows so that
    none has many: a written grid takes about a third of a byte a block however wide and high
    it is.  Whole rows of a wide grid, or long stretches of a high one, fill the dictionaries of files.
    """
    if grid.size == 0:
        return spark.range(0).selectExpr("id AS bx", "id AS by", "id AS cx", "id AS cy")
    rows = VALUES * min(STRIP, grid.nx, grid.ny)
    partitions = max(spark.sparkContext.defaultParallelism, -(-grid.size // rows))
    first = f"(id div {STRIP * grid.ny} * {STRIP})"
    width = f"least({STRIP}, {grid.nx} - {first})"
    inside = f"(id % {STRIP * grid.ny})"
    bx, by = F.expr(f"{first} + {inside} % {width}"), F.expr(f"{inside} div {width}")
    return spark.range(0, grid.size, 1, partitions).select(
        bx.alias("bx"),
        by.alias("by"),
        (bx * grid.step[0] + grid.radius[0]).alias("cx"),
        (by * grid.step[1] + grid.radius[1]).alias("cy"),
    )


def block_sections(spark: SparkSession, grid: Grid, sections: int) -> DataFrame:
    """Every (bx, by, z), generated in parallel without a cross join."""
    if grid.size * sections == 0:
        return spark.range(0).selectExpr("id AS bx", "id AS by", "id AS z")
    return spark.range(grid.size * sections).select(
        F.expr(f"id % {grid.nx}").alias("bx"),
        F.expr(f"(id div {grid.nx}) % {grid.ny}").alias("by"),
        F.expr(f"id div {grid.size}").alias("z"),
    )


def world_to_local(df: DataFrame, grid: Grid) -> DataFrame:
    """Pixel position to block index, dividing toward zero."""
    return df.withColumn("bx", F.expr(f"(x - {grid.radius[0]}) div {grid.step[0]}")).withColumn(
        "by", F.expr(f"(y - {grid.radius[1]}) div {grid.step[1]}")
    )


def grid_translate(blocks: DataFrame, into: Grid) -> DataFrame:
    """Block centres as fractional indices (px, py) of another grid."""
    return blocks.withColumn("px", (F.col("cx") - into.radius[0]) / F.lit(float(into.step[0]))).withColumn(
        "py", (F.col("cy") - into.radius[1]) / F.lit(float(into.step[1]))
    )


def block_members(pixels: DataFrame, grid: Grid, closed: bool = False) -> DataFrame:
    """One row per (pixel, block whose window holds it)."""
    x0, x1 = member_range("x", grid, closed)
    y0, y1 = member_range("y", grid, closed)
    return pixels.withColumn("bx", explode_range(x0, x1)).withColumn("by", explode_range(y0, y1))


CELL = ("lx", "hx", "ly", "hy")


def with_cell(pixels: DataFrame, grid: Grid, closed: bool = False) -> DataFrame:
    """Tag pixels with the block ranges they belong to.

    Pixels with equal ranges lie in exactly the same blocks, so sums can be taken
    per cell first and spread over blocks afterwards.  Pixels in no block go.
    """
    (lx, hx), (ly, hy) = member_range("x", grid, closed), member_range("y", grid, closed)
    tagged = pixels.withColumns({"lx": lx, "hx": hx, "ly": ly, "hy": hy})
    return tagged.where((F.col("lx") <= F.col("hx")) & (F.col("ly") <= F.col("hy")))


def cells_to_blocks(df: DataFrame) -> DataFrame:
    """Repeat per-cell rows for every block of the cell."""
    return (
        df.withColumn("bx", explode_range(F.col("lx"), F.col("hx")))
        .withColumn("by", explode_range(F.col("ly"), F.col("hy")))
        .drop(*CELL)
    )


TILE = 32  # blocks a side


def block_totals(pixels: DataFrame, grid: Grid, closed: bool = False) -> DataFrame:
    """(bx, by, n, v): pixels of each block that has any, and the sum of their values.

    Pixels are added up by cell, cells are sent to the tiles of blocks that they reach into,
    and a tile's blocks are added up where its cells are, so no row moves once for each block.
    """
    cells = with_cell(pixels, grid, closed).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    for tile, low, high in (("tx", "lx", "hx"), ("ty", "ly", "hy")):
        cells = cells.withColumn(tile, F.expr(f"explode(sequence({low} div {TILE}, {high} div {TILE}))"))
    placed = cells.repartition("tx", "ty")
    for tile, low, high in (("tx", "lx", "hx"), ("ty", "ly", "hy")):
        first, last = f"{tile} * {TILE}", f"{tile} * {TILE} + {TILE - 1}"
        placed = placed.withColumns({low: F.expr(f"greatest({low}, {first})"), high: F.expr(f"least({high}, {last})")})
    sums = F.sum("n").alias("n"), F.sum("v").alias("v")
    return cells_to_blocks(placed).groupBy("tx", "ty", "bx", "by").agg(*sums).drop("tx", "ty")
