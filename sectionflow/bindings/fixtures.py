"""Stacks and coordinate tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectionflow.functions.chunks import enough_partitions, owned, with_halo
from sectionflow.functions.grid import Grid
from sectionflow.operators.grid import block_members, block_sections
from sectionflow.sources.stacks import unpack_pixels

SIDE = 8
ORDERS_PER_SECTION = 16
STEP = 256
GRID = Grid(SIDE, SIDE, (2, 2), (2, 2))
FINE = Grid(SIDE, SIDE, (1, 1), (1, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("z"), F.col("embedding").alias("px"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense stack: one embedding per section, 8 pixels wide."""
    return unpack_pixels(packed_embeddings(spark, sf_dir), SIDE)


def emb_sections(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]


def emb_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for a row per pixel of ``emb``."""
    return enough_partitions(spark, table(spark, sf_dir, "embeddings").count() * SIDE * SIDE)


def emb_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``emb`` averaged over each section and the seven after it."""
    spread = with_halo(emb(spark, sf_dir), STEP, after=7)
    ahead = Window.partitionBy("x", "y", "chunk").orderBy("z").rowsBetween(0, 7)
    return spread.withColumn("v", F.avg("v").over(ahead)).where(owned(STEP)).select("z", "x", "y", "v")


def line_pixels(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """Line items placed on the stack, before cells are summed."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(f"l_orderkey div {ORDERS_PER_SECTION}").alias("z"),
        F.expr(f"l_partkey % {side}").alias("x"),
        F.expr(f"(l_partkey div {side}) % {side}").alias("y"),
        "l_quantity",
        "l_discount",
        "l_returnflag",
    )


def li_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for a row per line item."""
    return enough_partitions(spark, table(spark, sf_dir, "lineitem").count())


def li_cells(spark: SparkSession, sf_dir: str, lines: DataFrame, value: str | Column) -> DataFrame:
    """``value`` of line items added up by cell.  Few share a cell, so they meet as they are, in partitions that follow their number."""
    return lines.repartition(li_parts(spark, sf_dir), "z", "x", "y").groupBy("z", "x", "y").agg(F.sum(value).alias("v"))


def li(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """Holey stack of whole numbers: quantity per (orders, part) cell."""
    return li_cells(spark, sf_dir, line_pixels(spark, sf_dir, side), "l_quantity")


def li_sections(spark: SparkSession, sf_dir: str) -> int:
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return top // ORDERS_PER_SECTION + 1


def li_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``li`` with a NULL row for every empty cell."""
    spine = block_sections(spark, Grid(SIDE, SIDE, (0, 0), (1, 1)), li_sections(spark, sf_dir))
    spine = spine.select("z", F.col("bx").alias("x"), F.col("by").alias("y"))
    return spine.join(li(spark, sf_dir), ["z", "x", "y"], "left")


def li_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights for the cells that hold returned items."""
    returned = line_pixels(spark, sf_dir).where(F.col("l_returnflag") == "R")
    return li_cells(spark, sf_dir, returned, "l_quantity")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide image: parts across, suppliers down."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_quantity").alias("v")
    )


def plane_grid(spark: SparkSession, sf_dir: str, radius=(20, 3), step=(20, 2)) -> Grid:
    top = plane(spark, sf_dir).agg(F.max("x") + 1, F.max("y") + 1).first()
    return Grid(top[0], top[1], radius, step)


def _offset(df: DataFrame, number: str) -> DataFrame:
    """c = z + a quarter step that depends on the section's number and block."""
    quarter = F.expr(f"({number} + bx + 2 * by) % 4") * 0.25
    return df.select("bx", "by", "z", (F.col("z") + quarter).alias("c"))


def lut_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly rising coordinates on a 3 x 3 grid over ``emb``, from the labels."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("z"), F.col("label").cast("bigint").alias("q"))
    spine = block_sections(spark, GRID, emb_sections(spark, sf_dir))
    return _offset(spine.join(labels, "z"), "q")


def lut_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over ``li``, from each section's total quantity."""
    totals = line_pixels(spark, sf_dir).groupBy("z").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    spine = block_sections(spark, GRID, li_sections(spark, sf_dir))
    return _offset(spine.join(totals, "z", "left").withColumn("q", F.coalesce("q", F.lit(0))), "q")


def lut_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lut_li`` with every block missing whose column total is even."""
    totals = block_members(line_pixels(spark, sf_dir), GRID).groupBy("bx", "by").agg(
        F.sum("l_quantity").cast("bigint").alias("q")
    )
    return (
        lut_li(spark, sf_dir)
        .join(totals, ["bx", "by"])
        .select("bx", "by", "z", F.when(F.col("q") % 2 == 1, F.col("c")).alias("c"))
    )
