import pytest
from conftest import rows
from pyspark.sql import functions as F

from sectionflow.functions.grid import Grid
from sectionflow.operators import grid as g


def test_centres(spark):
    blocks = rows(g.block_grid(spark, Grid(20, 20, (5, 5), (5, 5))), "by", "bx")
    assert len(blocks) == 9
    assert sorted({b[2] for b in blocks}) == [5, 10, 15]
    assert g.block_grid(spark, Grid(20, 20, (2, 2), (2, 2))).count() == 81


def test_radius_beyond_extent_gives_nothing(spark):
    for r in (8, 9):
        grid = Grid(8, 8, (r, r), (2, 2))
        assert grid.size == 0
        assert g.block_grid(spark, grid).count() == 0


def test_wide_grids_are_written_small(spark, tmp_path):
    for width, height in ((64, 5), (130, 7), (3, 200)):
        grid = Grid(width + 1, height + 1, (1, 1), (1, 1))
        got = {(r.bx, r.by, r.cx, r.cy) for r in g.block_grid(spark, grid).collect()}
        assert got == {(x, y, x + 1, y + 1) for x in range(width) for y in range(height)}
    wide = g.block_grid(spark, Grid(150_000, 20, (1, 1), (1, 1)))
    wide.coalesce(1).write.parquet(str(tmp_path / "grid"))
    size = sum(f.stat().st_size for f in (tmp_path / "grid").glob("*.parquet"))
    assert size < 2 * wide.count()  # bytes; whole rows of the grid take four times as much


def test_partitions_of_large_grids_have_few_values(spark):
    for width, height in ((1_440_000, 360_000), (360_000, 50), (70, 9_000_000)):
        grid = Grid(width + 1, height + 1, (1, 1), (1, 1))
        parts = g.block_grid(spark, grid).rdd.getNumPartitions()
        assert -(-grid.size // parts) <= g.VALUES * min(g.STRIP, width, height)
    grid = Grid(9, 1_000_001, (1, 1), (1, 1))
    blocks = g.grid_translate(g.block_grid(spark, grid), Grid(9, 1_000_001, (2, 2), (4, 4)))
    counts = [F.approx_count_distinct(c).alias(c) for c in blocks.columns]
    found = blocks.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), *counts).collect()
    assert sum(r.n for r in found) == grid.size
    assert all(r[c] < 1.5 * g.VALUES for r in found for c in blocks.columns)  # estimates; a dictionary holds twice as many


@pytest.mark.parametrize("width,height", [(g.STRIP - 1, 3), (g.STRIP + 1, 5), (2 * g.STRIP + 7, 4), (3, 2 * g.STRIP)])
def test_strips_hold_every_block_once(spark, width, height):
    got = [tuple(r) for r in g.block_grid(spark, Grid(width + 1, height + 1, (1, 1), (1, 1))).collect()]
    assert len(got) == width * height
    assert set(got) == {(x, y, x + 1, y + 1) for x in range(width) for y in range(height)}


def test_division_truncates_toward_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 9), (12, 5)], "x bigint, y bigint")
    got = rows(g.world_to_local(df, Grid(20, 20, (5, 5), (4, 4))), "x")
    assert [r[2:] for r in got] == [(-1, -1), (-1, 1), (1, 0)]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("dim", [7, 8, 20, 33])
def test_membership_equals_windows(spark, closed, dim):
    pixels = spark.range(dim).select(F.col("id").alias("x"), F.lit(0).cast("bigint").alias("y"))
    for radius in (1, 2, 3, 5, 10):
        for step in (1, 2, 3, 5, 8):
            grid = Grid(dim, 12, (radius, 6), (step, 12))
            got = {(r[0], r[2]) for r in g.block_members(pixels, grid, closed).collect()}
            want = set()
            for b in range(grid.nx):
                c = radius + b * step
                stop = min(dim - 1, c + radius) if closed else min(dim, c + radius) - 1
                want |= {(x, b) for x in range(c - radius, stop + 1)}
            assert got == want, (radius, step)


def test_golden_windows(spark):
    pixels = spark.range(8).select(F.col("id").alias("x"), F.lit(0).cast("bigint").alias("y"))

    def windows(radius, closed):
        grid = Grid(8, 12, (radius, 6), (2, 12))
        got = g.block_members(pixels, grid, closed).groupBy("bx").agg(F.min("x"), F.max("x"))
        return [r[1:] for r in rows(got, "bx")]

    assert windows(2, False) == [(0, 3), (2, 5), (4, 7)]
    assert windows(3, False) == [(0, 5), (2, 7), (4, 7)]
    assert windows(2, True) == [(0, 4), (2, 6), (4, 7)]


def test_cells_spread_to_the_same_blocks(spark):
    grid = Grid(13, 11, (3, 2), (2, 3))
    pixels = spark.range(13 * 11).selectExpr("id % 13 AS x", "id div 13 AS y")
    direct = g.block_members(pixels, grid).groupBy("bx", "by").count()
    cells = g.with_cell(pixels, grid).groupBy(*g.CELL).count()
    merged = g.cells_to_blocks(cells).groupBy("bx", "by").agg(F.sum("count").alias("count"))
    assert rows(direct, "bx", "by") == rows(merged, "bx", "by")


def test_block_sections_is_the_full_product(spark):
    got = g.block_sections(spark, Grid(8, 8, (2, 2), (2, 3)), 5)
    assert got.count() == got.distinct().count() == 3 * 2 * 5
    assert got.agg(F.max("bx"), F.max("by"), F.max("z")).first()[:] == (2, 1, 4)


def test_block_totals_add_up_the_members(spark):
    grid = Grid(100, 90, (3, 2), (2, 1))
    pixels = spark.range(4000).selectExpr("id * 7 % 100 AS x", "id * id % 90 AS y", "double(id % 5) AS v")
    for closed in (False, True):
        direct = g.block_members(pixels, grid, closed).groupBy("bx", "by")
        direct = direct.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
        totals = g.block_totals(pixels, grid, closed)
        assert rows(totals.select("bx", "by", "n", "v"), "bx", "by") == rows(direct, "bx", "by")
