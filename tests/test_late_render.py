"""Rendering with late pixels against the plain composition, its plan, and the written job as a query."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sectionflow.functions.grid import Grid
from sectionflow.operators import render

SECTIONS, WIDTH, HEIGHT = 23, 20, 13


def positions(spark, grid, seed, missing=0.1, steep=False):
    """Random coordinates, some missing, some outside the stack, many on whole sections."""
    rng = np.random.default_rng(seed)
    c = rng.uniform(-2, SECTIONS + 1, size=(SECTIONS + 4, grid.ny, grid.nx))
    if not steep:
        c = np.sort(c, axis=0) * 0.3 + np.arange(SECTIONS + 4)[:, None, None] * 0.7
    c = np.where(rng.random(c.shape) < 0.3, np.round(c), c)
    c[3] = SECTIONS - 1.0  # all blocks on the last section
    c[5] = -4.0  # outside altogether
    data = [(i, j, z, None if rng.random() < missing else float(v)) for (z, j, i), v in np.ndenumerate(c)]
    data = [r for r in data if r[2] != 7 and r[:3] != (1, 0, 9)]  # a target and a block without rows
    return spark.createDataFrame(data, "bx bigint, by bigint, z bigint, c double")


def sparse_stack(spark, seed, scale=1):
    rng = np.random.default_rng(seed)
    data = [
        (z, x, y, None if rng.random() < 0.1 else float(rng.normal()))
        for z in range(SECTIONS)
        if z not in (4, 5, 6, 12)
        for x in range(WIDTH * scale)
        for y in range(HEIGHT * scale)
        if rng.random() < 0.7
    ]
    return spark.createDataFrame(data, "z bigint, x bigint, y bigint, v double")


def plain(pixels, lut, grid, width, height, scale):
    """Every target pixel upsampled, joined to its sections, targets without any section dropped."""
    coords = render.upsample_lut(lut, grid, width, height, scale)
    have = pixels.select(F.col("z").alias("source")).distinct()
    kept = render.required_sections(coords).join(have, "source").select(F.col("target").alias("z")).distinct()
    return render.resample(pixels, coords.join(kept, "z", "left_semi"), SECTIONS)


@pytest.mark.parametrize(
    "grid, scale, step, tile, steep",
    [
        (Grid(WIDTH, HEIGHT, (3, 2), (4, 3)), 1, 256, 64, False),
        (Grid(WIDTH, HEIGHT, (3, 2), (4, 3)), 1, 5, 6, False),
        (Grid(WIDTH, HEIGHT, (5, 4), (2, 2)), 2, 4, 16, True),
        (Grid(WIDTH, HEIGHT, (6, 6), (50, 50)), 1, 3, 5, True),
        (Grid(WIDTH, HEIGHT, (0, 0), (1, 1)), 1, 7, 8, False),
    ],
)
def test_late_pixels_are_the_plain_ones(spark, grid, scale, step, tile, steep):
    lut, pixels = positions(spark, grid, 3, steep=steep), sparse_stack(spark, 4, scale)
    width, height = WIDTH * scale, HEIGHT * scale
    got = rows(render.render(pixels, lut, grid, width, height, SECTIONS, scale, step, tile), "z", "x", "y")
    want = rows(plain(pixels, lut, grid, width, height, scale), "z", "x", "y")
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] is None for r in got] == [r[3] is None for r in want]
    assert np.allclose([r[3] for r in got if r[3] is not None], [r[3] for r in want if r[3] is not None], atol=1e-12)
    assert {r[0] for r in got} & {5, 7} == set()


def test_missing_sections_hide_only_their_targets(spark):
    """A target whose cells all miss by one pixel but hit by another is kept."""
    grid = Grid(WIDTH, HEIGHT, (3, 2), (16, 10))
    lut = spark.createDataFrame(
        [(i, 0, 0, 4.9 + i) for i in range(grid.nx)] + [(i, 0, 1, 4.5) for i in range(grid.nx)],
        "bx bigint, by bigint, z bigint, c double",
    )
    pixels = sparse_stack(spark, 5).where("z NOT IN (3, 8, 9)")
    got = render.render(pixels, lut, grid, WIDTH, HEIGHT, SECTIONS)
    assert {r.z for r in got.select("z").distinct().collect()} == {
        r.z for r in plain(pixels, lut, grid, WIDTH, HEIGHT, 1).select("z").distinct().collect()
    }


def test_empty_tables(spark):
    grid = Grid(WIDTH, HEIGHT, (3, 2), (4, 3))
    lut, pixels = positions(spark, grid, 3), sparse_stack(spark, 4)
    assert render.render(pixels.limit(0), lut, grid, WIDTH, HEIGHT, SECTIONS).count() == 0
    assert render.render(pixels, lut.limit(0), grid, WIDTH, HEIGHT, SECTIONS).count() == 0


def test_plan_sends_pixels_once_and_never_by_chunk_or_section_alone(spark):
    grid = Grid(WIDTH, HEIGHT, (3, 2), (4, 3))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = render.render(sparse_stack(spark, 4), positions(spark, grid, 3), grid, WIDTH, HEIGHT, SECTIONS)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    keys = [line.split("hashpartitioning(")[1].split(", ", 1)[0].split("#")[0] + str(line.count("#")) for line in lines]
    assert sum("chunk" in line and "part" in line for line in lines) == 2  # pixels, and the cells that ask for them
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, keys
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_plateaus_are_warped_by_pairs_of_runs(spark, monkeypatch):
    """Two thirds of the sections share one floor; parts of a run give what one row gives."""
    rng = np.random.default_rng(7)
    n, blocks = 60, [(0, 0), (1, 0)]
    c = np.where(np.arange(n) < 40, 20 + rng.random(n) * 0.9, np.arange(n) * 1.0)
    lut = [(bx, by, z, float(c[z] + bx * 0.01)) for bx, by in blocks for z in range(n)]
    matrix = [(bx, by, a, b, float(rng.normal())) for bx, by in blocks for a in range(n) for b in range(max(0, a - 4), min(n, a + 5))]
    lut = spark.createDataFrame(lut, "bx bigint, by bigint, z bigint, c double")
    matrix = spark.createDataFrame(matrix, "bx bigint, by bigint, z1 bigint, z2 bigint, s double")
    whole = rows(render.warp_matrix(matrix, lut), "bx", "by", "z1", "z2")
    monkeypatch.setattr(render, "RUN", 8)
    parts = rows(render.warp_matrix(matrix, lut), "bx", "by", "z1", "z2")
    assert [r[:4] for r in whole] == [r[:4] for r in parts] and len(whole) > 2 * 40 * 40
    assert np.allclose([r[4] for r in whole], [r[4] for r in parts])
