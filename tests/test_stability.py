"""Correlation of constant and offset data, and task functions on workers without this package."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from sectionflow import Grid
from sectionflow.bindings.queries import QUERIES
from sectionflow.functions import chunks
from sectionflow.operators import similarity

ROOT = Path(__file__).resolve().parent.parent
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def stack(spark, planes):
    rows = [(z, x, y, float(v)) for z, plane in enumerate(planes) for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "z long, x long, y long, v double")


@pytest.mark.parametrize("constant", [0.1, 0.3, 0.7, 1e6 + 0.1])
def test_constant_sections_have_no_correlation(spark, constant):
    rng = np.random.default_rng(1)
    planes = [rng.random((32, 32)), np.full((32, 32), constant), rng.random((32, 32))]
    pixels = stack(spark, planes)
    whole = {(r.z1, r.z2): r.s for r in similarity.section_ncc(pixels, 2).collect()}
    assert whole[1, 0] is None and whole[2, 1] is None
    assert whole[2, 0] == pytest.approx(np.corrcoef(planes[0].ravel(), planes[2].ravel())[0, 1], abs=1e-9)
    for tile in ((4, 4), (7, 5)):
        tiled = {(r.z1, r.z2): r.s for r in similarity.tiled_ncc(similarity.pair_moments(pixels, 2, tile)).collect()}
        assert tiled[1, 0] is None and tiled[2, 1] is None and tiled[2, 0] is not None
    for packed in (False, True):
        for r in similarity.block_ncc(pixels, Grid(32, 32, (8, 8), (8, 8)), 2, packed).collect():
            assert (r.s is None) == (1 in (r.z1, r.z2))


def test_large_offset(spark):
    rng = np.random.default_rng(2)
    planes = 1e6 + rng.normal(size=(3, 16, 16))
    for r in similarity.section_ncc(stack(spark, planes), 2).collect():
        assert r.s == pytest.approx(np.corrcoef(planes[r.z1].ravel(), planes[r.z2].ravel())[0, 1], abs=1e-6)


def test_kernels_run_from_a_foreign_folder(tmp_path):
    """Workers started elsewhere, without a path to the package, run the Python kernels."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).getOrCreate())
for name in ("fill_holes", "tolerant_ncc"):
    assert entry.queries()[name](spark, entry.SMOKE_DIR).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("packed", [False, True])
def test_offset_and_drift_do_not_cancel_in_blocks_and_tiles(spark, packed):
    """A pair's correlation equals the two-pass one at six places, whatever lies under the values."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 40, 150))
    tilt = 1e6 + 1e5 * np.arange(4)[:, None, None] + 100.0 * np.arange(150)[None, None, :]
    planes = base + tilt
    planes[3, :, :] = 1e6 + 0.1
    pixels, grid = stack(spark, planes), Grid(150, 40, (70, 12), (10, 8))

    def two_pass(a, b):
        a, b = a - a.mean(), b - b.mean()
        return (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum())

    got = similarity.block_ncc(pixels, grid, 3, packed).collect()
    assert len(got) == grid.size * 6
    for r in got:
        y, x = slice(r.by * 8, r.by * 8 + 24), slice(r.bx * 10, r.bx * 10 + 140)
        assert (r.s is None) == (r.z1 == 3)
        assert r.s is None or r.s == pytest.approx(two_pass(planes[r.z1, y, x], planes[r.z2, y, x]), abs=1e-6)
    if not packed:
        for r in similarity.tiled_ncc(similarity.pair_moments(pixels, 3, (4, 4))).collect():
            assert (r.s is None) == (r.z1 == 3)
            assert r.s is None or r.s == pytest.approx(two_pass(planes[r.z1], planes[r.z2]), abs=1e-6)


def test_merging_in_squares_gives_what_one_pass_gives(spark):
    from pyspark.sql import functions as F

    from sectionflow.functions.stats import CENTRED, centred_aggs, merge_centred_tree

    rng = np.random.default_rng(5)
    data = [(k, int(x), int(y), float(a), None if a > 1.5 else float(b)) for k in range(2) for x, y, a, b in zip(*rng.integers(0, 90, (2, 3000)), *rng.normal(size=(2, 3000)))]
    df = spark.createDataFrame(data, "k long, x long, y long, a double, b double")
    parts = df.groupBy("k", "x", "y").agg(*centred_aggs())
    want = {r.k: r for r in df.groupBy("k").agg(*centred_aggs()).collect()}
    for side, span in ((2, (90, 90)), (8, (90, 90)), (128, (90, 90))):
        for r in merge_centred_tree(parts, ["k"], ("x", "y"), side, span).collect():
            assert [r[c] for c in CENTRED] == pytest.approx([want[r.k][c] for c in CENTRED], rel=1e-9)
    assert parts.where(F.col("n") == 0).count() > 0


def brute_tolerant(planes, radius, offsets):
    """Two-pass windowed correlation, best over the offsets, for dense sections."""
    h, w = planes[0].shape
    (rx, ry), (mx, my) = radius, offsets
    out = {}
    for z1 in range(len(planes)):
        for z2 in range(z1):
            for y in range(h):
                for x in range(w):
                    best = 0.0
                    for dy in range(-my, my + 1):
                        for dx in range(-mx, mx + 1):
                            if not all(r <= p <= n - r for p, r, n in ((x, rx, w), (x + dx, rx, w), (y, ry, h), (y + dy, ry, h))):
                                continue
                            seen = [
                                (planes[z1][j + dy, i + dx], planes[z2][j, i])
                                for j in range(max(0, y - ry), min(h, y + ry + 1))
                                for i in range(max(0, x - rx), min(w, x + rx + 1))
                                if 0 <= j + dy < h and 0 <= i + dx < w
                            ]
                            a, b = np.array(seen).T if seen else (np.zeros(0), np.zeros(0))
                            if len(seen) and np.ptp(a) > 1e-9 * (1 + abs(a[0])) and np.ptp(b) > 1e-9 * (1 + abs(b[0])):
                                a, b = a - a.mean(), b - b.mean()
                                best = max(best, (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
                    out[z1, z2, x, y] = best
    return out


@pytest.mark.parametrize("radius, tile", [((1, 1), 32), ((3, 2), 8)])
def test_tolerant_windows(spark, radius, tile):
    """Constant sections and constant windows score 0, an offset changes nothing, any radius is exact."""
    from sectionflow.operators import tolerant

    rng = np.random.default_rng(6)
    planes = [rng.random((16, 16)), np.full((16, 16), 0.1), 1e6 + rng.random((16, 16)), rng.random((16, 16)) * 50]
    planes[3][:, :9] = 0.7  # windows inside are constant, others are not
    got = tolerant.tolerant_ncc(stack(spark, planes), 16, 16, 3, (1, 1), radius, tile=tile).collect()
    want = brute_tolerant(planes, radius, (1, 1))
    assert len(got) == len(want)
    for r in got:
        assert r.s == pytest.approx(want[r.z1, r.z2, r.x, r.y], abs=1e-6), r
        assert r.s == 0 or 1 not in (r.z1, r.z2)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")
@pytest.mark.parametrize("name", ["stack_channels", "pack_channels"])
def test_partitions_follow_the_rows_of_a_table(spark, monkeypatch, name):
    monkeypatch.setattr(chunks, "TASK_ROWS", 200)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    found = QUERIES[name](spark, DATA)
    assert found.rdd.getNumPartitions() >= lines // 200
    monkeypatch.setattr(chunks, "TASK_ROWS", 10**9)
    assert sorted(found.collect()) == sorted(QUERIES[name](spark, DATA).collect())
