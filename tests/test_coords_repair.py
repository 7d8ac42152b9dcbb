import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sectionflow.functions.chunks import row_rank, running_max
from sectionflow.functions.grid import Grid
from sectionflow.operators import coords, repair
from sectionflow.operators.grid import block_sections

OLD = Grid(20, 20, (5, 5), (5, 5))
NEW = Grid(20, 20, (2, 2), (2, 2))
LUT = "bx bigint, by bigint, z bigint, c double"


@pytest.fixture(scope="module")
def planar(spark):
    """One value per block: cx + 20 cy."""
    return spark.createDataFrame(
        [(i, j, 0, 5.0 + 5 * i + 20 * (5 + 5 * j)) for i in range(3) for j in range(3)], LUT
    )


def test_nearest_transfer(spark, planar):
    got = {r[:2]: r[3] for r in rows(coords.interp_nearest(planar, coords.grid_mapping(spark, NEW, OLD)), "bx", "by")}
    assert len(got) == 49 and sum(got.values()) == 10290
    assert got[1, 1] == 105 and (0, 0) not in got


def test_bilinear_transfer(spark, planar):
    got = {r[:2]: r[3] for r in rows(coords.interp_linear(planar, coords.grid_mapping(spark, NEW, OLD)), "bx", "by")}
    assert len(got) == 81 and abs(sum(got.values()) - 17010) < 1e-9
    want = {(0, 0): 105, (1, 1): 105, (3, 4): 208, (8, 8): 315}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_halves_round_up_below_zero(spark):
    lut = spark.createDataFrame([(0, 0, 0, 1.0)], LUT)
    at = lambda p: spark.createDataFrame([(7, 7, p, 0.0)], "bx bigint, by bigint, px double, py double")
    assert coords.interp_nearest(lut, at(-0.5)).count() == 1
    assert coords.interp_nearest(lut, at(0.5)).count() == 0
    assert coords.interp_linear(lut, at(-1.0)).first()["c"] is None


def test_missing_corner_makes_result_missing(spark):
    lut = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, None)], LUT)
    mapping = spark.createDataFrame([(0, 0, 0.5, 0.0), (1, 0, 0.0, 0.0)], "bx bigint, by bigint, px double, py double")
    assert rows(coords.interp_linear(lut, mapping).select("c"), "bx") == [(None,), (1.0,)]


def test_gate(spark):
    grid = Grid(8, 8, (2, 5), (2, 8))
    sims = [(bx, 0, z + d, z, 0.5) for bx in range(3) for z in range(5) for d in (1, 2) if z + d < 5]
    sims[3] = (*sims[3][:4], 0.0)
    sim = spark.createDataFrame(sims, "bx bigint, by bigint, z1 bigint, z2 bigint, s double")
    sim = sim.where("NOT (bx = 1 AND z1 = 4 AND z2 = 2)")
    got = dict(r[::2] for r in rows(coords.quality_gate(sim, grid, 5, 2), "bx"))
    assert got == {0: False, 1: False, 2: True}
    assert dict(r[::2] for r in rows(coords.quality_gate(sim, grid, 5, 1), "bx"))[1]


def test_layouts_round_trip(spark):
    grid = Grid(8, 8, (2, 2), (2, 3))
    lut = block_sections(spark, grid, 11).withColumn("c", F.sin(F.col("z") * 7 + F.col("bx") + 3 * F.col("by")))
    for length in (4, 100):
        packed = coords.sections_to_cols(lut, length)
        assert packed.agg(F.max(F.size("cs"))).first()[0] == min(length, 11)
        back = coords.cols_to_sections(packed, grid, 11)
        assert rows(back, "bx", "by", "z") == rows(lut, "bx", "by", "z")
    part = coords.cols_to_sections(coords.sections_to_cols(lut.where("bx > 0")), grid, 11)
    assert part.where("c IS NULL").count() == part.where("bx = 0").count() == 22


def test_status_and_images(spark):
    grid = Grid(8, 8, (2, 2), (2, 2))
    lut = block_sections(spark, grid, 3).withColumn("c", F.when((F.col("bx") != 1) | (F.col("by") != 1), F.col("z") * 1.0))
    status = {r[:2]: r[2] for r in map(tuple, coords.status_grid(lut, grid).collect())}
    assert status.pop((1, 1)) == 127 and set(status.values()) == {0}
    images = coords.lut_to_images(lut.where("bx < 2"), grid, 3)
    assert images.count() == 27 and images.where("z = 2 AND c = 2").count() == 5


def fill_brute(img):
    before = -1
    while True:
        old, holes = img.copy(), np.argwhere(np.isnan(img))
        if len(holes) == before:
            return img
        before = len(holes)
        for y, x in holes:
            num = den = 0.0
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    j, i = y + dy, x + dx
                    if (dx or dy) and 0 <= j < old.shape[0] and 0 <= i < old.shape[1] and not np.isnan(old[j, i]):
                        w = 1.0 if dx == 0 or dy == 0 else 0.5
                        num, den = num + w * old[j, i], den + w
            if den:
                img[y, x] = num / den


def to_pixels(spark, imgs):
    data = [
        (z, x, y, None if np.isnan(v) else float(v)) for z, img in enumerate(imgs) for (y, x), v in np.ndenumerate(img)
    ]
    return spark.createDataFrame(data, "z bigint, x bigint, y bigint, v double")


def test_fill_golden(spark):
    img = np.arange(12.0).reshape(3, 4)
    img[1, 1] = img[1, 2] = np.nan
    got = {(r.x, r.y): r.v for r in repair.fill_holes(to_pixels(spark, [img])).collect()}
    assert abs(got[1, 1] - 4.8) < 1e-12 and abs(got[2, 1] - 6.2) < 1e-12
    row = np.array([[0, np.nan, np.nan, np.nan, np.nan, 8.0]])
    assert [r.v for r in repair.fill_holes(to_pixels(spark, [row])).orderBy("x").collect()] == [0, 0, 0, 8, 8, 8]
    empty = repair.fill_holes(to_pixels(spark, [np.full((2, 2), np.nan)]))
    assert [r.v for r in empty.collect()] == [None] * 4


@pytest.mark.parametrize("tile", [64, 8])
def test_fill_equals_full_passes(spark, tile):
    rng = np.random.default_rng(3)
    imgs = []
    for keep in (0.004, 0.02, 0.1, 0.5, 1.0):
        img = rng.normal(size=(21, 30))
        img[rng.random(img.shape) > keep] = np.nan
        imgs.append(img)
    filled = {(r.z, r.x, r.y): r.v for r in repair.fill_holes(to_pixels(spark, imgs), tile).collect()}
    assert len(filled) == 5 * 21 * 30
    for z, img in enumerate(imgs):
        for (y, x), want in np.ndenumerate(fill_brute(img.copy())):
            got = filled[z, x, y]
            assert (got is None) if np.isnan(want) else abs(got - want) < 1e-9


def test_invert_golden(spark):
    lut = spark.createDataFrame([(0, 0, z, c) for z, c in enumerate([0.1, 1.9, 3.5])], LUT)
    got = [r[3] for r in rows(repair.invert_lut(lut), "z")]
    assert got[0] is None and abs(got[1] - 0.5) < 1e-12 and abs(got[2] - 1.0625) < 1e-12


def test_invert_handles_flat_falling_and_ends(spark):
    lut = spark.createDataFrame([(0, 0, z, c) for z, c in enumerate([0.0, 1.0, 1.0, 0.5, 3.0, 5.0])], LUT)
    got = [r[3] for r in rows(repair.invert_lut(lut), "z")]
    assert got[:2] == [0.0, 1.0] and got[3] == 4.0 and got[5] == 5.0
    assert abs(got[2] - 3.6) < 1e-12 and abs(got[4] - 4.5) < 1e-12


@pytest.mark.parametrize("step", [1, 3, 4096])
def test_inverse_then_forward_is_identity(spark, step):
    rng = np.random.default_rng(2)
    c = np.cumsum(rng.uniform(0.2, 2.0, size=30)) - 1.5
    lut = spark.createDataFrame([(0, 0, z, float(v)) for z, v in enumerate(c)], LUT)
    got = repair.invert_lut(lut, step).collect()
    assert len(got) == 30
    for r in got:
        if c[0] <= r.z <= c[-1]:
            assert abs(np.interp(r.c, np.arange(30), c) - r.z) < 1e-9
        else:
            assert r.c is None


def test_scans_in_two_levels(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, size=(2, 100)).astype(float)
    df = spark.createDataFrame([(k, i, float(values[k, i])) for k in range(2) for i in range(100)], "k int, i bigint, v double")
    for step in (1, 7, 1000):
        got = rows(running_max(df, ["k"], "i", "v", "m", step).select("k", "i", "m"), "k", "i")
        assert [r[2] for r in got] == list(np.maximum.accumulate(values, axis=1).ravel())
        ranks = rows(row_rank(df, ["k"], "v", "i", "r", step).select("k", "i", "r"), "k", "i")
        want = np.argsort(np.argsort(values, axis=1, kind="stable"), axis=1)
        assert [r[2] for r in ranks] == list(want.ravel())


def test_fill_lut_keeps_present_blocks(spark):
    grid = Grid(8, 8, (2, 2), (2, 2))
    lut = block_sections(spark, grid, 4).withColumn("c", F.when(F.col("bx") + F.col("by") != 2, F.col("z") + 0.5))
    filled = repair.fill_lut(lut)
    assert filled.where("c IS NULL").count() == 0
    assert filled.where("c != z + 0.5").count() == 0


def test_steep_stretch_stops_at_the_last_section(spark):
    lut = spark.createDataFrame([(0, 0, 0, 0.0), (0, 0, 1, 1e15)], LUT)
    got = [r[3] for r in rows(repair.invert_lut(lut), "z")]
    assert got == [0.0, 1e-15]


@pytest.mark.parametrize("values", ["ties", "mixed", "spread"])
def test_rank_of_many_rows_and_of_one_value(spark, values):
    rng = np.random.default_rng(3)
    n = 500
    drawn = {"ties": np.full(n, 2.5), "mixed": np.where(rng.random(n) < 0.6, 7.0, rng.integers(0, 9, n)), "spread": rng.normal(size=n)}
    data = [(b, z, float(v)) for b in range(2) for z, v in enumerate(drawn[values] + b)]
    df = spark.createDataFrame(data, "k long, z long, v double").repartition(7)
    got = {(r.k, r.z): r.rank for r in row_rank(df, ["k"], "v", "z", "rank", step=16).collect()}
    for b in range(2):
        want = sorted((v, z) for k, z, v in data if k == b)
        assert [got[b, z] for _, z in want] == list(range(n))


def test_fill_far_into_a_hole_over_tiles(spark):
    """Rounds read open tiles and those around them only; the result is that of one pass after another."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=(3, 30, 41))
    values[0, 2:28, 3:38] = np.nan
    values[1] = np.nan
    data = [(z, x, y, None if np.isnan(v) else float(v)) for (z, y, x), v in np.ndenumerate(values)]
    cells = spark.createDataFrame(data, "z long, x long, y long, v double").repartition(3)
    want, known = values[:1].copy(), ~np.isnan(values[:1])
    want = np.nan_to_num(want)
    while not known.all():
        want, known = repair._fill_pass(want, known)
    for tile in (3, 8, 64):
        got = {(r.z, r.x, r.y): r.v for r in repair.fill_holes(cells, tile).collect()}
        assert len(got) == values.size
        assert all(got[1, x, y] is None for x in range(41) for y in range(30))
        assert max(abs(got[0, x, y] - want[0, y, x]) for x in range(41) for y in range(30)) < 1e-9
        assert all(got[2, x, y] == values[2, y, x] for x in range(41) for y in range(30))


def test_block_order_compares_all_sections_of_a_block(spark):
    rng = np.random.default_rng(8)
    columns = {
        (0, 0): [float(z) for z in range(40)],
        (1, 0): [float(z) - 30 * (z >= 7) for z in range(40)],  # falls where a chunk of 7 begins
        (2, 0): [None if 5 <= z < 23 else float(z) - 30 * (z >= 23) for z in range(40)],  # and over missing chunks
        (0, 1): [None] * 40,
        (1, 1): [None if rng.random() < 0.3 else float(z) for z in range(40)],
        (2, 1): [float(z - (z == 39)) for z in range(40)],  # the last two are equal
    }
    data = [(*b, z, c) for b, cs in columns.items() for z, c in enumerate(cs)]
    lut = spark.createDataFrame(data, "bx bigint, by bigint, z bigint, c double").repartition(5)
    want = []
    for b, cs in columns.items():
        known = [c for c in cs if c is not None]
        want.append((*b, len(known), all(a < c for a, c in zip(known, known[1:]))))
    assert [w[3] for w in want] == [True, False, False, True, True, False]
    for step in (1, 7, 40, 4096):
        assert rows(coords.block_order(lut, step), "bx", "by") == sorted(want)
