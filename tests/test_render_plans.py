import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sectionflow.bindings.queries import QUERIES
from sectionflow.functions.grid import Grid
from sectionflow.operators import render
from sectionflow.operators.coords import interp_linear
from sectionflow.operators.grid import block_sections
from sectionflow.operators.infer import InferOptions
from sectionflow.operators.repair import invert_lut
from sectionflow.operators.tolerant import tolerant_similarity, tolerant_strategy
from sectionflow.plans import estimate
from sectionflow.plans.options import halving_stages, job_options
from sectionflow.sources import stacks

GRID = Grid(10, 7, (3, 2), (2, 2))
SECTIONS = 12


def lut_values():
    rng = np.random.default_rng(8)
    return rng.uniform(-0.5, SECTIONS - 0.5, size=(SECTIONS, GRID.ny, GRID.nx))


def as_lut(spark, values):
    data = [(i, j, z, None if np.isnan(c) else float(c)) for (z, j, i), c in np.ndenumerate(values)]
    return spark.createDataFrame(data, "bx bigint, by bigint, z bigint, c double")


def upsample_brute(values, width, height, scale=1):
    n, ny, nx = values.shape
    out = np.empty((n, height, width))
    for y in range(height):
        for x in range(width):
            u = min(max((x / scale - GRID.radius[0]) / GRID.step[0], 0), nx - 1)
            w = min(max((y / scale - GRID.radius[1]) / GRID.step[1], 0), ny - 1)
            i, j = int(u), int(w)
            fx, fy = u - i, w - j
            total = 0
            for di, wx in ((0, 1 - fx), (1, fx)):
                for dj, wy in ((0, 1 - fy), (1, fy)):
                    if wx * wy > 0:
                        total = total + wx * wy * values[:, j + dj, i + di]
            out[:, y, x] = total
    return out


@pytest.mark.parametrize("scale", [1, 2, 4])
def test_upsample(spark, scale):
    values = lut_values()
    values[3, 1, 1] = np.nan
    want = upsample_brute(values, 10 * scale, 7 * scale, scale)
    got = render.upsample_lut(as_lut(spark, values), GRID, 10 * scale, 7 * scale, scale).collect()
    assert len(got) == want.size
    for r in got:
        w = want[r.z, r.y, r.x]
        assert (r.p is None) if np.isnan(w) else abs(r.p - w) < 1e-9


def test_upsample_one_block(spark):
    grid = Grid(10, 7, (6, 4), (10, 7))
    lut = spark.createDataFrame([(0, 0, 0, 2.5)], "bx bigint, by bigint, z bigint, c double")
    got = render.upsample_lut(lut, grid, 10, 7)
    assert got.count() == 70 and got.where("p != 2.5").count() == 0


@pytest.mark.parametrize("step,tile", [(256, 64), (1, 3), (5, 2)])
@pytest.mark.parametrize("renormalise", [True, False])
def test_resample(spark, random_stack, renormalise, step, tile):
    df, v = random_stack
    have = [z for z in range(SECTIONS) if z not in (4, 5, 9)]
    pixels = df.where(F.col("z").isin(have))
    values = lut_values()
    values[0, 0, 0], values[1, 0, 0], values[2, 0, 0] = 3.0, 4.0, SECTIONS - 1.0
    coords = render.upsample_lut(as_lut(spark, values), GRID, 10, 7)
    p = upsample_brute(values, 10, 7)
    got = render.resample(pixels, coords, SECTIONS, renormalise, step, tile).collect()
    assert len(got) == SECTIONS * 70
    for r in got:
        at, want = p[r.z, r.y, r.x], None
        if 0 <= at <= SECTIONS - 1:
            z = int(np.floor(at))
            parts = [(z, 1 - (at - z)), (z + 1, at - z)]
            if renormalise:
                parts = [(k, w) for k, w in parts if k in have]
            parts = [(k, w) for k, w in parts if w > 0]
            vals = [(v[k, r.y, r.x] if k in have else np.nan) for k, _ in parts]
            if parts and not np.isnan(vals).any():
                want = sum(w * a for (_, w), a in zip(parts, vals, strict=True)) / sum(w for _, w in parts)
        assert (r.v is None) == (want is None)
        assert want is None or abs(r.v - want) < 1e-9


def test_busy_chunks_are_split(spark, random_stack):
    df, _ = random_stack
    # Two thirds of the coordinates read section 5.
    lut = block_sections(spark, GRID, 40).withColumn("c", F.when(F.col("z") % 3 > 0, 5.5).otherwise(F.col("z")))
    copies = render.chunk_copies(lut, 40, step=4)
    assert dict(tuple(r) for r in copies.collect())[1] == 7
    assert copies.agg(F.sum("copies")).first()[0] <= 20
    coords = render.upsample_lut(lut, GRID, 10, 7)
    plain, split = (rows(render.resample(df, coords, 40, step=4, copies=c), "z", "x", "y") for c in (None, copies))
    assert plain == split and len(plain) == 40 * 70


def test_targets_without_sources_are_dropped(spark, random_stack):
    df, _ = random_stack
    lut = block_sections(spark, GRID, 6).withColumn("c", F.col("z") * 1.0)
    got = render.render(df.where("z NOT IN (2, 3)"), lut, GRID, 10, 7, 40)
    assert sorted(r[0] for r in got.select("z").distinct().collect()) == [0, 1, 4, 5]


def test_identity_coordinates_return_the_stack(spark, random_stack):
    df, _ = random_stack
    lut = block_sections(spark, GRID, 40).withColumn("c", F.col("z") * 1.0)
    assert rows(render.render(df, lut, GRID, 10, 7, 40), "z", "x", "y") == rows(df, "z", "x", "y")
    need = rows(render.required_sections(render.upsample_lut(lut, GRID, 10, 7)), "target", "source")
    assert need == [(z, z) for z in range(40)]


def test_transform_of_transform_is_identity(spark):
    rng = np.random.default_rng(6)
    c = np.cumsum(rng.uniform(0.5, 1.5, size=(30, GRID.ny, GRID.nx)), axis=0) - 1
    forward = as_lut(spark, c)
    # Radius 0 and step 1: every block is its own pixel.
    pixel_grid = Grid(GRID.nx, GRID.ny, (0, 0), (1, 1))
    got = render.transform_roundtrip(forward, invert_lut(forward), pixel_grid, GRID.nx, GRID.ny, 30)
    ok = got.where("v IS NOT NULL")
    assert ok.count() > 20 * GRID.size
    assert ok.agg(F.max(F.abs(F.col("v") - F.col("z")))).first()[0] < 1e-9


def test_warp_matrix(spark):
    rng = np.random.default_rng(7)
    n, reach = 15, 4
    matrix = np.full((n, n), np.nan)
    for a in range(n):
        for b in range(max(0, a - reach), min(n, a + reach + 1)):
            matrix[a, b] = rng.normal()
    c = np.cumsum(rng.uniform(0.2, 1.4, n)) - 0.7
    c[6] = 5.0
    data = [(0, 0, a, b, float(s)) for (a, b), s in np.ndenumerate(matrix) if not np.isnan(s)]
    df = spark.createDataFrame(data, "bx bigint, by bigint, z1 bigint, z2 bigint, s double")
    lut = spark.createDataFrame([(0, 0, z, float(p)) for z, p in enumerate(c)], "bx bigint, by bigint, z bigint, c double")
    got = {(r.z1, r.z2): r.s for r in render.warp_matrix(df, lut).collect()}
    want = {}
    for i in range(n):
        for j in range(n):
            total = 0.0
            for a, wa in ((int(np.floor(c[i])), 1 - c[i] % 1), (int(np.floor(c[i])) + 1, c[i] % 1)):
                for b, wb in ((int(np.floor(c[j])), 1 - c[j] % 1), (int(np.floor(c[j])) + 1, c[j] % 1)):
                    if wa * wb > 0:
                        total += wa * wb * (matrix[a, b] if 0 <= a < n and 0 <= b < n else np.nan)
            if not np.isnan(total):
                want[i, j] = total
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


CONFIG = {
    "source": "s", "mask": "m", "target": "t", "start": 3, "stop": 43,
    "defaultOptions": {"comparisonRange": 4, "nIterations": 2, "multiplierEstimationIterations": 2, "unknown": 1},
    "options": [
        {"steps": [10, 7], "radii": [6, 4]},
        {"steps": [4, 3], "radii": [3, 2], "inference": {"regularizationType": "NONE", "nIterations": 1}},
        {"steps": [2, 2], "radii": [2, 2], "maxOffsets": [1, 1], "correlationBlockRadii": [3, 3]},
    ],
}


def test_option_rules():
    o = job_options(CONFIG)
    assert (o.sections, o.reach, o.scale, o.join_step) == (40, 4, 0, 8)
    assert [s.infer.regularization for s in o.stages] == ["BORDER", "NONE", "NONE"]
    assert [s.infer.iterations for s in o.stages] == [2, 1, 1]
    assert o.stages[0].infer.shift_proportion == InferOptions().shift_proportion
    assert [s.correlation_radii for s in o.stages] == [(6, 4), (3, 2), (3, 3)]
    assert [s.max_offsets for s in o.stages] == [(0, 0), (0, 0), (1, 1)]
    flags = lambda v: [s.log_matrices for s in job_options({**CONFIG, "logMatrices": v}).stages]
    assert flags(True) == [True] * 3
    assert flags([0, 2, 9]) == [True, False, True]
    assert flags({"1": True, "2": False}) == [False, True, False]
    assert job_options({**CONFIG, "joinStepSize": 99}).join_step == 99
    with pytest.raises(ValueError, match="start"):
        job_options({k: v for k, v in CONFIG.items() if k != "start"})


def test_halving_recipe():
    got = halving_stages(64, 40, 3)
    assert [e["steps"] for e in got] == [[64, 40], [32, 20], [16, 10]]
    assert got[0]["radii"] == [33, 21] and "inference" not in got[0]
    assert got[2]["inference"]["coordinateUpdateRegularizerWeight"] == 0.2


def test_estimation_and_render_jobs(spark, random_stack, tmp_path):
    df, _ = random_stack
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    stacks.write_sections(df.withColumn("z", F.col("z") + 3), source)
    o = job_options({**CONFIG, "source": source, "mask": "", "target": target, "logMatrices": [1]})
    report = rows(estimate.estimation_job(spark, o, 10, 7), "stage")
    grids = [Grid(10, 7, s.radii, s.steps) for s in o.stages]
    assert [r[:2] for r in report] == [(i, g.size) for i, g in enumerate(grids)]
    for i, g in enumerate(grids):
        forward = spark.read.parquet(f"{target}/stage={i}/forward")
        assert forward.count() == g.size * 40 and forward.where("c IS NULL").count() == 0
        assert spark.read.parquet(f"{target}/stage={i}/status").count() == g.size
    assert (tmp_path / "target/stage=1/transformed_matrices").exists()
    assert not (tmp_path / "target/stage=0/matrices").exists()
    written = estimate.render_job(spark, o, 2, 10, 7, str(tmp_path / "out"))
    report, found = rows(written, "z"), {int(p.name[2:]) for p in (tmp_path / "out").glob("z=*")}
    assert [r[0] for r in report] == list(range(40)) and len(found) >= 38
    assert all((n, ok) == ((70, True) if z in found else (0, False)) for z, n, ok in report)


def test_render_job_lists_targets_without_source(spark, random_stack, tmp_path):
    df, _ = random_stack
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    stacks.write_sections(df.where("z NOT IN (2, 3)").withColumn("z", F.col("z") + 3), source)
    o = job_options({**CONFIG, "source": source, "mask": "", "target": target})
    grid = Grid(10, 7, o.stages[0].radii, o.stages[0].steps)
    lut = block_sections(spark, grid, 6).withColumn("c", F.col("z") * 1.0)
    lut.write.parquet(f"{target}/stage=0/backward")
    report = rows(estimate.render_job(spark, o, 0, 10, 7, str(tmp_path / "out")), "z")
    assert [z for z, _, ok in report if ok] == [0, 1, 4, 5] and len(report) == 40


def test_mask_and_offsets_take_effect(spark, random_stack, tmp_path):
    df, _ = random_stack
    source, mask = str(tmp_path / "source"), str(tmp_path / "mask")
    shifted = df.withColumn("z", F.col("z") + 3)
    stacks.write_sections(shifted, source)
    keep = (F.col("x") > 0) | (F.col("z") % 5 > 0)
    stacks.write_sections(shifted.withColumn("v", F.when(keep, 1.0).otherwise(0.0)), mask)
    config = {**CONFIG, "source": source, "mask": mask, "options": CONFIG["options"][:1] + CONFIG["options"][2:]}
    o = job_options({**config, "target": str(tmp_path / "masked")})
    estimate.estimation_job(spark, o, 10, 7)
    keep = (F.col("x") > 0) | ((F.col("z") + 3) % 5 > 0)
    hidden = df.withColumn("v", F.when(keep, F.col("v")))
    want = estimate.estimate_stages(hidden, list(o.stages), 40, 10, 7, o.join_step)
    for i in range(2):
        got = rows(spark.read.parquet(f"{tmp_path}/masked/stage={i}/forward"), "bx", "by", "z")
        assert np.allclose([r[3] for r in got], [r[3] for r in rows(want[i].forward, "bx", "by", "z")])
    direct = tolerant_similarity(hidden, want[1].grid, 4, (1, 1), (3, 3))
    assert rows(want[1].sim, "bx", "by", "z1", "z2") == rows(direct, "bx", "by", "z1", "z2")
    assert estimate.stage_strategy(o.stages[0]) is None


def test_masked_pixels_are_made_once_for_all_stages(spark, random_stack, tmp_path, monkeypatch):
    df, _ = random_stack
    source, mask = str(tmp_path / "source"), str(tmp_path / "mask")
    stacks.write_sections(df.withColumn("z", F.col("z") + 3), source)
    stacks.write_sections(df.withColumns({"z": F.col("z") + 3, "v": F.lit(1.0)}), mask)
    given, config = [], {**CONFIG, "source": source, "options": CONFIG["options"][:1] + CONFIG["options"][2:]}
    monkeypatch.setattr(estimate, "estimate_stages", lambda pixels, *_, **__: given.append(pixels) or [])
    for name in (mask, ""):
        o = job_options({**config, "mask": name, "target": str(tmp_path / "target")})
        assert [bool(estimate.stage_strategy(s)) for s in o.stages] == [False, True]
        estimate.estimation_job(spark, o, 10, 7)
    plans = [g._jdf.queryExecution().executedPlan().toString() for g in given]
    assert all("Join" not in plan for plan in plans)
    want = rows(df, "z", "x", "y")
    assert all(rows(g, "z", "x", "y") == want for g in given)


def test_job_query_sees_coordinates_fall_at_any_section(spark, tmp_path, monkeypatch):
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, 64), i -> double(i + id))").alias("embedding"))
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    c = F.col("z") - F.when((F.col("bx") == 1) & (F.col("z") >= 256), 9.0).otherwise(0.0)
    forward = block_sections(spark, Grid(4, 4, (1, 1), (2, 2)), 300).withColumn("c", c)

    def written(_, options, *rest):
        for stage in range(2):
            forward.write.parquet(f"{options.target}/stage={stage}/forward")
            forward.withColumn("s", F.lit(1.0)).write.parquet(f"{options.target}/stage={stage}/matrices")

    monkeypatch.setattr(estimate, "estimation_job", written)
    found = rows(QUERIES["estimation_job"](spark, str(tmp_path)), "stage", "bx", "by")
    assert found == [(s, bx, by, 300, bx == 0, 300) for s in range(2) for bx in range(2) for by in range(2)]


def test_radius_without_blocks_is_an_error(spark, random_stack):
    df, _ = random_stack
    stage = job_options({**CONFIG, "options": [{"steps": [5, 5], "radii": [10, 7]}]}).stages[0]
    with pytest.raises(ValueError, match="no block"):
        estimate.estimate_stages(df, [stage], 40, 10, 7)


def test_packed_and_expression_stages_agree(spark, random_stack):
    df, _ = random_stack
    stages = list(job_options(CONFIG).stages[:1])
    packed, plain = (
        rows(estimate.estimate_stages(df, stages, 40, 10, 7, packed=p)[0].forward, "bx", "by", "z") for p in (True, False)
    )
    assert max(abs(a[3] - b[3]) for a, b in zip(packed, plain, strict=True)) < 1e-9


def test_other_similarity_and_transfer(spark, random_stack):
    df, _ = random_stack
    stages = list(job_options(CONFIG).stages[:2])
    results = estimate.estimate_stages(
        df, stages, 40, 10, 7, strategy=tolerant_strategy((1, 1), (1, 1)), transfer=interp_linear
    )
    assert [r.failed for r in results] == [0, 0]
    assert results[1].forward.where("c IS NULL").count() == 0
    grid = results[1].grid
    assert results[1].forward.count() == grid.size * 40
