import math
from dataclasses import replace

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sectionflow.operators import infer
from sectionflow.operators.infer import InferOptions

SIM = "bx bigint, by bigint, z1 bigint, z2 bigint, s double"
LUT = "bx bigint, by bigint, z bigint, c double"
N, REACH = 40, 3
BASE = InferOptions(iterations=3, multiplier_iterations=2, comparison_range=REACH)


def brute(pairs, start, o):
    """The rounds written out with plain loops; returns coordinates per round."""
    n, reach = len(start), o.comparison_range
    edges = [(i, j, s) for a, b, s in pairs for i, j in ((a, b), (b, a))]
    c, m, out = np.array(start, float), np.ones(n), [np.array(start, float)]

    def curve(chosen):
        num, den = np.zeros(reach + 2), np.zeros(reach + 2)
        for i, j, s in chosen:
            d = abs(c[i] - c[j])
            k = math.floor(d)
            for b, w in ((k, 1 - (d - k)), (k + 1, d - k)):
                if b <= reach and w > 0:
                    num[b] += w * s * m[i] * m[j]
                    den[b] += w
        f = [1.0]
        for b in range(1, reach + 1):
            f.append(min(f[-1], num[b] / den[b]) if den[b] else f[-1])
        return f

    for _ in range(o.iterations):
        if o.window_radius < 0:
            shared = curve(edges)
            curves = [shared] * n
        else:
            curves = [curve([e for e in edges if abs(e[0] - z) <= o.window_radius]) for z in range(n)]

        def value(z, d, curves=curves):
            k = min(math.floor(d), reach)
            lo, hi = curves[z][k], curves[z][min(k + 1, reach)]
            return lo + (hi - lo) * min(d - k, 1)

        for _ in range(o.multiplier_iterations):
            num, den = np.zeros(n), np.zeros(n)
            for i, j, s in edges:
                x = s * m[j]
                num[i] += value(i, abs(c[i] - c[j])) * x
                den[i] += x * x
            m = np.where(den > 0, (1 - o.multiplier_weight) * num / np.where(den > 0, den, 1) + o.multiplier_weight, m)
        votes = [[] for _ in range(n)]
        for i, j, s in edges:
            sp, f = s * m[i] * m[j], curves[i]
            for k in range(reach):
                if f[k] >= sp > f[k + 1]:
                    votes[i].append(c[j] + np.sign(c[i] - c[j]) * (k + (f[k] - sp) / (f[k] - f[k + 1])) - c[i])
        c = c + o.shift_proportion * np.array([np.mean(v) if v else 0.0 for v in votes])
        c = (1 - o.coordinate_weight) * c + o.coordinate_weight * np.array(start)
        c = (1 - o.grid_weight) * c + o.grid_weight * np.arange(n)
        if o.monotone:
            order = np.argsort(c, kind="stable") if o.reorder else np.arange(n)
            at = np.arange(n) * o.min_thickness
            c[order] = np.maximum.accumulate(c[order] - at) + at
        if o.regularization == "BORDER":
            c = start[0] + (c - c[0]) * (start[-1] - start[0]) / (c[-1] - c[0])
        out.append(c.copy())
    return out


@pytest.fixture(scope="module")
def noisy():
    """Two blocks: decaying similarity of unevenly spaced sections, with noise."""
    rng = np.random.default_rng(9)
    blocks = {}
    for b in range(2):
        true = np.cumsum(rng.uniform(0.3, 1.7, N))
        pairs = [
            (z + d, z, float(np.exp(-0.3 * (true[z + d] - true[z])) * rng.uniform(0.9, 1.1)))
            for z in range(N)
            for d in range(1, REACH + 1)
            if z + d < N
        ]
        blocks[b] = [p for p in pairs if rng.random() > 0.05]
    return blocks


def tables(spark, blocks, start):
    sim = spark.createDataFrame([(b, 0, *p) for b, ps in blocks.items() for p in ps], SIM)
    lut = spark.createDataFrame([(b, 0, z, float(c)) for b in blocks for z, c in enumerate(start)], LUT)
    return sim, lut


VARIANTS = {
    "border": {},
    "none": {"regularization": "NONE", "coordinate_weight": 0.2, "grid_weight": 0.1},
    "local": {"window_radius": 4},
    "reorder": {"reorder": True, "regularization": "NONE", "shift_proportion": 1.5, "min_thickness": 0.01},
    "thick": {"min_thickness": 0.6, "regularization": "NONE"},
    "free_border": {"monotone": False},
    "reorder_border": {"reorder": True, "shift_proportion": 1.5, "min_thickness": 0.01},
    "free": {"monotone": False, "regularization": "NONE", "multiplier_iterations": 0},
    "many_multipliers": {"multiplier_iterations": 6, "multiplier_weight": 0.3},
}


@pytest.mark.parametrize("name", VARIANTS)
def test_rounds_equal_plain_loops(spark, noisy, name):
    o = replace(BASE, **VARIANTS[name])
    start = np.arange(N) + 0.2 * np.sin(np.arange(N))
    sim, lut = tables(spark, noisy, start)
    # A small step cuts the stack into many chunks.
    trace = infer.infer_trace(sim, lut, o, step=1).collect()
    assert len(trace) == 2 * N * (o.iterations + 1)
    want = {b: brute(noisy[b], start, o) for b in noisy}
    worst = max(abs(r.c - want[r.bx][r.iter][r.z]) for r in trace)
    assert worst < 1e-9


def exact(spacing, reach=REACH):
    z = np.cumsum(spacing)
    return [
        (i + d, i, float(np.exp(-0.2 * (z[i + d] - z[i])))) for i in range(N) for d in range(1, reach + 1) if i + d < N
    ]


def test_constant_spacing_is_a_fixed_point(spark):
    sim, lut = tables(spark, {0: exact(np.ones(N))}, np.arange(N))
    got = infer.infer_coords(sim, lut, BASE)
    assert got.agg(F.max(F.abs(F.col("c") - F.col("z")))).first()[0] < 1e-6


def test_distortion_shrinks_and_ends_hold(spark):
    spacing = 1 + 0.6 * np.sin(np.arange(N) / 4)
    true = np.cumsum(spacing)
    true = (true - true[0]) / (true[-1] - true[0]) * (N - 1)
    sim, lut = tables(spark, {0: exact(spacing, 10)}, np.arange(N))
    o = replace(BASE, iterations=8, comparison_range=10)
    c = np.array([r[3] for r in rows(infer.infer_coords(sim, lut, o), "z")])
    assert abs(c[0]) < 1e-12 and abs(c[-1] - (N - 1)) < 1e-9
    assert (np.diff(c) > 0).all()
    assert np.abs(c - true).max() < 0.5 * np.abs(np.arange(N) - true).max()


def test_failed_blocks(spark):
    pairs = exact(np.ones(N))
    blocks = {0: pairs, 1: pairs[:1], 2: pairs}
    sim, lut = tables(spark, blocks, np.arange(N))
    lut = lut.withColumn("c", F.when((F.col("bx") != 2) | (F.col("z") != 5), F.col("c")))
    got = infer.infer_coords(sim, lut, replace(BASE, iterations=1))
    nulls = dict(tuple(r) for r in got.groupBy("bx").agg(F.count("c")).collect())
    assert nulls == {0: N, 1: 0, 2: 0}
    assert got.count() == 3 * N


def test_curve_fills_empty_bins(spark):
    edges = spark.createDataFrame(
        [(0, 0, 0, 1.0, 0.8), (0, 0, 1, 1.0, 0.6), (0, 0, 2, 3.0, 0.9), (0, 0, 3, 9.0, 0.1)],
        "bx bigint, by bigint, z bigint, d double, sp double",
    )
    assert infer.decay_curve(edges, 4).first()["f"] == [1.0, 0.7, 0.7, 0.7, 0.7]
    local = dict(tuple(r) for r in infer.decay_curve_local(edges, 2, 0).select("z", "f").collect())
    assert local[0] == [1.0, 0.8, 0.8] and local[1] == [1.0, 0.6, 0.6]


def test_settling_in_small_chunks(spark):
    rng = np.random.default_rng(11)
    c = np.arange(N) + rng.normal(scale=2.0, size=N)
    rows_ = [(0, 0, z, float(c[z]), 1.0, float(z)) for z in range(N)]
    state = spark.createDataFrame(rows_, "bx bigint, by bigint, z bigint, c double, m double, c0 double")
    at = np.arange(N) * 0.1
    want = np.maximum.accumulate(c - at) + at
    want = (want - want[0]) * (N - 1) / (want[-1] - want[0])
    for step in (1, 7, 4096):
        got = infer._settle(state, replace(BASE, min_thickness=0.1), step)
        assert np.abs(np.array([r[3] for r in rows(got, "z")]) - want).max() < 1e-9


@pytest.mark.parametrize("reorder", [False, True])
def test_one_table_a_round_and_earlier_ones_deleted(spark, noisy, reorder):
    from pathlib import Path

    from sectionflow.session import scratch_dir

    folder = Path(scratch_dir(spark)) / "sectionflow" / spark.sparkContext.applicationId

    def left():
        return set(folder.glob("coordinates-*"))

    sim, lut = tables(spark, noisy, range(N))
    options = replace(BASE, iterations=4, reorder=reorder)
    before = left()
    got = infer.infer_coords(sim, lut, options)
    assert len(left() - before) == 1  # the last one, which the result reads
    assert got.where("c IS NULL").count() == 0
    before = left()
    infer.infer_trace(sim, lut, options).count()
    assert len(left() - before) == options.iterations + 1
