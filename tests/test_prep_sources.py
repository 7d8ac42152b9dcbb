import math
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT, rows
from pyspark.sql import functions as F

from sectionflow.operators import prep
from sectionflow.session import materialize, scratch_dir
from sectionflow.sources import stacks

PX = "z bigint, x bigint, y bigint, v double"


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(0, 0, 0, float("nan")), (0, 1, 0, 2.0)], PX)
    assert rows(stacks.as_pixels(df).select("v"), "x") == [(None,), (2.0,)]


def test_load_range_is_rebased_and_pushed_down(spark, tmp_path, random_stack):
    df, _ = random_stack
    path = str(tmp_path / "stack")
    stacks.write_sections(df, path)
    got = stacks.load_sections(spark, path, 10, 14)
    assert sorted(r[0] for r in got.select("z").distinct().collect()) == [0, 1, 2, 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(z" in plan
    back = stacks.load_sections(spark, path)
    assert rows(back, "z", "x", "y") == rows(df, "z", "x", "y")
    assert stacks.load_sections(spark, path, 3, 4, keep_path=True).where("path LIKE '%z=3%'").count() == 70


def test_several_sections_per_folder(spark, tmp_path, random_stack):
    df, _ = random_stack
    path = str(tmp_path / "grouped")
    stacks.write_sections(df, path, per_folder=16)
    got = stacks.load_sections(spark, path, 15, 17)
    assert rows(got.select("z").distinct(), "z") == [(0,), (1,)] and got.count() == 140
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "z_to" in plan.split("PartitionFilters")[1].split("]")[0]
    assert rows(stacks.load_sections(spark, path), "z", "x", "y") == rows(df, "z", "x", "y")


def test_many_sections_share_folders(spark, tmp_path, monkeypatch):
    df = spark.range(7, 207).selectExpr("id AS z", "id % 2 AS x", "0L AS y", "double(id) AS v")
    for folders, most in ((16, 16), (1000, 200)):
        monkeypatch.setattr(stacks, "FOLDERS", folders)
        path = tmp_path / str(folders)
        stacks.write_sections(df, str(path))
        assert len(list(path.rglob("*.parquet"))) <= most + 8  # a run of sections may be cut between tasks
        assert len([p for p in path.rglob("*") if p.is_dir() and list(p.glob("*.parquet"))]) <= most
        assert rows(stacks.load_sections(spark, str(path), 0, 300), "z", "x", "y") == rows(df, "z", "x", "y")


def test_folders_of_small_sections_follow_their_pixels():
    assert stacks.sections_per_folder(51_282, 64) * 64 >= stacks.FOLDER_PIXELS
    assert -(-51_282 // stacks.sections_per_folder(51_282, 64)) < 51_282 // 100
    assert stacks.sections_per_folder(40, 10**7) == 1
    assert -(-(10**7) // stacks.sections_per_folder(10**7, 64)) <= stacks.FOLDERS


def test_masks_are_not_broadcast(random_stack):
    df, _ = random_stack
    plan = stacks.load_masked(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_write_report_lists_lost_sections(spark, tmp_path, random_stack):
    df, _ = random_stack
    path = str(tmp_path / "partial")
    stacks.write_sections(df.where("z != 7 AND NOT (z = 9 AND x = 0)"), path, single=True)
    report = stacks.write_report(df, spark.read.parquet(path))
    assert rows(report.where("NOT ok").select("z", "pixels"), "z") == [(7, 0), (9, 63)]


def test_unpack_is_row_major(spark):
    df = spark.createDataFrame([(3, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])], "z int, px array<float>")
    got = stacks.unpack_pixels(df, 3)
    assert rows(got, "v") == [(3, i % 3, i // 3, float(i)) for i in range(6)]
    assert got.where(stacks.linear_index(3) != F.col("v")).count() == 0


def test_masks(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, None), (0, 2, 0, 5.0)], PX)
    assert rows(prep.mask_missing(df).select("v", "weight"), "x") == [(1.0, 1.0), (0.0, 0.0), (5.0, 1.0)]
    assert rows(prep.mask_values(df, [5.0]).select("weight"), "x") == [(1.0,), (1.0,), (0.0,)]
    table = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert rows(prep.mask_value_table(df, table).select("weight"), "x") == [(1.0,), (1.0,), (0.0,)]
    assert rows(prep.replace_value(df, 5.0, None).select("v"), "x") == [(1.0,), (None,), (None,)]
    assert rows(prep.replace_value(df, 5.0, 6.0).select("v"), "x") == [(1.0,), (None,), (6.0,)]
    mask = spark.createDataFrame([(0, 1, 0, 0.25)], PX)
    assert rows(stacks.load_masked(df, mask).select("weight"), "x") == [(1.0,), (0.25,), (1.0,)]
    assert stacks.load_masked(df).where("weight != 1").count() == 0


def test_channels(spark):
    one = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 2.0)], PX)
    two = spark.createDataFrame([(0, 1, 0, 3.0)], PX)
    packed = stacks.pack_channels(stacks.stack_channels({"a": one, "b": two}), ["a", "b"])
    assert rows(packed, "x") == [(0, 0, 0, 1.0, None), (0, 1, 0, 2.0, 3.0)]


def test_downsample_drops_cut_off_cells(spark, random_stack):
    df, v = random_stack
    got = {r[:3]: r[3] for r in map(tuple, prep.downsample(df, 1, 10, 7).collect())}
    assert {k[2] for k in got} == {0, 1, 2}
    for (z, x, y), s in got.items():
        cell = v[z, 2 * y : 2 * y + 2, 2 * x : 2 * x + 2]
        assert (s is None) if np.isnan(cell).all() else abs(s - np.nanmean(cell)) < 1e-12
    both = prep.downsample_masked(prep.mask_missing(df), 1, 10, 7)
    for z, x, y, s, w in both.where("z = 5").collect():
        cell = v[z, 2 * y : 2 * y + 2, 2 * x : 2 * x + 2]
        assert abs(w - (~np.isnan(cell)).mean()) < 1e-12
        assert abs(s - np.nan_to_num(cell).mean()) < 1e-12


def blur_brute(v, axis, taps):
    k, n = len(taps) - 1, v.shape[axis]
    out = np.empty_like(v)
    moved, target = np.moveaxis(v, axis, 0), np.moveaxis(out, axis, 0)
    for i in range(n):
        num, den = 0.0, 0.0
        for t in range(-k, k + 1):
            row = moved[min(max(i + t, 0), n - 1)]
            num = num + taps[abs(t)] * np.nan_to_num(row)
            den = den + taps[abs(t)] * ~np.isnan(row)
        with np.errstate(invalid="ignore"):
            target[i] = num / den
    return out


@pytest.mark.parametrize("tile", [64, 6])
@pytest.mark.parametrize("sigma", [(1.0, 0.5), (0.0, 0.7), (3.0, 2.0)])
def test_blur(random_stack, tile, sigma):
    df, v = random_stack
    want = v[:2]
    for axis, s in ((2, sigma[0]), (1, sigma[1])):
        taps = prep.gaussian_taps(s)
        if len(taps) > 1:
            want = blur_brute(want, axis, taps)
    got = prep.gaussian_blur(df.where("z < 2"), sigma, 10, 7, tile).collect()
    assert len(got) == 140
    assert all((r.v is None) == np.isnan(want[r.z, r.y, r.x]) for r in got)
    assert all(abs(r.v - want[r.z, r.y, r.x]) < 1e-9 for r in got if r.v is not None)


def test_blur_keeps_to_the_rows_there_are(spark):
    df = spark.createDataFrame([(0, 0, 0, None), (0, 9, 0, 2.0), (40, 1, 0, 3.0), (40, 2, 0, None)], "z long, x long, y long, v double")
    blurred = prep.gaussian_blur(df, (0.5, 0.0), 10, 1).withColumn("v", F.round("v", 9))
    assert rows(blurred, "z", "x") == [(0, 0, 0, None), (0, 9, 0, 2.0), (40, 1, 0, 3.0), (40, 2, 0, 3.0)]


def test_taps():
    taps = prep.gaussian_taps(1.0)
    assert len(taps) == math.ceil(math.sqrt(-2 * math.log(1e-4))) + 1
    assert abs(taps[0] + 2 * sum(taps[1:]) - 1) < 1e-12


def test_scratch_follows_the_checkpoint_setting(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    assert scratch_dir(spark) in df.inputFiles()[0]


def test_explode_map_and_ranges(spark, random_stack):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0})], "k int, m map<string,double>")
    assert rows(prep.explode_map(df, "m"), "key") == [(1, "a", 1.0), (1, "b", 2.0)]
    px, _ = random_stack
    assert prep.filter_range(px, 3, 5).select("z").distinct().count() == 2
    assert stacks.extent(px) == (40, 10, 7)


def test_clear_scratch_removes_intermediate_tables(tmp_path):
    code = f"""
import os, sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from sectionflow import configure, materialize
from sectionflow.session import clear_scratch
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
materialize(configure(spark).range(3), "t")
folder = os.path.join({str(tmp_path)!r}, "sectionflow", spark.sparkContext.applicationId)
assert os.listdir(folder)
clear_scratch(spark)
assert not os.path.exists(folder)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_mask_by_a_large_set_of_values(spark, monkeypatch):
    """Common values, missing ones and a set that is not sent to everyone."""
    from sectionflow.operators import prep

    data = [(z, x, 0, None if (z + x) % 11 == 0 else float(5 if x % 3 else (7 * z + x) % 40)) for z in range(30) for x in range(30)]
    pixels = spark.createDataFrame(data, "z long, x long, y long, v double")
    values = spark.createDataFrame([(float(i),) for i in range(0, 40, 5)] + [(None,), (5.0,)], "v double")
    want = sorted((z, x, v, 0.0 if v is not None and v % 5 == 0 else 1.0) for z, x, _, v in data if v is not None)
    for small, heavy in ((10**6, 1000), (0, 1000), (0, 3)):
        monkeypatch.setattr(prep, "SMALL", small)
        monkeypatch.setattr(prep, "HEAVY", heavy)
        got = prep.mask_value_table(pixels, values)
        assert got.columns == ["z", "x", "y", "v", "weight"]
        got = [(r.z, r.x, r.v, r.weight) for r in got.collect()]
        assert len(got) == len(data) and all(w == 1.0 for _, _, v, w in got if v is None)
        assert sorted(r for r in got if r[2] is not None) == want
