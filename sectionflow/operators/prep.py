"""Filters, masks, downsampling and blur."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionflow.functions.chunks import SMALL, with_halo
from sectionflow.session import materialize

TILE = 64
SECTIONS = 16  # blurred together in a tile
HEAVY = 1000  # a value is common if more than one pixel in so many has it


def filter_range(df: DataFrame, start: int, stop: int) -> DataFrame:
    return df.where((F.col("z") >= start) & (F.col("z") < stop))


def band_filter(pairs: DataFrame, reach: int) -> DataFrame:
    return pairs.where(F.abs(F.col("z1") - F.col("z2")) <= reach)


def replace_value(pixels: DataFrame, old: float, new: float | None) -> DataFrame:
    """Values equal to ``old`` become ``new`` (None marks them missing)."""
    repl = F.lit(new).cast("double")
    return pixels.withColumn("v", F.when(F.col("v") == old, repl).otherwise(F.col("v")))


def mask_values(pixels: DataFrame, values: list[float]) -> DataFrame:
    """weight 0 where the value is in the set, else 1 (missing values get 1)."""
    hit = F.col("v").isNotNull() & F.col("v").isin(values)
    return pixels.withColumn("weight", F.when(hit, 0.0).otherwise(1.0))


def mask_value_table(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """As ``mask_values`` for a set too large for a literal list; ``values(v)``.

    A set that every executor can hold goes to the pixels.  Of a larger one only the
    values that many pixels have do, a bounded number; the rest meet by value, without
    the missing ones, so no task gets the pixels of one common value.
    """
    marks = materialize(values.where("v IS NOT NULL").select("v").distinct(), "mask-values")
    known = marks.count()
    if known <= SMALL:
        return _weighed(pixels, F.broadcast(marks))
    counts = pixels.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # at most HEAVY values can have that share of the pixels
    heavy = counts.where(F.col("n") * HEAVY > pixels.count()).select("v", F.lit(True).alias("_heavy"))
    told = pixels.join(F.broadcast(materialize(heavy, "heavy-values")), "v", "left")
    common = _weighed(told.where("_heavy").select(*pixels.columns), F.broadcast(marks.join(heavy, "v", "left_semi")))
    missing = told.where("_heavy IS NULL AND v IS NULL").select(*pixels.columns).withColumn("weight", F.lit(1.0))
    rest = told.where("_heavy IS NULL AND v IS NOT NULL").select(*pixels.columns)
    return common.unionByName(missing).unionByName(_weighed(rest, marks))


def _weighed(pixels: DataFrame, marks: DataFrame) -> DataFrame:
    met = pixels.join(marks.withColumn("_hit", F.lit(True)), "v", "left")
    return met.withColumn("weight", F.when(F.col("_hit"), 0.0).otherwise(1.0)).select(*pixels.columns, "weight")


def mask_missing(pixels: DataFrame) -> DataFrame:
    """weight 1 where present else 0; missing values become 0."""
    return pixels.withColumn("weight", F.when(F.col("v").isNull(), 0.0).otherwise(1.0)).withColumn(
        "v", F.coalesce("v", F.lit(0.0))
    )


def _coarse(level: int, width: int, height: int):
    side = 1 << level
    keys = ["z", F.expr(f"x div {side}").alias("x"), F.expr(f"y div {side}").alias("y")]
    whole = (F.col("x") < width // side * side) & (F.col("y") < height // side * side)
    return keys, whole


def downsample(pixels: DataFrame, level: int, width: int, height: int) -> DataFrame:
    """Mean of the present pixels of each 2^level cell; cut-off cells are dropped."""
    keys, whole = _coarse(level, width, height)
    return pixels.where(whole).groupBy(*keys).agg(F.avg("v").alias("v"))


def downsample_masked(pixels: DataFrame, level: int, width: int, height: int) -> DataFrame:
    """Image and weight reduced together, each by its own mean."""
    keys, whole = _coarse(level, width, height)
    return pixels.where(whole).groupBy(*keys).agg(F.avg("v").alias("v"), F.avg("weight").alias("weight"))


def gaussian_taps(sigma: float, accuracy: float = 1e-4) -> list[float]:
    """Half kernel w(0..k), cut where the tail falls below ``accuracy`` of the peak."""
    if sigma <= 0:
        return [1.0]
    k = math.ceil(sigma * math.sqrt(-2.0 * math.log(accuracy)))
    raw = [math.exp(-0.5 * (t / sigma) ** 2) for t in range(k + 1)]
    total = raw[0] + 2.0 * sum(raw[1:])
    return [w / total for w in raw]


def _blur_last(
    v: np.ndarray, there: np.ndarray, first: int, taps: list[float], extent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean along the last axis, which starts at position ``first``, and where a pixel is in reach.

    ``v`` is 0 where ``there`` is, and so are the means.  A pixel at an edge of the
    section also stands for the taps beyond it.
    """
    k, n = len(taps) - 1, v.shape[-1]
    sums = []
    for a in (v, there):
        total = np.zeros_like(a)
        for d in range(max(-k, 1 - n), min(k, n - 1) + 1):
            low, high = max(0, -d), min(n, n - d)
            total[..., low:high] += taps[abs(d)] * a[..., low + d : high + d]
        for edge in (0 - first, extent - 1 - first):
            if 0 <= edge < n:
                for i in range(max(0, edge - k + 1), min(n, edge + k)):
                    total[..., i] += sum(taps[abs(i - edge) + 1 :]) * a[..., edge]
        sums.append(total)
    reached = sums[1] > 0
    return np.where(reached, sums[0] / np.where(reached, sums[1], 1.0), 0.0), reached


def gaussian_blur(
    pixels: DataFrame, sigma: tuple[float, float], width: int, height: int, tile: int = TILE
) -> DataFrame:
    """Separable blur with clamped edges; missing pixels are left out of the mean.

    One shuffle: a few sections at a time are cut into tiles with a halo as wide as
    the kernel, and both passes run on the arrays of a tile, one shifted sum a tap.
    """
    taps = gaussian_taps(sigma[0]), gaussian_taps(sigma[1])
    reach = [len(t) - 1 for t in taps]
    sides = [max(tile, k) for k in reach]

    def kernel(group: pa.Table) -> pa.Table:
        z, x, y, tx, ty = (group.column(c).to_numpy() for c in ("z", "x", "y", "_tx", "_ty"))
        zs, zi = np.unique(z, return_inverse=True)
        x0, y0 = x.min(), y.min()
        at = (zi, y - y0, x - x0)
        there = np.zeros((len(zs), int(y.max() - y0) + 1, int(x.max() - x0) + 1))
        values, exists, known = np.zeros_like(there), np.zeros_like(there), group.column("v").is_valid().to_numpy()
        exists[at] = 1.0
        there[at] = known
        values[at] = np.where(known, group.column("v").to_numpy(), 0.0)
        if reach[0]:
            values, reached = _blur_last(values, there, int(x0), taps[0], width)
            there = exists * reached  # only rows of the table get a value
            values = np.where(there > 0, values, 0.0)
        if reach[1]:
            down = (np.swapaxes(a, 1, 2) for a in (values, there))
            values, there = (np.swapaxes(a, 1, 2) for a in _blur_last(*down, int(y0), taps[1], height))
        own = (x // sides[0] == tx) & (y // sides[1] == ty)
        v = pa.array(values[at][own], mask=there[at][own] == 0)
        return pa.table({"z": z[own], "x": x[own], "y": y[own], "v": v})

    cut = with_halo(pixels.select("z", "x", "y", "v"), sides[0], reach[0], reach[0], axis="x", chunk="_tx")
    cut = with_halo(cut, sides[1], reach[1], reach[1], axis="y", chunk="_ty")
    groups = cut.withColumn("_tz", F.expr(f"z div {SECTIONS}")).groupBy("_tz", "_tx", "_ty")
    return groups.applyInArrow(kernel, "z bigint, x bigint, y bigint, v double")


def explode_map(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """One row per entry of a map column, keeping the other columns."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias(key, value))
