"""Similarity that tolerates small in-plane shifts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionflow.functions.chunks import with_halo
from sectionflow.functions.grid import Grid
from sectionflow.functions.stats import TINY
from sectionflow.operators.grid import CELL, cells_to_blocks, with_cell
from sectionflow.operators.pairs import default_step

TILE = 32
GROUP = 1 << 14  # pixels of a group's sections in one tile, halo included, if sections are so small
ROUNDING = 1e-14  # of a tile's squares that running sums may be off, for each root of two counts


def _moved(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """a[y + dy, x + dx], zero where that lies outside."""
    h, w = a.shape[:2]
    out = np.zeros_like(a)
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def _window_sums(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Sums over closed windows of radius ``r`` along an axis, as differences of running sums."""
    n = a.shape[axis]
    total = np.empty((*a.shape[:axis], n + 1, *a.shape[axis + 1 :]))
    running, planes = np.moveaxis(total, axis, 0), np.moveaxis(a, axis, 0)
    running[0] = 0.0
    for i in range(n):  # a plane at a time; the axis is no longer than a tile
        np.add(running[i], planes[i], out=running[i + 1])
    at = np.arange(n)
    return total.take(np.minimum(at + r + 1, n), axis) - total.take(np.maximum(at - r, 0), axis)


def _box(a: np.ndarray, rx: int, ry: int) -> np.ndarray:
    """Sums of a[y, x, pair] over closed windows of the given radii; the cost does not depend on them."""
    return _window_sums(_window_sums(a, rx, 1), ry, 0)


class _Tile:
    """The pixels of one (chunk, tile) group as dense arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.zs, zi = np.unique(pdf["z"].to_numpy(), return_inverse=True)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        self.x = np.arange(x.min(), x.max() + 1)
        self.y = np.arange(y.min(), y.max() + 1)
        shape = (len(self.zs), len(self.y), len(self.x))
        self.values, self.mask = np.zeros(shape), np.zeros(shape)
        self.exists = np.zeros(shape, bool)
        at = (zi, y - self.y[0], x - self.x[0])
        v = pdf["v"].to_numpy()
        self.values[at] = np.nan_to_num(v)
        self.mask[at] = ~np.isnan(v)
        self.exists[at] = True
        # Correlation does not change when a section's mean goes, and sums do not cancel then.
        seen = np.maximum(self.mask.sum(axis=(1, 2), keepdims=True), 1.0)
        size = np.abs(self.values).sum(axis=(1, 2), keepdims=True) / seen
        for _ in range(2):  # again for what rounding left
            self.values = (self.values - self.values.sum(axis=(1, 2), keepdims=True) / seen) * self.mask
        # Of a variance below this only rounding is left, in the values or in the running sums.
        squares = (self.values**2).sum(axis=(1, 2), keepdims=True)
        self.floor = ROUNDING * np.sqrt(seen) * squares + TINY * size**2


def _best_scores(
    tile: _Tile, first: int, width: int, height: int, reach: int, offsets: tuple[int, int], radius: tuple[int, int]
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(larger, smaller, scores[pair, y, x]) for each distance between sections."""
    # Sections last: operations run along them, however few pixels a section has.
    values, mask = (np.ascontiguousarray(np.moveaxis(a, 0, -1)) for a in (tile.values, tile.mask))
    some = max(32, GROUP // mask[..., 0].size)  # sections at a time, so that arrays stay in a cache
    for lag in range(1, reach + 1):
        at = np.minimum(np.searchsorted(tile.zs, tile.zs - lag), len(tile.zs) - 1)
        hi = np.nonzero((tile.zs[at] == tile.zs - lag) & (tile.zs >= first))[0]
        if not len(hi):
            continue
        lo = at[hi]
        best = np.zeros((len(hi), len(tile.y), len(tile.x)))
        for i in range(0, len(hi), some):
            up, low = hi[i : i + some], lo[i : i + some]
            pairs = values[..., up], mask[..., up], tile.floor[up, 0, 0], values[..., low], mask[..., low], tile.floor[low, 0, 0]
            best[i : i + some] = np.moveaxis(_best_of_offsets(tile, *pairs, width, height, offsets, radius), -1, 0)
        yield hi, lo, best


def _best_of_offsets(
    tile: _Tile, upper: np.ndarray, upper_mask: np.ndarray, upper_floor: np.ndarray, b: np.ndarray, mb: np.ndarray,
    floor: np.ndarray, width: int, height: int, offsets: tuple[int, int], radius: tuple[int, int],
) -> np.ndarray:
    """scores[y, x, pair] of pairs whose pixels lie in [y, x, pair]; ``upper`` is read at the offsets."""
    (rx, ry), (mx, my) = radius, offsets
    fits_x = lambda p: (p >= rx) & (p <= width - rx)
    fits_y = lambda p: (p >= ry) & (p <= height - ry)
    bb, best = b * b, np.zeros_like(b)
    for dy in range(-my, my + 1):
        for dx in range(-mx, mx + 1):
            allowed = np.outer(fits_y(tile.y) & fits_y(tile.y + dy), fits_x(tile.x) & fits_x(tile.x + dx))
            if not allowed.any():
                continue
            a, ma = _moved(upper, dx, dy), _moved(upper_mask, dx, dy)
            parts = ma * mb, a * mb, b * ma, a * a * mb, bb * ma, a * b
            n, sa, sb, saa, sbb, sab = (_box(part, rx, ry) for part in parts)
            va, vb = n * saa - sa * sa, n * sbb - sb * sb
            root = np.sqrt(n)
            good = (va > root * upper_floor) & (vb > root * floor) & allowed[:, :, None]
            top = n * sab - sa * sb
            va, vb = np.where(good, va, 1.0), np.where(good, vb, 1.0)
            best = np.maximum(best, np.where(good, top / np.sqrt(va) / np.sqrt(vb), 0.0))
    return best


def _tiled(pixels: DataFrame, reach: int, halo: tuple[int, int], step: int, tile: tuple[int, int]) -> DataFrame:
    cut = with_halo(pixels.select("z", "x", "y", "v"), tile[0], halo[0], halo[0], axis="x", chunk="tx")
    cut = with_halo(cut, tile[1], halo[1], halo[1], axis="y", chunk="ty")
    return with_halo(cut, step, before=reach).groupBy("chunk", "tx", "ty")


def _setup(width, height, reach, offsets, radius, step, tile):
    radius = (min(radius[0], width - 1), min(radius[1], height - 1))
    halo = (radius[0] + offsets[0], radius[1] + offsets[1])
    sides = max(tile, halo[0]), max(tile, halo[1])
    # Of small sections many meet in a group, or what each group costs by itself would be most of the work.
    area = min(width, sides[0] + 2 * halo[0]) * min(height, sides[1] + 2 * halo[1])
    return radius, halo, step or max(default_step(reach), GROUP // area), sides


def tolerant_ncc(
    pixels: DataFrame,
    width: int,
    height: int,
    reach: int,
    offsets: tuple[int, int],
    radius: tuple[int, int],
    step: int | None = None,
    tile: int = TILE,
) -> DataFrame:
    """(z1, z2, x, y, s, weight): best windowed correlation over in-plane offsets.

    The larger section is read at (x + dx, y + dy), the smaller at (x, y); the
    window is closed and holds only pixels both sections have.  Negative and
    undefined correlations give 0.  Windows reaching past the section are not
    tried (one pixel past the far border is allowed), and pixels within the
    radius of a border carry no weight.  Missing pixels are NULL rows.

    One shuffle by (z chunk, tile), both with halo.  The work multiplies pixels
    by distances, offsets and window size, so it runs on arrays inside a group
    whose size the chunk and tile bound.
    """
    radius, halo, step, sides = _setup(width, height, reach, offsets, radius, step, tile)

    def scores(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, tx, ty = (int(pdf[c].iat[0]) for c in ("chunk", "tx", "ty"))
        group, parts = _Tile(pdf), [pd.DataFrame({"z1": [], "z2": [], "x": [], "y": [], "s": []})]
        core = np.outer(group.y // sides[1] == ty, group.x // sides[0] == tx)
        for hi, lo, best in _best_scores(group, chunk * step, width, height, reach, offsets, radius):
            p, y, x = np.nonzero(group.exists[hi] & group.exists[lo] & core)
            parts.append(
                pd.DataFrame(
                    {
                        "z1": group.zs[hi][p], "z2": group.zs[lo][p],
                        "x": group.x[x], "y": group.y[y], "s": best[p, y, x],
                    }
                )
            )
        return pd.concat(parts)

    inner = F.col("x").between(radius[0], width - radius[0] - 1) & F.col("y").between(
        radius[1], height - radius[1] - 1
    )
    return (
        _tiled(pixels, reach, halo, step, sides)
        .applyInPandas(scores, "z1 bigint, z2 bigint, x bigint, y bigint, s double")
        .withColumn("weight", F.when(inner, 1.0))
    )


def block_average(values: DataFrame, grid: Grid, keys: tuple[str, ...] = ("z1", "z2"), value: str = "s") -> DataFrame:
    """Weighted mean per block over closed windows; blocks without weight vanish."""
    usable = values.where(F.col(value).isNotNull() & F.col("weight").isNotNull())
    cells = (
        with_cell(usable, grid, closed=True)
        .groupBy(*CELL, *keys)
        .agg(F.sum(F.col("weight") * F.col(value)).alias("_wv"), F.sum("weight").alias("_w"))
    )
    return _mean(cells_to_blocks(cells), keys, value)


def _mean(sums: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    return (
        sums.groupBy("bx", "by", *keys)
        .agg(F.sum("_wv").alias("_wv"), F.sum("_w").alias("_w"))
        .where("_w > 0")
        .select("bx", "by", *keys, (F.col("_wv") / F.col("_w")).alias(value))
    )


def tolerant_similarity(
    pixels: DataFrame,
    grid: Grid,
    reach: int,
    offsets: tuple[int, int],
    radius: tuple[int, int],
    step: int | None = None,
    tile: int = TILE,
) -> DataFrame:
    """sim(bx, by, z1, z2, s): ``block_average`` of ``tolerant_ncc``.

    Block sums are taken inside each group, so scores of single pixels never
    leave it.
    """
    width, height = grid.width, grid.height
    radius, halo, step, sides = _setup(width, height, reach, offsets, radius, step, tile)

    def spans(axis: str, at: np.ndarray, core: np.ndarray, r: int) -> list[tuple[int, np.ndarray]]:
        count, gr, gs, extent = grid.axis(axis)
        usable = at[core & (at >= r) & (at < extent - r)]
        if not len(usable):
            return []
        first, last = max(0, -(-(int(usable[0]) - 2 * gr) // gs)), min(count - 1, int(usable[-1]) // gs)
        spans_ = ((b, usable[(usable >= b * gs) & (usable <= b * gs + 2 * gr)] - at[0]) for b in range(first, last + 1))
        return [(b, i) for b, i in spans_ if len(i)]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, tx, ty = (int(pdf[c].iat[0]) for c in ("chunk", "tx", "ty"))
        group, parts = _Tile(pdf), [pd.DataFrame({"bx": [], "by": [], "z1": [], "z2": [], "_wv": [], "_w": []})]
        across = spans("x", group.x, group.x // sides[0] == tx, radius[0])
        down = spans("y", group.y, group.y // sides[1] == ty, radius[1])
        if not (across and down):
            return parts[0]
        for hi, lo, best in _best_scores(group, chunk * step, width, height, reach, offsets, radius):
            weight = (group.exists[hi] & group.exists[lo]).astype(float)
            scored = best * weight
            for by, yi in down:
                rows, rows_w = scored[:, yi].sum(axis=1), weight[:, yi].sum(axis=1)
                for bx, xi in across:
                    parts.append(
                        pd.DataFrame(
                            {
                                "bx": bx, "by": by, "z1": group.zs[hi], "z2": group.zs[lo],
                                "_wv": rows[:, xi].sum(axis=1), "_w": rows_w[:, xi].sum(axis=1),
                            }
                        )
                    )
        return pd.concat(parts)

    partial = _tiled(pixels, reach, halo, step, sides).applyInPandas(
        sums, "bx bigint, by bigint, z1 bigint, z2 bigint, _wv double, _w double"
    )
    return _mean(partial, ("z1", "z2"), "s")


def tolerant_strategy(offsets: tuple[int, int], radius: tuple[int, int]):
    """A similarity for ``block_matrices`` based on the tolerant correlation."""

    def strategy(pixels: DataFrame, grid: Grid, reach: int) -> DataFrame:
        return tolerant_similarity(pixels, grid, reach, offsets, radius)

    return strategy
