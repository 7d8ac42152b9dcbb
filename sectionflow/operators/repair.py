"""Filling holes and inverting coordinate tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.functions.chunks import CHUNK, checked_broadcast, owned, with_halo
from sectionflow.functions.stats import present
from sectionflow.session import materialize

EDGE, DIAGONAL = 1.0, 0.5
TILE, PASSES, DEPTH = 64, 8, 64


def _shifted(a: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """a[..., y + dy, x + dx], zero outside."""
    h, w = a.shape[-2:]
    padded = np.pad(a, ((0, 0), (1, 1), (1, 1)))
    return padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def _fill_pass(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every hole with a present neighbour gets the weighted mean of the last pass."""
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    weights = [EDGE if dx == 0 or dy == 0 else DIAGONAL for dx, dy in around]
    den = sum(w * _shifted(known.astype(float), *d) for w, d in zip(weights, around, strict=True))
    num = sum(w * _shifted(values, *d) for w, d in zip(weights, around, strict=True))
    ready = ~known & (den > 0)
    return np.where(ready, num / np.where(ready, den, 1.0), values), known | ready


def _fill_kernel(tile: int):
    """Passes inside one (sections, tile) group; returns the cells the tile owns."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tx"].iat[0]), int(pdf["ty"].iat[0])
        zs, zi = np.unique(pdf["z"].to_numpy(), return_inverse=True)
        x, y, v = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["v"].to_numpy()
        shape = (len(zs), y.max() - y.min() + 1, x.max() - x.min() + 1)
        at = (zi, y - y.min(), x - x.min())
        # Positions without a row lie outside the section and never get a value.
        values, known, cell = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        values[at], known[at], cell[at] = np.nan_to_num(v), ~np.isnan(v), True
        for _ in range(PASSES):
            if known[cell].all():
                break
            filled, reached = _fill_pass(values, known)
            values, known = np.where(cell, filled, values), reached & cell
        own = (x // tile == tx) & (y // tile == ty)
        out = pdf.loc[own, ["z", "x", "y"]]
        return out.assign(v=np.where(known[at], values[at], np.nan)[own])

    return fill


_TILE = ("zs", "tx", "ty")


def _tile_of(tile: int) -> list[Column]:
    return [F.expr(f"{c} div {n}").alias(k) for k, c, n in zip(_TILE, ("z", "x", "y"), (DEPTH, tile, tile), strict=True)]


def _open_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """(zs, tx, ty, zset, holes): tiles with holes, the sections in which they have some, and how many."""
    found = cells.where("v IS NULL").groupBy(*_tile_of(tile))
    return found.agg(F.collect_set("z").alias("zset"), F.count(F.lit(1)).alias("holes"))


def _ring(tile: int) -> int:
    return -(-PASSES // tile)


def _around(tiles: DataFrame, tile: int) -> DataFrame:
    """(zs, tx, ty, zset) of these tiles and all that the passes of a round look into."""
    steps = range(-_ring(tile), _ring(tile) + 1)
    near = [F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty")) for dx in steps for dy in steps]
    spread = tiles.select("zs", "zset", F.explode(F.array(*near)).alias("n")).select("zs", "n.*", "zset")
    sets = F.array_distinct(F.flatten(F.collect_list("zset"))).alias("zset")
    return spread.groupBy(*_TILE).agg(sets)


def _in_tiles(cells: DataFrame, tiles: DataFrame, tile: int, rows: int, inside: bool = True) -> DataFrame:
    """The cells in sections of the ``rows`` listed tiles, or all others."""
    listed = checked_broadcast(tiles.select(*_TILE, "zset"), rows * DEPTH)
    met = cells.select("*", *_tile_of(tile)).join(listed, list(_TILE), "inner" if inside else "left")
    there = F.coalesce(F.array_contains("zset", F.col("z")), F.lit(False))
    return met.where(there if inside else ~there).select("z", "x", "y", "v")


def _fill_round(active: DataFrame, tiles: DataFrame, tile: int, rows: int) -> DataFrame:
    """All cells that the listed tiles own, after ``PASSES`` passes; ``active`` has them and those around."""
    spread = with_halo(active, tile, PASSES, PASSES, axis="x", chunk="tx")
    spread = with_halo(spread, tile, PASSES, PASSES, axis="y", chunk="ty").withColumn("zs", F.expr(f"z div {DEPTH}"))
    met = spread.join(checked_broadcast(tiles.select(*_TILE, "zset"), rows * DEPTH), list(_TILE)).where(F.array_contains("zset", F.col("z")))
    filled = met.select("z", "x", "y", "v", *_TILE).groupBy(*_TILE)
    filled = filled.applyInPandas(_fill_kernel(tile), "z bigint, x bigint, y bigint, v double")
    return filled.withColumn("v", present(F.col("v")))


def fill_holes(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Fill NULL cells of every section from their present neighbours, pass by pass.

    Each pass reads the previous one; sections without any value stay missing.  A
    pass looks one cell sideways, so on tiles with a halo of ``PASSES`` cells that
    many passes are exact without exchanging anything.  A round of passes is one
    shuffle of the open tiles, those that have holes, and the cells around them;
    its result is a table of these tiles only, and the next round reads those still
    open, their neighbours and nothing else.  Rounds go on while holes get filled.

    ``cells`` is read three times and never copied: to find open tiles, to fetch
    them, and as the part of the result that has no holes.  Cells that are dear to make
    should be written first.
    """
    cells = cells.select("z", "x", "y", "v")
    first = tiles = materialize(_open_tiles(cells, tile), "open-tiles")
    holes, rows = tiles.agg(F.sum("holes"), F.count(F.lit(1))).first()
    if not rows:
        return cells
    opened, around = rows, (2 * _ring(tile) + 1) ** 2
    active, parts = _in_tiles(cells, _around(tiles, tile), tile, around * rows), []
    while True:
        result = materialize(_fill_round(active, tiles, tile, rows), "filled")
        before, holes = holes, result.where("v IS NULL").count()
        if not holes or holes == before:
            return _in_tiles(cells, first, tile, opened, inside=False).unionByName(reduce(DataFrame.unionByName, [*parts, result]))
        left = materialize(_open_tiles(result, tile), "open-tiles")
        still = left.count()
        parts.append(_in_tiles(result, left, tile, still, inside=False))
        near = _around(left, tile)
        rest = _in_tiles(active, tiles, tile, rows, inside=False)  # neighbours that had no holes
        active = materialize(_in_tiles(rest.unionByName(result), near, tile, around * still), "active")
        tiles, rows = left, still


def fill_lut(lut: DataFrame) -> DataFrame:
    """``fill_holes`` on the block grid of every section."""
    cells = lut.select("z", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("c").alias("v"))
    return fill_holes(cells).select(
        F.col("x").alias("bx"), F.col("y").alias("by"), "z", F.col("v").alias("c")
    )


def invert_lut(lut: DataFrame, step: int = CHUNK, sections: int | None = None) -> DataFrame:
    """Per block and integer i, the position where the coordinates reach i.

    Linear between neighbouring sections, NULL beyond the first and last
    coordinate; falling or flat stretches give nothing and the smallest position
    wins.  Neighbours come from a window over (block, chunk), not a whole column,
    and a steep stretch is followed only as far as there are sections.
    """
    if sections is None:
        sections = (lut.agg(F.max("z")).first()[0] or 0) + 1
    ahead = Window.partitionBy("bx", "by", "chunk").orderBy("z")
    segments = (
        with_halo(lut.select("bx", "by", "z", "c"), step, after=1)
        .withColumn("z1", F.lead("z").over(ahead))
        .withColumn("c1", F.when(F.col("z1") == F.col("z") + 1, F.lead("c").over(ahead)))
        .where(owned(step) & F.col("c").isNotNull())
    )
    rising = (F.col("c1") > F.col("c")) & F.col("c1").isNotNull()
    first, last = F.ceil("c"), F.when(rising, F.ceil("c1") - 1).otherwise(F.floor("c"))
    hits = (
        segments.withColumn("first", F.greatest(first, F.lit(0)).cast("bigint"))
        .withColumn("last", F.least(last, F.lit(sections - 1)).cast("bigint"))
        .where("first <= last")
        .withColumn("i", F.explode(F.sequence("first", "last")))
    )
    along = F.when(rising, (F.col("i") - F.col("c")) / (F.col("c1") - F.col("c"))).otherwise(0.0)
    found = hits.select("bx", "by", F.col("i").alias("z"), (F.col("z") + along).alias("c"))
    found = found.groupBy("bx", "by", "z").agg(F.min("c").alias("c"))
    return lut.select("bx", "by", "z").join(found, ["bx", "by", "z"], "left")
