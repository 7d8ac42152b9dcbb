"""Resampling stacks, matrices and volumes by coordinate tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.functions.chunks import checked_broadcast, owned, with_halo
from sectionflow.functions.grid import Grid, explode_range
from sectionflow.session import materialize

TILE = 64
STEP = 256
GROUP = ("chunk", "tx", "ty", "part")
RUN = 256  # sections of a run
CORNERS = ("c00", "c10", "c01", "c11")


def _term(value: Column, weight: Column) -> Column:
    """weight * value, where a value without weight may be missing."""
    return F.when(weight == 0, 0.0).otherwise(weight * value)


def _lattice_range(axis: str, cell: str, grid: Grid, scale: int, extent: int) -> tuple[Column, Column]:
    """First and last of the pixels whose left (upper) block centre is block ``cell``.

    Border cells also take the pixels outside the outermost centres.
    """
    count, radius, step, _ = grid.axis(axis)
    start = (F.col(cell) * step + radius) * scale
    first = F.when(F.col(cell) == 0, 0).otherwise(start)
    last = F.when(F.col(cell) == count - 1, extent - 1).otherwise(start + step * scale - 1)
    return first.cast("bigint"), F.least(last, F.lit(extent - 1)).cast("bigint")


def _lattice_pixels(axis: str, cell: str, grid: Grid, scale: int, extent: int) -> Column:
    """explode the pixels of ``_lattice_range``."""
    return explode_range(*_lattice_range(axis, cell, grid, scale, extent))


def _fraction(axis: str, cell: str, grid: Grid, scale: int) -> Column:
    count, radius, step, _ = grid.axis(axis)
    local = (F.col(axis) / F.lit(float(scale)) - radius) / F.lit(float(step))
    return F.least(F.greatest(local, F.lit(0.0)), F.lit(float(count - 1))) - F.col(cell)


def lattice_cells(lut: DataFrame) -> DataFrame:
    """cells(z, i, j, c00, c10, c01, c11): the corners of each lattice cell, named by their step in x and y.

    Cell (i, j) starts at the centre of block (i, j); those of the last column or row lack the corners beyond.
    """
    corner = F.explode(
        F.array(
            *(
                F.struct(
                    (F.col("bx") - i).alias("i"), (F.col("by") - j).alias("j"), F.lit(f"c{i}{j}").alias("k")
                )
                for i in (0, 1)
                for j in (0, 1)
            )
        )
    )
    return (
        lut.select("z", "bx", "by", "c", corner.alias("q"))
        .select("z", "q.*", "c")
        .where("i >= 0 AND j >= 0")
        .groupBy("z", "i", "j")
        .agg(*(F.max(F.when(F.col("k") == n, F.col("c"))).alias(n) for n in CORNERS))
    )


def _position() -> Column:
    """Position of a pixel from the corners of its cell and its fractions fx, fy."""
    x1, y1 = F.col("fx"), F.col("fy")
    return (
        _term(F.col("c00"), (1 - x1) * (1 - y1))
        + _term(F.col("c10"), x1 * (1 - y1))
        + _term(F.col("c01"), (1 - x1) * y1)
        + _term(F.col("c11"), x1 * y1)
    )


def _upsampled(cells: DataFrame, grid: Grid, width: int, height: int, scale: int) -> DataFrame:
    """coords(z, x, y, p) of the pixels of lattice cells."""
    pixels = (
        cells.withColumn("y", _lattice_pixels("y", "j", grid, scale, height))
        .withColumn("x", _lattice_pixels("x", "i", grid, scale, width))
        .withColumns({"fx": _fraction("x", "i", grid, scale), "fy": _fraction("y", "j", grid, scale)})
    )
    return pixels.select("z", "x", "y", _position().alias("p"))


def upsample_lut(lut: DataFrame, grid: Grid, width: int, height: int, scale: int = 1) -> DataFrame:
    """coords(z, x, y, p): block coordinates spread over width x height pixels.

    Bilinear between block centres, constant beyond the outermost ones; pixel X
    sits at ``(X / scale - radius) / step`` on the block grid.  The four corners
    of a lattice cell meet in one row per section; its pixels are generated from
    that row, so only coordinate rows are shuffled.
    """
    return _upsampled(lattice_cells(lut), grid, width, height, scale)


def required_sections(coords: DataFrame) -> DataFrame:
    """(target, source): the sections each target is mixed from."""
    ends = F.explode(F.array(F.floor("p").cast("bigint"), F.ceil("p").cast("bigint")))
    return coords.where("p IS NOT NULL").select(F.col("z").alias("target"), ends.alias("source")).distinct()


def _keyed(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumn("tx", F.expr(f"x div {tile}")).withColumn("ty", F.expr(f"y div {tile}"))


def chunk_copies(lut: DataFrame, sections: int, step: int = STEP) -> DataFrame:
    """(chunk, copies): into how many parts the targets of a z chunk are split.

    Where coordinates pile up (a plateau, say) most targets may read one chunk.
    A chunk asked for ``k`` times as often as the average gets about ``k`` copies,
    so copies add up to at most twice the number of chunks.
    """
    usable = lut.where(F.col("c").between(0.0, float(sections - 1)))
    asked = usable.groupBy(F.expr(f"cast(floor(c) AS bigint) div {step}").alias("chunk")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = lut.agg((F.count(F.lit(1)) * F.lit(step) / F.lit(sections)).alias("_fair"))
    fair = F.greatest(F.lit(1.0), F.lit(total.first()[0] or 1.0))
    return asked.select("chunk", F.greatest(F.lit(1), F.round(F.col("_n") / fair)).cast("bigint").alias("copies"))


def section_steps(
    pixels: DataFrame, step: int = STEP, tile: int = TILE, copies: DataFrame | None = None
) -> DataFrame:
    """(chunk, tx, ty, part, z, x, y, v0, has0, v1, has1): a pixel and the one above.

    A row exists where either does.  One shuffle, by bounded (chunk, tile) groups;
    ``copies`` repeats the groups of busy chunks.
    """
    spread = with_halo(pixels, step, after=1)
    if copies is None:
        spread = spread.withColumn("part", F.lit(0).cast("bigint"))
    else:
        last = F.coalesce("copies", F.lit(1)) - 1
        spread = spread.join(copies, "chunk", "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
        )
    column = Window.partitionBy(*GROUP, "x", "y").orderBy("z")
    near = (
        _keyed(spread, tile)
        .repartition(*GROUP)
        .withColumn("zn", F.lead("z").over(column))
        .withColumn("vn", F.lead("v").over(column))
        .withColumn("zp", F.lag("z").over(column))
    )
    follows = F.coalesce(F.col("zn") == F.col("z") + 1, F.lit(False))
    alone_above = F.coalesce(F.col("zp") != F.col("z") - 1, F.lit(True))
    none = F.lit(None).cast("double")
    here = F.struct(
        F.col("z").alias("z"), F.col("v").alias("v0"), F.lit(True).alias("has0"),
        F.when(follows, F.col("vn")).alias("v1"), follows.alias("has1"),
    )
    before = F.struct(
        (F.col("z") - 1).alias("z"), none.alias("v0"), F.lit(False).alias("has0"),
        F.col("v").alias("v1"), F.lit(True).alias("has1"),
    )
    rows = F.explode(F.when(alone_above, F.array(before, here)).otherwise(F.array(here)))
    return (
        near.select(*GROUP, "x", "y", rows.alias("r"))
        .select(*GROUP, "x", "y", "r.*")
        .where((F.col("z") >= 0) & owned(step))
    )


def resample(
    pixels: DataFrame,
    coords: DataFrame,
    sections: int,
    renormalise: bool = True,
    step: int = STEP,
    tile: int = TILE,
    copies: DataFrame | None = None,
) -> DataFrame:
    """(z, x, y, v): source values read at position p of each target pixel.

    Linear between the two sections around p.  With ``renormalise`` an absent
    section is left out of the mean; without it the result is missing.  A pixel
    that is present as missing always makes the result missing, and so does p
    outside [0, sections - 1].  ``copies`` (see ``chunk_copies``) splits chunks
    that many targets read.
    """
    usable = F.when(F.col("p").between(0.0, float(sections - 1)), F.col("p"))
    targets = coords.select(F.col("z").alias("target"), "x", "y", usable.alias("p"))
    # Targets without a source keep apart from each other: negative keys match nothing.
    at = F.coalesce(F.floor("p").cast("bigint"), -1 - F.col("target"))
    targets = _keyed(targets.withColumn("z", at), tile)
    targets = targets.withColumn("chunk", F.expr(f"if(z < 0, z, z div {step})"))
    part = F.lit(0).cast("bigint")
    if copies is not None:
        targets = targets.join(copies, "chunk", "left")
        part = F.col("target") % F.coalesce("copies", F.lit(1))
    # Hashed like the sources, so that the join cannot settle for the chunk alone.
    found = targets.withColumn("part", part).repartition(*GROUP).join(
        section_steps(pixels, step, tile, copies), [*GROUP, "z", "x", "y"], "left"
    )
    up = F.col("p") - F.col("z")
    if renormalise:
        w0, w1 = F.when(F.col("has0"), 1 - up).otherwise(0.0), F.when(F.col("has1"), up).otherwise(0.0)
    else:
        w0, w1 = 1 - up, up
    value = F.when(w0 + w1 > 0, (_term(F.col("v0"), w0) + _term(F.col("v1"), w1)) / (w0 + w1))
    return found.select(F.col("target").alias("z"), "x", "y", value.alias("v"))


def kept_targets(cells: DataFrame, have: DataFrame, grid: Grid, width: int, height: int, scale: int, rows: int) -> DataFrame:
    """(z): targets any pixel of which lies next to a section of ``have(source)``.

    One pixel of each cell tells for nearly all targets; all pixels are looked at only
    for those where no such pixel does.  ``rows`` bounds the rows of ``cells``.
    """

    def near(coords: DataFrame) -> DataFrame:
        ends = F.explode(F.array(F.floor("p").cast("bigint"), F.ceil("p").cast("bigint"))).alias("source")
        found = coords.select("z", ends).join(have.withColumn("there", F.lit(True)), "source", "left")
        return found.groupBy("z").agg(F.max(F.coalesce("there", F.lit(False))).alias("hit"))

    (x0, x1), (y0, y1) = (_lattice_range(a, c, grid, scale, n) for a, c, n in (("x", "i", width), ("y", "j", height)))
    one = cells.withColumns({"x": x0, "y": y0}).where((x0 <= x1) & (y0 <= y1))
    one = one.withColumns({"fx": _fraction("x", "i", grid, scale), "fy": _fraction("y", "j", grid, scale)})
    told = materialize(near(one.select("z", _position().alias("p"))), "targets")
    sure, open_ = told.where("hit").select("z"), told.where("NOT hit").select("z")
    if open_.isEmpty():
        return sure
    rest = cells.join(checked_broadcast(open_, rows), "z", "left_semi")
    return sure.union(near(_upsampled(rest, grid, width, height, scale)).where("hit").select("z"))


def routed_cells(
    cells: DataFrame, grid: Grid, width: int, height: int, sections: int, scale: int = 1, step: int = STEP, tile: int = TILE
) -> DataFrame:
    """Lattice cells copied to every (chunk, tx, ty) whose pixels they may read.

    A cell's positions lie between those of its corners, so it goes to the chunks in
    between (a hair more, for rounding).  Cells that may have a pixel without a position
    in the stack also go to chunk -1 - q, q the chunk of the target itself.
    """
    (x0, x1), (y0, y1) = (_lattice_range(a, c, grid, scale, n) for a, c, n in (("x", "i", width), ("y", "j", height)))
    known = [F.coalesce(c, *CORNERS) for c in CORNERS]
    low, high = F.least(*known), F.greatest(*known)
    hair = 1e-9 * (F.abs(low) + F.abs(high) + 1)
    top = float(sections - 1)
    # Corners beyond the last column or row have no weight and no value.
    last_x, last_y = F.col("i") == grid.nx - 1, F.col("j") == grid.ny - 1
    missing = F.col("c00").isNull() | (F.col("c10").isNull() & ~last_x) | (F.col("c01").isNull() & ~last_y)
    missing = missing | (F.col("c11").isNull() & ~last_x & ~last_y)
    outside = missing | (low - hair < 0) | (high + hair > top)
    first = F.floor(F.greatest(low - hair, F.lit(0.0)) / step).cast("bigint")
    last = F.floor(F.least(high + hair, F.lit(top)) / step).cast("bigint")
    none = F.array().cast("array<bigint>")
    chunks = F.concat(
        F.when(first <= last, F.sequence(first, last)).otherwise(none),
        F.when(outside, F.array(F.expr(f"-1 - z div {step}"))).otherwise(none),
    )
    spread = cells.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 <= x1 AND y0 <= y1")
    spread = spread.withColumn("chunk", F.explode(chunks))
    spread = spread.withColumn("tx", F.explode(F.expr(f"sequence(x0 div {tile}, x1 div {tile})")))
    return spread.withColumn("ty", F.explode(F.expr(f"sequence(y0 div {tile}, y1 div {tile})")))


def _paint_kernel(grid: Grid, sections: int, scale: int, step: int, tile: int):
    """Pixels of the cells that came to a (chunk, tile), read from the sections that did."""
    gx, gy = grid.axis("x"), grid.axis("y")

    def fractions(at: np.ndarray, cell: int, axis: tuple[int, int, int, int]) -> np.ndarray:
        count, radius, stride, _ = axis
        return np.minimum(np.maximum((at / float(scale) - radius) / float(stride), 0.0), float(count - 1)) - cell

    def term(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.where(weight == 0, 0.0, weight * value)

    def paint(key: tuple, sources: pa.Table, cells: pa.Table) -> pa.Table:
        chunk, tx, ty = (k.as_py() for k in key[:3])
        parts = []
        here = np.full((step + 1, tile, tile), np.nan)
        exists = np.zeros(here.shape, bool)
        if len(sources) and len(cells):
            z, x, y = (sources.column(c).to_numpy() for c in ("z", "x", "y"))
            at = z - chunk * step, y - ty * tile, x - tx * tile
            here[at], exists[at] = sources.column("v").to_numpy(zero_copy_only=False), True
        ids = np.stack([cells.column(c).to_numpy() for c in ("i", "j")], axis=1)
        kinds, kind = np.unique(ids, axis=0, return_inverse=True)
        targets = cells.column("z").to_numpy()
        corners = np.stack([cells.column(c).to_numpy(zero_copy_only=False) for c in CORNERS], axis=1).astype(float)
        bounds = np.stack([cells.column(c).to_numpy() for c in ("x0", "x1", "y0", "y1")], axis=1)
        for k, (i, j) in enumerate(kinds.tolist()):
            own = np.flatnonzero(kind.reshape(-1) == k)
            x0, x1, y0, y1 = bounds[own[0]].tolist()
            xs = np.arange(max(x0, tx * tile), min(x1, tx * tile + tile - 1) + 1)
            ys = np.arange(max(y0, ty * tile), min(y1, ty * tile + tile - 1) + 1)
            wx, wy = fractions(xs, i, gx)[None, :], fractions(ys, j, gy)[:, None]
            weights = (1 - wx) * (1 - wy), wx * (1 - wy), (1 - wx) * wy, wx * wy
            # a few targets at a time, so that arrays stay of a tile's size
            for begin in range(0, len(own), step):
                some = own[begin : begin + step]
                c = corners[some][:, :, None, None]
                p = term(c[:, 0], weights[0]) + term(c[:, 1], weights[1]) + term(c[:, 2], weights[2]) + term(c[:, 3], weights[3])
                usable = (p >= 0.0) & (p <= float(sections - 1))
                floor = np.floor(np.where(usable, p, 0.0)).astype(np.int64)
                t, yi, xi = np.nonzero(usable & (floor // step == chunk) if chunk >= 0 else ~usable)
                if not len(t):
                    continue
                x, y = xs[xi], ys[yi]
                v = np.full(len(t), np.nan)
                if chunk >= 0:
                    f = floor[t, yi, xi]
                    up, low = p[t, yi, xi] - f, f - chunk * step
                    dy, dx = y - ty * tile, x - tx * tile
                    w0 = np.where(exists[low, dy, dx], 1 - up, 0.0)
                    w1 = np.where(exists[low + 1, dy, dx], up, 0.0)
                    total = term(here[low, dy, dx], w0) + term(here[low + 1, dy, dx], w1)
                    v = np.divide(total, w0 + w1, out=v, where=w0 + w1 > 0)
                parts.append((targets[some][t], x, y, v))
        columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        z, x, y, v = columns
        return pa.table({"z": z, "x": x, "y": y, "v": pa.array(v, mask=np.isnan(v))})

    return paint


def render(
    pixels: DataFrame,
    lut: DataFrame,
    grid: Grid,
    width: int,
    height: int,
    sections: int,
    scale: int = 1,
    step: int = STEP,
    tile: int = TILE,
) -> DataFrame:
    """The stack resampled at the positions of a backward coordinate table.

    Targets none of whose source sections exist are dropped.

    Target pixels are made late: what is sent to the pixels of a (z chunk, tile) are
    lattice cells, a row each, and their pixels come into being where the sources are.
    Source pixels are shuffled once, with a halo of one section, and chunks that many
    targets read are split into parts (see ``chunk_copies``).
    """
    cells = materialize(lattice_cells(lut.select("bx", "by", "z", "c")), "cells")
    blocks = cells.select("z", F.col("c00").alias("c"))
    rows = blocks.count()
    have = pixels.select(F.col("z").alias("source")).where(F.col("z").between(-1, sections)).distinct()
    kept = kept_targets(cells, checked_broadcast(have, sections + 2), grid, width, height, scale, rows)
    copies = checked_broadcast(chunk_copies(blocks, sections, step), -(-sections // step))
    asked = routed_cells(cells.join(checked_broadcast(kept, rows), "z", "left_semi"), grid, width, height, sections, scale, step, tile)
    asked = asked.join(copies, "chunk", "left").withColumn("part", F.col("z") % F.coalesce("copies", F.lit(1)))
    last = F.coalesce("copies", F.lit(1)) - 1
    given = with_halo(pixels.select("z", "x", "y", "v").where(F.col("z").between(0, sections - 1)), step, after=1)
    given = given.join(copies, "chunk", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    paint = _paint_kernel(grid, sections, scale, step, tile)
    return (
        _keyed(given, tile)
        .select(*GROUP, "z", "x", "y", "v")
        .groupBy(*GROUP)
        .cogroup(asked.select(*GROUP, "z", "i", "j", *CORNERS, "x0", "x1", "y0", "y1").groupBy(*GROUP))
        .applyInArrow(paint, "z bigint, x bigint, y bigint, v double")
    )


def transform_roundtrip(
    forward: DataFrame, backward: DataFrame, grid: Grid, width: int, height: int, sections: int
) -> DataFrame:
    """Forward coordinates (one pixel per block) rendered by the backward table."""
    source = forward.select("z", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("c").alias("v"))
    return render(source, backward, grid, width, height, sections)


def warp_matrix(matrix: DataFrame, lut: DataFrame) -> DataFrame:
    """Matrix entries read at (c(z1), c(z2)) of each block, bilinear.

    Entries that need a missing neighbour are absent.  The four neighbours of a
    matrix cell meet in one row, which then finds the runs of sections that fall
    into the cell, so work follows the band, not the square of the stack.  A run is the
    sections of one floor within ``RUN`` sections, one row; its sections come into being
    last, so a plateau that holds most sections is spread by pairs of runs.
    """
    corner = F.explode(
        F.array(
            *(
                F.struct(
                    (F.col("z1") - i).alias("a"), (F.col("z2") - j).alias("b"), F.lit(f"s{i}{j}").alias("k")
                )
                for i in (0, 1)
                for j in (0, 1)
            )
        )
    )
    names = ["s00", "s10", "s01", "s11"]
    cells = (
        matrix.where("s IS NOT NULL")
        .select("bx", "by", "s", corner.alias("q"))
        .select("bx", "by", "s", "q.*")
        .groupBy("bx", "by", "a", "b")
        .agg(*(F.max(F.when(F.col("k") == n, F.col("s"))).alias(n) for n in names))
    )
    runs = lut.where("c IS NOT NULL").withColumn("f", F.floor("c").cast("bigint"))
    entry = F.struct("z", (F.col("c") - F.col("f")).alias("w"))
    runs = runs.groupBy("bx", "by", "f", F.expr(f"z div {RUN}").alias("part")).agg(F.collect_list(entry).alias("run"))
    runs = materialize(runs, "runs")
    rows = runs.select("bx", "by", F.col("f").alias("a"), F.col("part").alias("part_a"), F.col("run").alias("run_a"))
    cols = runs.select("bx", "by", F.col("f").alias("b"), F.col("part").alias("part_b"), F.col("run").alias("run_b"))
    met = cells.join(rows, ["bx", "by", "a"]).join(cols, ["bx", "by", "b"])
    if not runs.groupBy("bx", "by", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # a plateau: its entries come into being in as many tasks as it has pairs of parts
        met = met.repartition("bx", "by", "a", "b", "part_a", "part_b")
    spread = met.withColumn("p", F.explode("run_a")).withColumn("q", F.explode("run_b"))
    spread = spread.select(
        "bx", "by", *names, F.col("p.z").alias("z1"), F.col("q.z").alias("z2"), F.col("p.w").alias("fa"), F.col("q.w").alias("fb")
    )
    fa, fb = F.col("fa"), F.col("fb")
    value = (
        _term(F.col("s00"), (1 - fa) * (1 - fb))
        + _term(F.col("s10"), fa * (1 - fb))
        + _term(F.col("s01"), (1 - fa) * fb)
        + _term(F.col("s11"), fa * fb)
    )
    return spread.select("bx", "by", "z1", "z2", value.alias("s")).where("s IS NOT NULL")


def warp_volume(pixels: DataFrame, coords: DataFrame, sections: int) -> DataFrame:
    """Each pixel column read at its own positions ``coords(z, x, y, p)``."""
    return resample(pixels, coords, sections, renormalise=False)
