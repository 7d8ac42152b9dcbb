"""Iterative estimation of section coordinates from banded similarities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.functions.chunks import CHUNK, row_rank, running_max, with_halo
from sectionflow.session import delete_path, written

BLOCK = ["bx", "by"]
STEP = 512


@dataclass(frozen=True)
class InferOptions:
    """Estimation options; defaults follow the usual template values."""

    iterations: int = 100
    shift_proportion: float = 0.6
    multiplier_iterations: int = 10
    multiplier_weight: float = 0.1
    coordinate_weight: float = 0.0
    grid_weight: float = 0.0
    min_thickness: float = 1e-8
    comparison_range: int = 20
    regularization: str = "BORDER"
    monotone: bool = True
    reorder: bool = False
    window_radius: int = -1


def both_ways(sim: DataFrame, reach: int) -> DataFrame:
    """edges(bx, by, z, zr, s): each usable in-band pair seen from both ends."""
    usable = sim.where((F.col("z1") - F.col("z2") <= reach) & F.col("s").isNotNull())
    ends = F.array(
        F.struct(F.col("z1").alias("z"), F.col("z2").alias("zr")),
        F.struct(F.col("z2").alias("z"), F.col("z1").alias("zr")),
    )
    return usable.select(*BLOCK, "s", F.explode(ends).alias("e")).select(*BLOCK, "e.z", "e.zr", "s")


def _bins(edges: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Sums of weight and weight * similarity per distance bin, split linearly."""
    low = F.floor("d").cast("bigint")
    two = F.array(
        F.struct(low.alias("bin"), (1 - (F.col("d") - low)).alias("w")),
        F.struct((low + 1).alias("bin"), (F.col("d") - low).alias("w")),
    )
    return (
        edges.select(*keys, "sp", F.explode(two).alias("e"))
        .select(*keys, "sp", "e.*")
        .where((F.col("bin") <= reach) & (F.col("w") > 0))
        .groupBy(*keys, "bin")
        .agg(F.sum(F.col("w") * F.col("sp")).alias("ws"), F.sum("w").alias("w"))
    )


def _to_curve(bins: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """curve(keys, f array of reach + 1): 1 at distance 0, never rising.

    Empty bins take the value before them.
    """
    values = F.map_from_entries(F.collect_list(F.struct("bin", F.col("ws") / F.col("w"))))
    falling = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.lit(reach).cast("bigint")),
        F.array(F.lit(1.0)),
        lambda acc, k: F.concat(acc, F.array(F.least(F.element_at(acc, -1), F.try_element_at("fs", k)))),
    )
    return bins.groupBy(*keys).agg(values.alias("fs")).select(*keys, falling.alias("f"))


def _nearby_bins(bins: DataFrame, radius: int) -> DataFrame:
    """Bins of a section and of all within ``radius`` of it.

    Sums per section come first, so what is spread to neighbouring sections is at
    most reach + 1 rows each.
    """
    receivers = F.sequence(F.greatest(F.col("z") - radius, F.lit(0)), F.col("z") + radius)
    return (
        bins.withColumn("z", F.explode(receivers))
        .groupBy(*BLOCK, "z", "bin")
        .agg(F.sum("ws").alias("ws"), F.sum("w").alias("w"))
    )


def decay_curve(edges: DataFrame, reach: int) -> DataFrame:
    """One curve per block from edges(bx, by, d, sp)."""
    return _to_curve(_bins(edges, BLOCK, reach), BLOCK, reach)


def decay_curve_local(edges: DataFrame, reach: int, radius: int) -> DataFrame:
    """One curve per block and section, from edges within ``radius`` sections."""
    keys = [*BLOCK, "z"]
    curves = _to_curve(_nearby_bins(_bins(edges, keys, reach), radius), keys, reach)
    return curves.join(edges.select(*keys).distinct(), keys, "left_semi")


def curve_rows(curves: DataFrame) -> DataFrame:
    """curve arrays as rows (..., d, f)."""
    keys = [c for c in curves.columns if c != "f"]
    return curves.select(*keys, F.posexplode("f").alias("d", "f")).withColumn("d", F.col("d").cast("bigint"))


def _numbers(batch: pa.RecordBatch, row: int, *names: str) -> list[np.ndarray]:
    """Array columns of one row; NULL gives an empty array."""
    cells = (batch.column(name)[row] for name in names)
    return [c.values.to_numpy(zero_copy_only=False) if c.is_valid else np.zeros(0) for c in cells]


def _place(edges: list[np.ndarray], zs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of both edge ends (z, zr) among the sorted sections ``zs``, and similarity."""
    z, zr, s = edges
    if not len(zs) or not len(z):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j = (np.minimum(np.searchsorted(zs, e), len(zs) - 1) for e in (z, zr))
    known = (zs[i] == z) & (zs[j] == zr)
    return i[known], j[known], s[known]


def _bin_kernel(reach: int, step: int, by_section: bool):
    """Distance-bin sums of the edges that the chunk of a row owns."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, (bx, by, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in _GROUP))):
                zs, c, m = _numbers(batch, row, "z", "c", "m")
                edges = _numbers(batch, row, "ez", "er", "es")
                own = (edges[0] >= chunk * step) & (edges[0] < (chunk + 1) * step)
                i, j, s = _place([e[own] for e in edges], zs)
                if not len(i):
                    continue
                d, sp = np.abs(c[i] - c[j]), s * m[i] * m[j]
                low = np.floor(d)
                place = np.tile(zs[i] - chunk * step if by_section else np.zeros(len(i), np.int64), 2)
                bins, w = np.concatenate([low, low + 1]), np.concatenate([1 - (d - low), d - low])
                kept = (bins <= reach) & (w > 0)
                key, w, sp = (place * (reach + 1) + bins.astype(np.int64))[kept], w[kept], np.tile(sp, 2)[kept]
                total, weight = np.bincount(key, w * sp), np.bincount(key, w)
                used = np.flatnonzero(weight)
                at = [np.full(len(used), x) for x in (bx, by)]
                parts.append([*at, chunk * step + used // (reach + 1), used % (reach + 1), total[used], weight[used]])
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns, [*BLOCK, "z", "bin", "ws", "w"])

    return sums


def _shifts(o: InferOptions, zs: np.ndarray, c: np.ndarray, m: np.ndarray, edges: list[np.ndarray], curves: np.ndarray, local: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers after all steps of a round, and shift votes, of the sections ``zs``.

    ``curves`` has a row for the whole block, or one for each section of ``local``.
    """
    reach, lam, n = o.comparison_range, o.multiplier_weight, len(zs)
    shift = np.full(n, np.nan)
    # Curves as a table section x distance; one shared row when global.
    f = np.full((1 if local is None else n, reach + 1), np.nan)
    if local is None:
        f[:] = curves
    else:
        at = np.minimum(np.searchsorted(zs, local), n - 1)
        there = zs[at] == local
        f[at[there]] = curves[there]
    i, j, s = _place(edges, zs)
    row = i if local is not None else np.zeros_like(i)
    known = ~np.isnan(f[row, 0])
    i, j, s, row = i[known], j[known], s[known], row[known]
    d = np.abs(c[i] - c[j])
    k = np.minimum(np.floor(d), reach).astype(int)
    low, high = f[row, k], f[row, np.minimum(k + 1, reach)]
    fd = low + (high - low) * np.minimum(d - k, 1.0)
    linked = np.bincount(i, minlength=n) > 0
    for _ in range(o.multiplier_iterations):
        x = s * m[j]
        num, den = np.bincount(i, fd * x, n), np.bincount(i, x * x, n)
        raw = np.divide(num, den, out=np.ones(n), where=den > 0)
        m = np.where(linked, (1 - lam) * raw + lam, m)
    sp = s * m[i] * m[j]
    # The curve never rises: counting values not below sp finds the segment.
    above = (f[row] >= sp[:, None]).sum(axis=1)
    on = (above > 0) & (above <= reach)
    i, j, sp, row, k = i[on], j[on], sp[on], row[on], above[on] - 1
    high, low = f[row, k], f[row, k + 1]
    away = k + (high - sp) / (high - low)
    vote = c[j] + np.sign(c[i] - c[j]) * away - c[i]
    votes = np.bincount(i, minlength=n)
    return m, np.divide(np.bincount(i, vote, n), votes, out=shift, where=votes > 0)


def _round_kernel(o: InferOptions, step: int):
    """Multiplier steps, shift votes and update of one chunk, on a halo wide enough for all of them.

    Each multiplier step looks ``comparison_range`` sections sideways, so with a
    halo of that width per step the owned sections come out exact and no data has
    to be exchanged between steps.  A chunk leaves as one row, with what the others
    need of it to settle.
    """
    eps = _spacing(o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (bx, by, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in _GROUP))):
                zs, c, m, c0 = _numbers(batch, row, "z", "c", "m", "c0")
                edges, (flat,) = _numbers(batch, row, "ez", "er", "es"), _numbers(batch, row, "f")
                own = (zs >= chunk * step) & (zs < (chunk + 1) * step)
                if not own.any():
                    continue
                shift = np.zeros(len(zs))
                if len(edges[0]) and len(flat):
                    local = _numbers(batch, row, "fz")[0] if o.window_radius >= 0 else None
                    m, shift = _shifts(o, zs, c, m, edges, flat.reshape(-1, o.comparison_range + 1), local)
                zs, c, m, c0, shift = (a[own] for a in (zs, c, m, c0, np.nan_to_num(shift)))
                c = c + o.shift_proportion * shift
                c = (1 - o.coordinate_weight) * c + o.coordinate_weight * c0
                c = (1 - o.grid_weight) * c + o.grid_weight * zs
                low = np.maximum.accumulate(c - zs * eps) if eps is not None else c
                ends = float(low.max()), float(c[0]), float(c0[0]), int(zs[-1]), float(c[-1]), float(c0[-1])
                out.append([bx, by, chunk, zs, low, m, c0, *ends])
            if out:
                columns = [pa.array(list(v), t) for v, t in zip(zip(*out), _PACKED_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, list(_PACKED))

    return run


def _spacing(o: InferOptions) -> float | None:
    """Least distance of neighbouring coordinates if they are kept in order, else None."""
    return o.min_thickness if o.monotone and not o.reorder else None


def _reordered(state: DataFrame, eps: float) -> DataFrame:
    """Monotone along the rank of the coordinates instead of along z."""
    ranked = row_rank(state, BLOCK, "c", "z", "_rank").withColumn("_low", F.col("c") - F.col("_rank") * eps)
    scanned = running_max(ranked, BLOCK, "_rank", "_low", "_high", CHUNK)
    return scanned.select(*BLOCK, "z", (F.col("_high") + F.col("_rank") * eps).alias("c"), "m", "c0")


def _settle(state: DataFrame, o: InferOptions, step: int = CHUNK) -> DataFrame:
    """Monotone coordinates, c(z) = max over j <= z of (c(j) - j eps) + z eps, and
    the affine map per block that puts the first and last section back.

    One summary row per (block, chunk) gives a chunk everything it needs from the
    others, so the coordinate rows are shuffled once.
    """
    if o.monotone and o.reorder:
        state = _reordered(state, o.min_thickness)
    eps = o.min_thickness if o.monotone and not o.reorder else None
    low = F.col("c") - F.col("z") * eps if eps is not None else F.col("c")
    state = state.withColumn("_low", low).withColumn("_chunk", F.expr(f"z div {step}"))
    order = Window.partitionBy(*BLOCK).orderBy("_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = (
        state.groupBy(*BLOCK, "_chunk")
        .agg(
            F.max("_low").alias("_top"),
            F.min_by(F.struct("c", "c0"), "z").alias("_head"),
            F.max_by(F.struct("z", "c", "c0"), "z").alias("_tail"),
        )
        .select(
            *BLOCK,
            "_chunk",
            F.max("_top").over(before).alias("_carry"),
            F.max("_top").over(whole).alias("_peak"),
            F.first("_head").over(whole).alias("_head"),
            F.last("_tail").over(whole).alias("_tail"),
        )
        # Hashed by chunk again, or the join would gather whole blocks.
        .repartition(*BLOCK, "_chunk")
    )
    state = state.join(summary, [*BLOCK, "_chunk"])
    c, last = F.col("c"), F.col("_tail.c")
    if eps is not None:
        inside = Window.partitionBy(*BLOCK, "_chunk").orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
        c = F.greatest(F.max("_low").over(inside), F.col("_carry")) + F.col("z") * eps
        last = F.col("_peak") + F.col("_tail.z") * eps
    if o.regularization == "BORDER":
        span = last - F.col("_head.c")
        factor = F.when(span != 0, (F.col("_tail.c0") - F.col("_head.c0")) / span).otherwise(1.0)
        c = F.col("_head.c0") + (c - F.col("_head.c")) * factor
    return state.select(*BLOCK, "z", c.alias("c"), "m", "c0")


_GROUP = [*BLOCK, "chunk"]

# A chunk as one row.  r: running maximum of c - z * eps if coordinates are kept in order, else
# c; the rest is what other chunks need: the highest r, the first and the last section.
_PACKED = {
    "bx": "bigint", "by": "bigint", "chunk": "bigint", "z": "array<bigint>", "r": "array<double>", "m": "array<double>",
    "c0": "array<double>", "top": "double", "head_c": "double", "head_c0": "double", "tail_z": "bigint", "tail_c": "double",
    "tail_c0": "double",
}
_KINDS = {"bigint": pa.int64(), "double": pa.float64()}
_PACKED_TYPES = [_KINDS.get(t) or pa.list_(_KINDS[t[6:-1]]) for t in _PACKED.values()]


def _packed(rows: DataFrame, step: int) -> DataFrame:
    """Chunks of coordinate rows (bx, by, z, c, m, c0) that need no settling."""
    ordered = F.array_sort(F.collect_list(F.struct("z", "c", "m", "c0")))
    found = rows.groupBy(*BLOCK, F.expr(f"z div {step}").alias("chunk")).agg(ordered.alias("a"))
    none = F.lit(None).cast("double")
    arrays = [F.col(f"a.{c}").alias(n) for c, n in (("z", "z"), ("c", "r"), ("m", "m"), ("c0", "c0"))]
    ends = [none.alias(c) if t == "double" else F.lit(None).cast(t).alias(c) for c, t in list(_PACKED.items())[7:]]
    return found.select(*_GROUP, *arrays, *ends)


def _settled(state: DataFrame, o: InferOptions, voted: bool) -> DataFrame:
    """Chunks (bx, by, chunk, z, c, m, c0) with coordinates in order and ends where they belong.

    Monotone coordinates are c(z) = max over j <= z of (c(j) - j eps) + z eps; inside a
    chunk the maximum is known, so a chunk only needs the highest value before it,
    and for the affine map of the ends the first and last section of the block.
    Only these few numbers of a chunk are exchanged.
    """
    eps, border = _spacing(o), o.regularization == "BORDER"
    if not voted or (eps is None and not border):
        return state.select(*_GROUP, "z", F.col("r").alias("c"), "m", "c0")
    order = Window.partitionBy(*BLOCK).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = state.select(*_GROUP, "top", "head_c", "head_c0", "tail_z", "tail_c", "tail_c0").select(
        *_GROUP,
        F.max("top").over(before).alias("_carry"),
        F.max("top").over(whole).alias("_peak"),
        *(F.first(c).over(whole).alias(f"_{c}") for c in ("head_c", "head_c0")),
        *(F.last(c).over(whole).alias(f"_{c}") for c in ("tail_z", "tail_c", "tail_c0")),
    )
    # Hashed by chunk again, or the join would gather whole blocks.
    joined = state.drop("top", "head_c", "head_c0", "tail_z", "tail_c", "tail_c0").join(known.repartition(*_GROUP), _GROUP)
    last = F.col("_tail_c") if eps is None else F.col("_peak") + F.col("_tail_z") * eps
    span = last - F.col("_head_c")
    factor = F.when(span != 0, (F.col("_tail_c0") - F.col("_head_c0")) / span).otherwise(1.0)
    joined = joined.withColumn("_factor", factor)

    def settled(r: Column, z: Column) -> Column:
        c = r if eps is None else F.greatest(r, F.col("_carry")) + z * eps
        return F.col("_head_c0") + (c - F.col("_head_c")) * F.col("_factor") if border else c

    return joined.select(*_GROUP, "z", F.zip_with("r", "z", settled).alias("c"), "m", "c0")


def _section_rows(chunks: DataFrame) -> DataFrame:
    """Chunks of ``_settled`` as rows (bx, by, z, c, m, c0)."""
    entries = F.explode(F.arrays_zip("z", "c", "m", "c0")).alias("e")
    return chunks.select(*BLOCK, entries).select(*BLOCK, "e.*")


def _with_neighbours(chunks: DataFrame, halo: int) -> DataFrame:
    """Each chunk's arrays with those of the ``halo`` sections on either side."""
    names = ("z", "c", "m", "c0")

    def sent(to: int, first: Column, n: Column) -> Column:
        parts = (F.slice(F.col(c), first, n).alias(c) for c in names)
        return F.struct((F.col("chunk") + to).alias("chunk"), F.col("chunk").alias("of"), *parts)

    size, one = F.size("z"), F.lit(1)
    near = F.least(size, F.lit(halo))
    copies = F.array(sent(-1, one, near), sent(0, one, size), sent(1, size - near + 1, near))
    spread = chunks.select(*BLOCK, F.explode(copies).alias("p")).where("p.chunk >= 0")
    parts = F.array_sort(F.collect_list(F.struct("p.of", *(F.col(f"p.{c}").alias(c) for c in names)))).alias("parts")
    gathered = spread.groupBy(*BLOCK, F.col("p.chunk").alias("chunk")).agg(parts, F.max(F.col("p.of") == F.col("p.chunk")).alias("own"))
    return gathered.where("own").select(*_GROUP, *(F.flatten(F.col(f"parts.{c}")).alias(c) for c in names))


def _iterate(edges: DataFrame, state: DataFrame, voted: bool, o: InferOptions, step: int) -> DataFrame:
    """One round: settle what the last one voted, curve, multipliers, votes."""
    reach, local = o.comparison_range, o.window_radius >= 0
    halo = (o.multiplier_iterations + 1) * reach
    chunks = _settled(state, o, voted)
    met = _with_neighbours(chunks, halo).join(edges, _GROUP, "left")
    bins = met.select(*_GROUP, "z", "c", "m", "ez", "er", "es").mapInArrow(
        _bin_kernel(reach, step, local), "bx bigint, by bigint, z bigint, bin bigint, ws double, w double"
    )
    if local:
        keys = [*BLOCK, "z"]
        curves = with_halo(_to_curve(_nearby_bins(bins, o.window_radius), keys, reach), step, halo, halo)
        tables = curves.groupBy(*_GROUP).agg(F.array_sort(F.collect_list(F.struct("z", "f"))).alias("_t"))
        tables = tables.select(*_GROUP, F.col("_t.z").alias("fz"), F.flatten(F.col("_t.f")).alias("f"))
    else:
        bins = bins.groupBy(*BLOCK, "bin").agg(F.sum("ws").alias("ws"), F.sum("w").alias("w"))
        # Curves go to the chunks, not the chunks to the curve of their block.
        tables = state.select(*_GROUP).join(_to_curve(bins, BLOCK, reach), BLOCK).repartition(*_GROUP)
        tables = tables.withColumn("fz", F.array().cast("array<bigint>"))
    return met.join(tables, _GROUP, "left").mapInArrow(_round_kernel(o, step), ", ".join(f"{c} {t}" for c, t in _PACKED.items()))


def _packed_edges(sim: DataFrame, reach: int, step: int, halo: int, partitions: int | None) -> DataFrame:
    """One row (bx, by, chunk, ez, er, es) for each chunk's edges, those of its halo included."""
    edges = with_halo(both_ways(sim, reach), step, halo, halo)
    edges = edges.repartition(partitions, *_GROUP) if partitions else edges.repartition(*_GROUP)
    found = edges.groupBy(*_GROUP).agg(F.collect_list(F.struct("z", "zr", "s")).alias("e"))
    return found.select(*_GROUP, F.col("e.z").alias("ez"), F.col("e.zr").alias("er"), F.col("e.s").alias("es"))


def _rounds(
    sim: DataFrame, lut: DataFrame, options: InferOptions, step: int, partitions: int | None
) -> Iterator[tuple[DataFrame, str]]:
    """The coordinates (bx, by, z, c) before and after every round, each with the folder it reads.

    Edges are packed once, a row for each (block, z chunk with halo), and kept; a round
    exchanges only coordinates, and all its multiplier steps share that exchange.  A
    round's result is one table: plans stay short, and a lost executor costs one
    round at most.  A table may be deleted when the next one has been given.
    """
    halo = options.multiplier_iterations * options.comparison_range
    step = max(step, halo + options.comparison_range)
    edges = _packed_edges(sim, options.comparison_range, step, halo, partitions).persist()
    start = lut.where("c IS NOT NULL").select(*BLOCK, "z", "c", F.lit(1.0).alias("m"), F.col("c").alias("c0"))
    state, path = written(_packed(start, step), "coordinates")
    voted = False
    for number in range(options.iterations + 1):
        if number:
            state, path = written(_iterate(edges, state, voted, options, step), "coordinates")
            voted = not (options.monotone and options.reorder)
            if not voted:  # ranks need all coordinates of a block
                rows, old = _section_rows(_settled(state, options, False)), path
                state, path = written(_packed(_settle(rows, options), step), "coordinates")
                delete_path(sim.sparkSession, old)
        yield _section_rows(_settled(state, options, voted)).select(*BLOCK, "z", "c"), path
    edges.unpersist()


def infer_trace(
    sim: DataFrame, lut: DataFrame, options: InferOptions, step: int = STEP, partitions: int | None = None
) -> DataFrame:
    """trace(iter, bx, by, z, c): coordinates before and after every round."""
    states = [s for s, _ in _rounds(sim, lut, options, step, partitions)]
    return reduce(
        DataFrame.unionByName,
        (s.select(F.lit(i).cast("bigint").alias("iter"), *BLOCK, "z", "c") for i, s in enumerate(states)),
    )


def infer_coords(
    sim: DataFrame, lut: DataFrame, options: InferOptions, step: int = STEP, partitions: int | None = None
) -> DataFrame:
    """lut after the last round; blocks that cannot be estimated are NULL.

    A block fails when a start or estimated coordinate is missing or when fewer
    than two pairs are usable.  Tables of earlier rounds are deleted.
    """
    before = None
    for state, path in _rounds(sim, lut, options, step, partitions):
        if before:
            delete_path(sim.sparkSession, before)
        before = path
    final = state.select(*BLOCK, "z", F.col("c").alias("_c"))
    usable = sim.where((F.col("z1") - F.col("z2") <= options.comparison_range) & F.col("s").isNotNull())
    enough = usable.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_pairs")).where("_pairs >= 2")
    joined = lut.select(*BLOCK, "z").join(final, [*BLOCK, "z"], "left")
    # One table with a row for each block that has coordinates, tested once.
    whole = joined.groupBy(*BLOCK).agg(F.max(F.col("_c").isNull() | F.isnan("_c")).alias("_bad"))
    good = whole.where("NOT _bad").join(enough, BLOCK, "left_semi").select(*BLOCK, F.lit(True).alias("_good"))
    return joined.join(good, BLOCK, "left").select(*BLOCK, "z", F.when(F.col("_good"), F.col("_c")).alias("c"))
