"""Correlation of section pairs, whole, tiled and per block."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionflow.functions.chunks import checked_broadcast, dealt
from sectionflow.functions.grid import Grid, cell_origin
from sectionflow.functions.stats import CENTRED, TINY, centred_aggs, centred_ncc, merge_centred_tree, moment_aggs, ncc
from sectionflow.operators.grid import CELL, block_sections, cells_to_blocks, with_cell
from sectionflow.operators.pairs import TILE, band_join, default_step, pairs_in_chunks, tiled_chunks
from sectionflow.session import materialize

PAIR = ("z1", "z2")


def correlate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairwise-complete correlation of columns a and b under ``keys``."""
    both = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.lit(1)))
    return pairs.groupBy(*keys).agg(both.alias("n"), centred_ncc().alias("s"))


def section_ncc(pixels: DataFrame, reach: int, partitions: int | None = None) -> DataFrame:
    """sim(z1, z2, n, s) of whole sections."""
    return correlate(band_join(pixels, reach, partitions=partitions), list(PAIR))


def pair_moments(pixels: DataFrame, reach: int, tile: tuple[int, int]) -> DataFrame:
    """Moments per image tile and section pair: plain sums, and centred ones, which merge without cancelling."""
    keys = F.expr(f"x div {tile[0]}").alias("tx"), F.expr(f"y div {tile[1]}").alias("ty")
    return band_join(pixels, reach).groupBy(*keys, *PAIR).agg(*moment_aggs(), *centred_aggs()[1:])


def tiled_ncc(moments: DataFrame, tiles: tuple[int, int] | None = None) -> DataFrame:
    """Whole-section correlation from tile moments; ``tiles`` across and down, looked up if not given."""
    if tiles is None:
        tiles = tuple((n or 0) + 1 for n in moments.agg(F.max("tx"), F.max("ty")).first())
    merged = merge_centred_tree(moments, PAIR, ("tx", "ty"), 8, tiles)
    return merged.select(*PAIR, "n", ncc().alias("s"))


ORIGIN = ("x", "y")
DENSE = 1 << 20  # numbers of a dense array in a task


def cell_moments(chunked: DataFrame, grids: Sequence[Grid], reach: int, step: int) -> DataFrame:
    """Centred moments of every cell and pair: (chunk, tx, ty, x, y, z1, z2, ``CENTRED``), built-in expressions only.

    A cell is what no border of a block of any of the ``grids`` cuts, so it lies wholly
    inside or outside of each block; x, y is its first pixel.  Blocks are merged from
    cells, so pixels are paired once for any number of grids.  ``chunked`` comes from
    ``tiled_chunks`` with the same or a larger reach; its groups own whole cells of a tile
    and their pairs, so these are added up where they are.
    """
    group = ["chunk", "tx", "ty"]
    pairs = pairs_in_chunks(chunked.where("v IS NOT NULL"), reach, step, group)
    origin = [cell_origin(c, grids).alias(c) for c in ORIGIN]
    return pairs.select(*group, "z1", "z2", "a", "b", *origin).groupBy(*group, *ORIGIN, *PAIR).agg(*centred_aggs())


def _batches(sizes: np.ndarray, sections: int) -> Iterator[np.ndarray]:
    """Cells of about equal numbers of pixels, few enough for dense arrays over ``sections`` squared."""
    order, scale = np.argsort(sizes, kind="stable"), np.ceil(np.log2(sizes))
    for same in np.split(order, np.flatnonzero(np.diff(scale[order])) + 1):
        most = max(1, DENSE // (sections * max(sections, int(sizes[same[-1]]))))
        yield from (same[i : i + most] for i in range(0, len(same), most))


def cell_moments_packed(chunked: DataFrame, grids: Sequence[Grid], reach: int, step: int) -> DataFrame:
    """The same from matrix products: (chunk, tx, ty, x, y, moments), a row for a cell of a (chunk, tile) group.

    ``moments`` holds z1, z2 and ``CENTRED`` of all pairs, one after the other, as doubles.
    The pixels of a group's cell become a sections x pixels matrix; one product, of many
    cells at once, replaces a row per pixel pair.  Values are taken relative to their
    section's mean in the cell, so an offset does not cancel.  Groups are bounded by
    chunk and tile size.
    """
    origin = {f"o{c}": cell_origin(c, grids) for c in ORIGIN}
    tagged = chunked.where("v IS NOT NULL").withColumns(origin)

    def banded(pdf: pd.DataFrame) -> pd.DataFrame:
        group = [int(pdf[c].iat[0]) for c in ("chunk", "tx", "ty")]
        x, y, v = (pdf[c].to_numpy() for c in ("x", "y", "v"))
        zs, zi = np.unique(pdf["z"].to_numpy(), return_inverse=True)
        gap = zs[:, None] - zs[None, :]
        hi, lo = np.nonzero((gap > 0) & (gap <= reach) & (zs[:, None] >= group[0] * step))
        ends = np.stack([zs[hi], zs[lo]]).astype(np.float64)
        corners, cell = np.unique(pdf["ox"].to_numpy() * 2**31 + pdf["oy"].to_numpy(), return_inverse=True)
        places, pi = np.unique(x * 2**31 + y, return_inverse=True)
        of = np.zeros(len(places), np.int64)
        of[pi] = cell
        sizes = np.bincount(of)
        at = np.zeros(len(places), np.int64)  # of a pixel inside its cell
        at[np.argsort(of, kind="stable")] = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        batches = list(_batches(sizes, len(zs)))
        number, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, cells in enumerate(batches):
            number[cells], slot[cells] = k, np.arange(len(cells))
        rows = np.argsort(number[cell], kind="stable")
        out: list[list] = []
        for cells, mine in zip(batches, np.split(rows, np.cumsum(np.bincount(number[cell]))[:-1]), strict=True):
            mask = np.zeros((len(cells), len(zs), sizes[cells].max()))
            near = np.zeros_like(mask)
            where = slot[cell[mine]], zi[mine], at[pi[mine]]
            mask[where], near[where] = 1.0, v[mine]
            seen = np.maximum(mask.sum(axis=2), 1.0)
            mean = near.sum(axis=2) / seen
            near = (near - mean[:, :, None]) * mask
            rest = near.sum(axis=2) / seen  # what rounding left of the mean
            near, mean = (near - rest[:, :, None]) * mask, mean + rest
            square, across = near * near, mask.transpose(0, 2, 1)
            products = mask @ across, near @ across, square @ across, near @ near.transpose(0, 2, 1)
            n, sums, squares = (p[:, hi, lo] for p in products[:3])
            other, other_squares, both = (p[:, lo, hi] for p in products[1:])
            n = np.where(n > 0, n, np.nan)
            qa, qb = np.maximum(squares - sums * sums / n, 0.0), np.maximum(other_squares - other * other / n, 0.0)
            held = np.stack([n, mean[:, hi] + sums / n, mean[:, lo] + other / n, qa, qb, both - sums * other / n], axis=1)
            for one, values in zip(cells, held, strict=True):
                kept = ~np.isnan(values[0])
                if kept.any():
                    moments = np.concatenate([ends, values])[:, kept]
                    out.append([*group, *divmod(int(corners[one]), 2**31), moments.tobytes()])
        return pd.DataFrame(out, columns=["chunk", "tx", "ty", *ORIGIN, "moments"])

    schema = "chunk bigint, tx bigint, ty bigint, x bigint, y bigint, moments binary"
    return tagged.groupBy("chunk", "tx", "ty").applyInPandas(banded, schema)


def block_pieces(cells: DataFrame, grid: Grid, reach: int) -> DataFrame:
    """Partial moments (bx, by, x, y, z1, z2, ``CENTRED``) of the blocks from the moments of their cells.

    Rows of ``cell_moments`` are repeated for every block of the cell; those of
    ``cell_moments_packed`` are merged to blocks as they are read, tile by tile, and stay
    packed: (bx, by, chunk, x, y, moments), where x, y is the tile's first pixel.
    """
    tagged = with_cell(cells, grid)
    if "moments" not in cells.columns:
        near = tagged.where((F.col("z1") - F.col("z2") <= reach) & (F.col("n") > 0))
        return cells_to_blocks(near).select("bx", "by", *ORIGIN, *PAIR, *CENTRED)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks: dict[tuple, np.ndarray] = {}
            keys = zip(*(batch.column(c).to_pylist() for c in ("chunk", "tx", "ty", *CELL)))
            for (chunk, tx, ty, lx, hx, ly, hy), packed in zip(keys, batch.column("moments"), strict=True):
                one = _unpacked(packed)
                one = one[:, one[0] - one[1] <= reach]
                for at in ((bx, by, chunk, tx * TILE, ty * TILE) for bx in range(lx, hx + 1) for by in range(ly, hy + 1)):
                    blocks[at] = _joined_arrays(blocks[at], one) if at in blocks else one
            if blocks:
                yield _packed_rows(list(blocks.items()), [*PIECE, *ORIGIN])

    return tagged.mapInArrow(pieces, ", ".join(f"{c} bigint" for c in (*PIECE, *ORIGIN)) + ", moments binary")


PIECE = ("bx", "by", "chunk")


def _unpacked(moments: pa.Scalar) -> np.ndarray:
    """z1, z2 and ``CENTRED`` as rows, from the bytes of ``cell_moments_packed``."""
    return np.frombuffer(moments.as_buffer()).reshape(2 + len(CENTRED), -1)


def _packed_rows(found: list[tuple[tuple, np.ndarray]], keys: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in zip(*(k for k, _ in found))]
    moments = pa.array([m.tobytes() for _, m in found], pa.binary())
    return pa.RecordBatch.from_arrays([*columns, moments], [*keys, "moments"])


def _pair_rows(found: list[tuple[tuple, np.ndarray]], keys: Sequence[str]) -> pa.RecordBatch:
    """(bx, by, z1, z2, n, s) of merged moments; s as in ``ncc``."""
    at = np.repeat(np.array([k[:2] for k, _ in found], np.int64), [m.shape[1] for _, m in found], axis=0)
    z1, z2, n, ma, mb, qa, qb, cab = np.concatenate([m for _, m in found], axis=1)
    varies = (qa > TINY * n * ma * ma) & (qb > TINY * n * mb * mb)
    s = cab / np.sqrt(np.where(varies, qa, 1.0)) / np.sqrt(np.where(varies, qb, 1.0))
    columns = [at[:, 0], at[:, 1], *(c.round().astype(np.int64) for c in (z1, z2, n))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(s, mask=~varies)], ["bx", "by", *PAIR, "n", "s"])


def _merged(pieces: DataFrame, keys: Sequence[str], partitions: int | None, leave: Callable, schema: str) -> DataFrame:
    """Pieces of equal ``keys`` joined as they follow each other, and left as ``leave`` makes rows of them."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0)
        for batch in batches:
            done = []
            for key, packed in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("moments"), strict=True):
                one = _unpacked(packed)
                if key == last:
                    held = _joined_arrays(held, one)
                    continue
                if last:
                    done.append((last, held))
                last, held = key, one
            if done:
                yield leave(done, keys)
        if last:
            yield leave([(last, held)], keys)

    return dealt(pieces, keys, partitions).sortWithinPartitions(*keys).select(*keys, "moments").mapInArrow(joined, schema)


def _joined_arrays(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Moments (z1, z2, ``CENTRED``) of the pairs of either, merged where both have a pair."""
    if one.shape != two.shape or (one[:2] != two[:2]).any():
        pairs, at = np.unique(np.concatenate([one[:2], two[:2]], axis=1), axis=1, return_inverse=True)
        spread = []
        for part, own in ((one, at[: one.shape[1]]), (two, at[one.shape[1] :])):
            wide = np.zeros((len(part), pairs.shape[1]))
            wide[:2] = pairs
            wide[2:, own] = part[2:]
            spread.append(wide)
        one, two = spread
    n = one[2] + two[2]
    share = two[2] / n
    da, db, both = two[3] - one[3], two[4] - one[4], one[2] * share
    distance = np.stack([da * share, db * share, da * da * both, db * db * both, da * db * both])
    means, rest = one[3:5], one[5:] + two[5:]
    return np.concatenate([one[:2], n[None], np.concatenate([means, rest]) + distance])


def block_similarity(pieces: DataFrame, grid: Grid, partitions: int | None = None) -> DataFrame:
    """sim(bx, by, z1, z2, n, s) from ``block_pieces``; a pair of sections belongs to one chunk."""
    span = tuple(2 * r for r in grid.radius)
    if "moments" in pieces.columns:
        side, near = 2 * TILE, [*PIECE, *ORIGIN]
        while max(span) > side:
            square = {c: F.expr(f"{c} div {side} * {side}") for c in ORIGIN}
            schema = ", ".join(f"{c} bigint" for c in near) + ", moments binary"
            pieces = _merged(pieces.withColumns(square), near, partitions, _packed_rows, schema)
            side *= 8
        pairs = "bx bigint, by bigint, z1 bigint, z2 bigint, n bigint, s double"
        return _merged(pieces, list(PIECE), partitions, _pair_rows, pairs)
    keys = ["bx", "by", *PAIR]
    merged = merge_centred_tree(pieces, keys, ORIGIN, 2 * TILE, span, partitions)
    return merged.select(*keys, "n", ncc().alias("s"))


def block_ncc(
    pixels: DataFrame, grid: Grid, reach: int, packed: bool = False, tile: int = TILE, partitions: int | None = None
) -> DataFrame:
    """Correlation of every block of every section pair within reach; pixels and pairs meet in ``partitions``, if given."""
    step = default_step(reach)
    chunked = tiled_chunks(pixels.where("v IS NOT NULL"), reach, step, tile, partitions)
    cells = (cell_moments_packed if packed else cell_moments)(chunked, [grid], reach, step)
    return block_similarity(block_pieces(cells, grid, reach), grid, partitions)


def block_pair_map(sim: DataFrame) -> DataFrame:
    """Per block and section, a map partner -> similarity (at most ``reach`` entries)."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("z2", "s"))))
    return sim.groupBy("bx", "by", "z1").agg(entries.alias("partners"))


def similarity_matrix(sim: DataFrame, sections: int, grid: Grid | None = None) -> DataFrame:
    """Symmetric matrix in sparse long form with a unit diagonal.

    Every block that occurs in ``sim`` gets all ``sections`` diagonal entries;
    without a grid there is one matrix for the whole stack.  Missing entries are
    absent.  With a grid ``sim`` is read for entries and for the blocks that occur, so
    it is written first and made once.
    """
    keys = ["bx", "by"] if grid else []
    if grid:
        sim = materialize(sim.select(*keys, "z1", "z2", "s"), "sim")
    ends = F.struct("z1", "z2"), F.struct(F.col("z2").alias("z1"), F.col("z1").alias("z2"))
    both = sim.select(*keys, "s", F.explode(F.array(*ends)).alias("p")).select(*keys, "p.z1", "p.z2", "s")
    unit = block_sections(sim.sparkSession, grid, sections) if grid else sim.sparkSession.range(sections).toDF("z")
    if grid:
        unit = unit.join(checked_broadcast(sim.select(*keys).distinct(), grid.size), keys, "left_semi")
    unit = unit.select(*keys, F.col("z").alias("z1"), F.col("z").alias("z2"), F.lit(1.0).alias("s"))
    return both.unionByName(unit)


def dense_rows(matrix: DataFrame, reach: int, first: int, last: int) -> DataFrame:
    """One array per matrix row holding its band, NULL where missing.

    Positions run from z1 - reach to z1 + reach cut to [first, last].
    """
    keys = [c for c in ("bx", "by") if c in matrix.columns]
    cells = F.map_from_entries(F.collect_list(F.struct("z2", "s")))
    span = f"sequence(greatest(z1 - {reach}, {first}L), least(z1 + {reach}, {last}L))"
    return (
        matrix.where(F.abs(F.col("z1") - F.col("z2")) <= reach)
        .groupBy(*keys, "z1")
        .agg(cells.alias("cells"))
        .select(*keys, "z1", F.expr(f"transform({span}, k -> try_element_at(cells, k))").alias("row"))
    )


def band_strip(sim: DataFrame, grid: Grid, sections: int, reach: int) -> DataFrame:
    """strip(bx, by, z, k, s, in_bounds) for k in [-reach, reach].

    Cells beyond the stack are NULL and flagged, so they cannot be mistaken for
    a missing similarity inside it.
    """
    offsets = F.sequence(F.lit(-reach).cast("bigint"), F.lit(reach).cast("bigint"))
    spine = block_sections(sim.sparkSession, grid, sections).withColumn("k", F.explode(offsets))
    both = F.array(
        F.struct(F.col("z1").alias("z"), (F.col("z2") - F.col("z1")).alias("k"), "s"),
        F.struct(F.col("z2").alias("z"), (F.col("z1") - F.col("z2")).alias("k"), "s"),
    )
    values = sim.select("bx", "by", F.explode(both).alias("e")).select("bx", "by", "e.*")
    return spine.join(values, ["bx", "by", "z", "k"], "left").select(
        "bx",
        "by",
        "z",
        "k",
        F.when(F.col("k") == 0, 1.0).otherwise(F.col("s")).alias("s"),
        (F.col("z") + F.col("k")).between(0, sections - 1).alias("in_bounds"),
    )


def merge_strips(chunked: DataFrame, chunks: int) -> DataFrame:
    """Join per-chunk similarities ``(chunk, bx, by, z1, z2, n, s)``.

    Chunks own disjoint pairs, so joining is dropping the chunk; a block stays
    only when every chunk has it.  Which blocks do is a row a block, counted and sent
    to the rows, so the rows of a block stay where they are.
    """
    chunked = materialize(chunked, "strips")
    present = chunked.select("bx", "by", "chunk").distinct().groupBy("bx", "by").agg(F.count(F.lit(1)).alias("_have"))
    kept = materialize(present.where(F.col("_have") == chunks).select("bx", "by"), "complete-blocks")
    return chunked.join(checked_broadcast(kept, kept.count()), ["bx", "by"], "left_semi").drop("chunk")


def strip_to_matrix(strip: DataFrame) -> DataFrame:
    """Matrix entries from strip cells inside the stack."""
    return strip.where("in_bounds AND s IS NOT NULL").select(
        "bx", "by", F.col("z").alias("z1"), (F.col("z") + F.col("k")).alias("z2"), "s"
    )


MatrixStrategy = Callable[[DataFrame, Grid, int], DataFrame]


def block_matrices(
    pixels: DataFrame, grid: Grid, sections: int, reach: int, strategy: MatrixStrategy = block_ncc
) -> DataFrame:
    """Similarity matrices of every block by an exchangeable similarity."""
    return similarity_matrix(strategy(pixels, grid, reach), sections, grid)


def stack_correlation(pixels: DataFrame, sections: int, reach: int) -> DataFrame:
    """Matrix of whole-section correlations, zeros taken as missing."""
    clean = pixels.where("v IS NOT NULL AND v != 0")
    return similarity_matrix(section_ncc(clean, reach), sections)
