"""Coarse-to-fine estimation of section coordinates."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.functions.grid import Grid
from sectionflow.operators.coords import (
    full_sections,
    grid_mapping,
    init_coords,
    interp_nearest,
    join_blocks,
    quality_gate,
    status_grid,
)
from sectionflow.operators.infer import infer_coords
from sectionflow.operators.pairs import default_step, tiled_chunks
from sectionflow.operators.prep import downsample
from sectionflow.operators.render import render, warp_matrix
from sectionflow.operators.repair import fill_lut, invert_lut
from sectionflow.operators.similarity import (
    MatrixStrategy,
    block_pieces,
    block_similarity,
    cell_moments,
    cell_moments_packed,
    similarity_matrix,
)
from sectionflow.operators.tolerant import tolerant_strategy
from sectionflow.plans.options import JobOptions, Stage
from sectionflow.session import materialize
from sectionflow.sources.stacks import full_report, load_masked, load_sections, sections_per_folder, write_sections

BAND = 1024  # pixel rows in a file of the rendered stack


@dataclass
class StageResult:
    grid: Grid
    sim: DataFrame
    forward: DataFrame
    backward: DataFrame
    status: DataFrame
    blocks: int
    failed: int
    seconds: float


def stage_strategy(stage: Stage) -> MatrixStrategy | None:
    """The tolerant similarity if the stage asks for offsets or for its own window, else None."""
    if stage.max_offsets == (0, 0) and stage.correlation_radii == stage.radii:
        return None
    return tolerant_strategy(stage.max_offsets, stage.correlation_radii)


def estimate_stages(
    pixels: DataFrame,
    stages: list[Stage],
    sections: int,
    width: int,
    height: int,
    join_step: int = 0,
    packed: bool = True,
    target: str | None = None,
    strategy: MatrixStrategy | None = None,
    transfer: Callable[[DataFrame, DataFrame], DataFrame] = interp_nearest,
) -> list[StageResult]:
    """Run the stages in order; each starts from the coordinates of the one before.

    ``strategy`` replaces the block correlation by another similarity in all stages,
    and ``transfer`` the way coordinates pass from one grid to the next.  Without it
    a stage with offsets or a correlation window of its own uses the tolerant one.

    Pixels are shuffled and paired once, for the moments of the cells that the borders of
    all stages' blocks leave; these are written, and a stage merges its blocks from them.
    Only stages with a similarity of their own read pixels again; pixels that are dear to
    make should be written first.  With ``target`` the results are also written there, one
    folder per stage.
    """
    spark = pixels.sparkSession
    grids = [Grid(width, height, stage.radii, stage.steps) for stage in stages]
    for number, grid in enumerate(grids):
        if grid.size == 0:
            raise ValueError(f"stage {number}: radius {grid.radius} leaves no block in {width} x {height}")
    owns = [strategy or stage_strategy(stage) for stage in stages]
    paired = [(g, s.infer.comparison_range) for g, s, own in zip(grids, stages, owns, strict=True) if not own]
    if paired:
        reach = max(r for _, r in paired)
        step = max(join_step, default_step(reach))
        moments = cell_moments_packed if packed else cell_moments
        chunked = tiled_chunks(pixels.where("v IS NOT NULL"), reach, step)
        cells = materialize(moments(chunked, [g for g, _ in paired], reach, step), "cells")
    coords, before = init_coords(spark, sections), None
    results: list[StageResult] = []
    for number, (stage, grid, own) in enumerate(zip(stages, grids, owns, strict=True)):
        began = time.monotonic()
        if before is not None:
            coords = transfer(coords, grid_mapping(spark, grid, before))
        near = stage.infer.comparison_range
        sim = own(pixels, grid, near) if own else block_similarity(block_pieces(cells, grid, near), grid)
        sim = materialize(sim, "sim")
        # A row a block; sections of a block stay spread over their chunks in all joins with it.
        seen = sim.select("bx", "by", F.lit(True).alias("seen")).distinct()
        gate = materialize(quality_gate(sim, grid, sections, near).join(seen, ["bx", "by"], "left"), "gate")
        good, bad = gate.where("ok").select("bx", "by"), gate.where("NOT ok AND seen").select("bx", "by")
        found = infer_coords(
            join_blocks(sim, good, grid, sections, "left_semi"),
            join_blocks(coords, good, grid, sections, "left_semi"),
            stage.infer,
        )
        # Only blocks with a similarity take part; the rest reappear as holes.
        kept = join_blocks(coords, bad, grid, sections, "left_semi").select("bx", "by", "z", "c")
        result = materialize(found.unionByName(kept), "estimate")
        status = status_grid(result, grid)
        coords = materialize(fill_lut(full_sections(result, grid, sections)), "forward")
        backward = materialize(invert_lut(coords, sections=sections), "backward")
        failed = result.where("c IS NULL").select("bx", "by").distinct().count()
        results.append(
            StageResult(grid, sim, coords, backward, status, grid.size, failed, time.monotonic() - began)
        )
        if target:
            write_stage(results[-1], stage, number, sections, target)
        before = grid
    return results


def write_stage(result: StageResult, stage: Stage, number: int, sections: int, target: str) -> None:
    """Forward, backward and status tables of one stage; matrices when asked for."""
    root = f"{target}/stage={number}"
    result.forward.repartitionByRange("z").write.parquet(f"{root}/forward")
    result.backward.repartitionByRange("z").write.parquet(f"{root}/backward")
    result.status.write.parquet(f"{root}/status")
    if stage.log_matrices:
        matrix = similarity_matrix(result.sim, sections, result.grid)
        matrix.write.parquet(f"{root}/matrices")
        warp_matrix(matrix, result.backward).write.parquet(f"{root}/transformed_matrices")


def stage_report(spark: SparkSession, results: list[StageResult]) -> DataFrame:
    """One row per stage: blocks, failed blocks, wall time."""
    rows = [(i, r.blocks, r.failed, r.seconds) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, "stage bigint, blocks bigint, failed bigint, seconds double")


def estimation_job(
    spark: SparkSession,
    options: JobOptions,
    width: int,
    height: int,
    strategy: MatrixStrategy | None = None,
    transfer: Callable[[DataFrame, DataFrame], DataFrame] = interp_nearest,
) -> DataFrame:
    """Load, mask, downsample, estimate, write; returns the stage report.

    ``options.mask`` names a stack like the source; where it is 0 pixels count as
    missing.  An empty name means no mask.
    """
    pixels = load_sections(spark, options.source, options.start, options.stop)
    if options.mask:
        masked = load_masked(pixels, load_sections(spark, options.mask, options.start, options.stop))
        pixels = masked.withColumn("v", F.when(F.col("weight") != 0, F.col("v"))).drop("weight")
    if options.scale:
        pixels = downsample(pixels, options.scale, width, height)
        width, height = width >> options.scale, height >> options.scale
    own = sum(1 for stage in options.stages if strategy or stage_strategy(stage))
    if (options.mask or options.scale) and own + (own < len(options.stages)) > 1:
        pixels = materialize(pixels, "pixels")  # read by more than one stage
    results = estimate_stages(
        pixels,
        list(options.stages),
        options.sections,
        width,
        height,
        options.join_step,
        target=options.target,
        strategy=strategy,
        transfer=transfer,
    )
    return stage_report(spark, results)


def render_job(spark: SparkSession, options: JobOptions, stage: int, width: int, height: int, output: str) -> DataFrame:
    """Render the full-resolution stack by a stage's backward table.

    Returns the write report over all sections; those without a source are not ok.
    """
    pixels = load_sections(spark, options.source, options.start, options.stop)
    side = 1 << options.scale
    chosen = options.stages[stage]
    grid = Grid(width // side, height // side, chosen.radii, chosen.steps)
    backward = spark.read.parquet(f"{options.target}/stage={stage}/backward")
    rendered = render(pixels, backward, grid, width, height, options.sections, side)
    write_sections(rendered, output, single=True, per_folder=sections_per_folder(options.sections), band=BAND)
    return full_report(spark.read.parquet(output), options.sections, width * height).orderBy("z")
