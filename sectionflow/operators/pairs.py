"""Pairing sections: banded self-join, key lists, chunks with halo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.functions.chunks import checked_broadcast, dealt, owned, with_halo

TILE = 64


def default_step(reach: int) -> int:
    return max(2 * reach, 64)


def tiled_chunks(pixels: DataFrame, reach: int, step: int, tile: int = TILE, partitions: int | None = None) -> DataFrame:
    """Pixels hashed by (z chunk with halo below, pixel tile).

    A group holds at most tile^2 * (step + reach) pixels however large the stack.
    """
    tiles = {f"t{c}": F.expr(f"{c} div {tile}") for c in ("x", "y")}
    return dealt(with_halo(pixels, step, before=reach).withColumns(tiles), ["chunk", "tx", "ty"], partitions)


def pairs_in_chunks(chunked: DataFrame, reach: int, step: int, kept: Sequence[str] = ("chunk",)) -> DataFrame:
    """Banded pairs of an already chunked stack (see ``tiled_chunks``), with the ``kept`` columns of its groups.

    A pair belongs to the chunk that owns its larger section, so no pair repeats.
    """
    below = Window.partitionBy("chunk", "tx", "ty", "x", "y").orderBy("z").rangeBetween(-reach, -1)
    near = F.collect_list(F.struct(F.col("z").alias("z2"), F.col("v").alias("b"))).over(below)
    return (
        chunked.withColumn("near", near)
        .where(owned(step))
        .select(*kept, F.col("z").alias("z1"), "x", "y", F.col("v").alias("a"), F.explode("near").alias("n"))
        .select(*kept, "z1", F.col("n.z2").alias("z2"), "x", "y", "a", F.col("n.b").alias("b"))
    )


def chunk_halo(pixels: DataFrame, reach: int, step: int, tile: int = TILE, partitions: int | None = None) -> DataFrame:
    """Banded pairs computed chunk by chunk: pair rows with their ``chunk``."""
    return pairs_in_chunks(tiled_chunks(pixels, reach, step, tile, partitions), reach, step)


def band_join(
    pixels: DataFrame, reach: int, step: int | None = None, tile: int = TILE, partitions: int | None = None
) -> DataFrame:
    """pairs(z1, z2, x, y, a, b) with 0 < z1 - z2 <= reach.

    Each pixel is shuffled once (plus halo), not once per partner: partners come
    from a sliding window over the pixel's own column.
    """
    return chunk_halo(pixels, reach, step or default_step(reach), tile, partitions).drop("chunk")


def routes(lists: DataFrame, step: int) -> tuple[DataFrame, DataFrame, int]:
    """Where each section is needed, by (key chunk, partner chunk) of the listed pairs.

    As a key, (z, ck, cp, wanted array): the partners it has in that chunk; as a partner,
    (z, ck, cp).  Also the number of listed pairs, which bounds the rows of both.
    """
    pairs = lists.select(F.col("z").alias("k"), F.explode("partners").alias("p")).where("k IS NOT NULL AND p IS NOT NULL")
    pairs = pairs.withColumns({"ck": F.expr(f"k div {step}"), "cp": F.expr(f"p div {step}")})
    keys = pairs.groupBy(F.col("k").alias("z"), "ck", "cp").agg(F.collect_list("p").alias("wanted"))
    partners = pairs.select(F.col("p").alias("z"), "ck", "cp").distinct()
    listed = lists.agg(F.sum(F.size(F.coalesce("partners", F.array().cast("array<bigint>"))))).first()[0]
    return keys, partners, listed or 0


def pair_sections(pixels: DataFrame, lists: DataFrame, step: int = TILE, tile: int = TILE) -> DataFrame:
    """Self-join from a key list: ``lists(z, partners array)``.

    Output (z1, z2) = (partner, key); partners that do not exist vanish.  A pixel is sent
    once for each pair of chunks that the lists connect, to the group of its tile, as a
    key and as a partner; what it is paired with is told by the lists inside the group.
    No group holds more than two chunks of a tile, and no shuffle is by section.
    """
    keys, partners, listed = routes(lists, step)
    group = ["ck", "cp", "tx", "ty"]

    def sent(to: DataFrame) -> DataFrame:
        tiles = F.expr(f"x div {tile}").alias("tx"), F.expr(f"y div {tile}").alias("ty")
        rest = [c for c in to.columns if c not in ("z", "ck", "cp")]
        met = pixels.select("z", "x", "y", "v").join(checked_broadcast(to, listed), "z")
        return met.select("z", "x", "y", "v", "ck", "cp", *tiles, *rest).repartition(*group)

    left = sent(keys).select(*group, "x", "y", F.col("z").alias("z2"), F.col("v").alias("b"), F.explode("wanted").alias("z1"))
    right = sent(partners).select(*group, "x", "y", F.col("z").alias("z1"), F.col("v").alias("a"))
    return left.join(right, [*group, "x", "y", "z1"]).select("z1", "z2", "x", "y", "a", "b")


def band_lists(sections: DataFrame, reach: int) -> DataFrame:
    """Partner lists z+1 .. z+reach for a table of section numbers."""
    return sections.select("z", F.expr(f"sequence(z + 1, z + {reach})").alias("partners"))
