import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sectionflow.functions.grid import Grid
from sectionflow.operators import pairs, similarity, tolerant
from sectionflow.operators.grid import block_members

GRID = Grid(10, 7, (3, 2), (2, 2))


def pearson(a, b):
    ok = ~(np.isnan(a) | np.isnan(b))
    a, b = a[ok], b[ok]
    if len(a) < 2 or a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def close(got, want):
    return (got is None) == (want is None) and (got is None or abs(got - want) < 1e-9)


def test_band_join_small_chunks_equal_one_chunk(random_stack):
    df, _ = random_stack
    want = rows(pairs.band_join(df, 4, step=1000), "z1", "z2", "x", "y")
    for step, tile in ((1, 64), (3, 2), (4, 3), (64, 64)):
        assert rows(pairs.band_join(df, 4, step, tile), "z1", "z2", "x", "y") == want
    assert len(want) == 70 * (40 * 4 - 10)


def test_band_join_skips_absent_sections(spark):
    df = spark.createDataFrame([(z, 0, 0, float(z)) for z in (0, 3, 4, 9)], "z bigint, x bigint, y bigint, v double")
    got = rows(pairs.band_join(df, 3, step=2).select("z1", "z2"), "z1", "z2")
    assert got == [(3, 0), (4, 3)]


def test_pair_list_order_and_absent_keys(spark):
    df = spark.createDataFrame([(z, 0, 0, float(z)) for z in range(3)], "z bigint, x bigint, y bigint, v double")
    lists = spark.createDataFrame([(0, [2, 7]), (1, [0])], "z bigint, partners array<bigint>")
    got = rows(pairs.pair_sections(df, lists), "z1")
    assert got == [(0, 1, 0, 0, 0.0, 1.0), (2, 0, 0, 0, 2.0, 0.0)]


def test_chunks_own_disjoint_pairs(random_stack):
    df, _ = random_stack
    got = pairs.chunk_halo(df, 4, 7)
    assert got.where("chunk != z1 div 7").count() == 0
    assert got.select("z1", "z2", "x", "y").distinct().count() == got.count()


def test_section_correlation(random_stack):
    df, v = random_stack
    for z1, z2, _, s in similarity.section_ncc(df, 5).collect():
        assert close(s, pearson(v[z1].ravel(), v[z2].ravel()))


def test_tiles_merge_to_whole(random_stack):
    df, _ = random_stack
    whole = rows(similarity.section_ncc(df, 3), "z1", "z2")
    tiled = rows(similarity.tiled_ncc(similarity.pair_moments(df, 3, (4, 3))), "z1", "z2")
    assert [r[:3] for r in whole] == [r[:3] for r in tiled]
    assert all(close(a[3], b[3]) for a, b in zip(whole, tiled, strict=True))


def test_constant_section_has_no_correlation(spark):
    data = [(z, x, 0, 1.0 if z == 0 else float(x)) for z in range(2) for x in range(4)]
    df = spark.createDataFrame(data, "z bigint, x bigint, y bigint, v double")
    assert similarity.section_ncc(df, 1).first()["s"] is None


@pytest.mark.parametrize("tile", [3, 64])
@pytest.mark.parametrize("packed", [False, True])
def test_block_correlation(random_stack, packed, tile):
    df, v = random_stack
    got = similarity.block_ncc(df, GRID, 4, packed, tile).collect()
    assert len(got) == GRID.size * (40 * 4 - 10)
    for bx, by, z1, z2, n, s in got:
        xs, ys = slice(2 * bx, min(10, 2 * bx + 6)), slice(2 * by, min(7, 2 * by + 4))
        a, b = v[z1, ys, xs].ravel(), v[z2, ys, xs].ravel()
        assert n == (~np.isnan(a + b)).sum()
        assert close(s, pearson(a, b))


def test_matrix_is_symmetric_with_unit_diagonal(random_stack):
    df, _ = random_stack
    m = similarity.similarity_matrix(similarity.block_ncc(df, GRID, 3), 40, GRID)
    flipped = m.select("bx", "by", F.col("z2").alias("z1"), F.col("z1").alias("z2"), "s")
    assert m.exceptAll(flipped).count() == 0
    diagonal = m.where("z1 = z2")
    assert diagonal.count() == GRID.size * 40
    assert diagonal.where("s != 1").count() == 0


def test_strip_round_trip(random_stack):
    df, _ = random_stack
    sim = similarity.block_ncc(df, GRID, 3)
    strip = similarity.band_strip(sim, GRID, 40, 3)
    assert strip.count() == GRID.size * 40 * 7
    assert strip.where("NOT in_bounds AND s IS NOT NULL").count() == 0
    back = similarity.strip_to_matrix(strip)
    assert back.exceptAll(similarity.similarity_matrix(sim, 40, GRID)).count() == 0


def test_strips_keep_only_complete_blocks(random_stack):
    df, _ = random_stack
    members = block_members(pairs.chunk_halo(df, 3, 10), GRID)
    chunked = similarity.correlate(members, ["chunk", "bx", "by", "z1", "z2"])
    whole = rows(similarity.merge_strips(chunked, 4).select("bx", "by", "z1", "z2", "n"), "bx", "by", "z1", "z2")
    assert whole == rows(
        similarity.block_ncc(df, GRID, 3).select("bx", "by", "z1", "z2", "n"), "bx", "by", "z1", "z2"
    )
    gap = chunked.where("NOT (bx = 1 AND by = 1 AND chunk = 2)")
    assert similarity.merge_strips(gap, 4).where("bx = 1 AND by = 1").count() == 0


def test_dense_rows(random_stack):
    df, _ = random_stack
    matrix = similarity.similarity_matrix(similarity.block_ncc(df, GRID, 2), 40, GRID)
    dense = similarity.dense_rows(matrix, 2, 0, 39)
    sizes = {r[0]: r[1] for r in dense.select("z1", F.size("row")).distinct().collect()}
    assert (sizes[0], sizes[1], sizes[20], sizes[39]) == (3, 4, 5, 3)
    assert dense.where("z1 = 20").select(F.expr("row[2]")).first()[0] == 1.0


def tolerant_brute(v, z1, z2, offsets, radius):
    _, h, w = v.shape
    best = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            for dy in range(-offsets[1], offsets[1] + 1):
                for dx in range(-offsets[0], offsets[0] + 1):
                    fits = all(
                        p >= r and p + r <= e
                        for p, r, e in (
                            (x, radius[0], w), (x + dx, radius[0], w), (y, radius[1], h), (y + dy, radius[1], h)
                        )
                    )
                    if not fits:
                        continue
                    a, b = [], []
                    for j in range(y - radius[1], y + radius[1] + 1):
                        for i in range(x - radius[0], x + radius[0] + 1):
                            if 0 <= i < w and 0 <= j < h and 0 <= i + dx < w and 0 <= j + dy < h:
                                a.append(v[z1, j + dy, i + dx])
                                b.append(v[z2, j, i])
                    s = pearson(np.array(a), np.array(b))
                    best[y, x] = max(best[y, x], s or 0.0)
    return best


@pytest.mark.parametrize("tile,step", [(64, 64), (3, 5)])
def test_tolerant_correlation(random_stack, tile, step):
    df, v = random_stack
    few = df.where("z < 8")
    got = tolerant.tolerant_ncc(few, 10, 7, 2, (2, 1), (2, 1), step, tile).collect()
    assert len(got) == 13 * 70
    for z1, z2 in ((3, 2), (5, 3), (7, 6)):
        best = tolerant_brute(v, z1, z2, (2, 1), (2, 1))
        for r in got:
            if (r.z1, r.z2) == (z1, z2):
                assert abs(r.s - best[r.y, r.x]) < 1e-9
                assert (r.weight is not None) == (2 <= r.x < 8 and 1 <= r.y < 6)


@pytest.mark.parametrize("tile", [64, 4])
def test_tolerant_blocks_equal_average_of_pixels(random_stack, tile):
    df, _ = random_stack
    few = df.where("z < 12")
    pixelwise = tolerant.block_average(tolerant.tolerant_ncc(few, 10, 7, 3, (1, 1), (1, 1)), GRID)
    inside = tolerant.tolerant_similarity(few, GRID, 3, (1, 1), (1, 1), tile=tile)
    a, b = rows(pixelwise, "bx", "by", "z1", "z2"), rows(inside, "bx", "by", "z1", "z2")
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert all(close(p[4], q[4]) for p, q in zip(a, b, strict=True))


def test_many_small_sections_meet_in_a_group(random_stack):
    from sectionflow.operators.pairs import default_step

    step = lambda width, height: tolerant._setup(width, height, 5, (1, 1), (1, 1), None, tolerant.TILE)[2]
    assert step(4, 4) * 16 == tolerant.GROUP and step(4000, 2500) == default_step(5)
    df, _ = random_stack
    keys = "bx", "by", "z1", "z2"
    got, want = (rows(tolerant.tolerant_similarity(df, GRID, 3, (1, 1), (1, 1), step), *keys) for step in (None, 7))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(abs(p[4] - q[4]) < 1e-9 for p, q in zip(got, want, strict=True))


def test_shifted_copy_is_found(spark):
    rng = np.random.default_rng(1)
    img = rng.normal(size=(12, 14))
    data = [(0, x, y, float(img[y, x])) for y in range(12) for x in range(12)]
    data += [(1, x, y, float(img[y, x + 1])) for y in range(12) for x in range(12)]
    df = spark.createDataFrame(data, "z bigint, x bigint, y bigint, v double")
    got = tolerant.tolerant_ncc(df, 12, 12, 1, (1, 1), (2, 2)).where("x BETWEEN 4 AND 8 AND y BETWEEN 4 AND 8")
    assert got.agg(F.min("s")).first()[0] > 1 - 1e-9


def test_blocks_meet_in_the_given_partitions(random_stack):
    df, _ = random_stack
    keys = "bx", "by", "z1", "z2"
    got = similarity.block_ncc(df, GRID, 3, partitions=23)
    assert got.rdd.getNumPartitions() == 23
    want = rows(similarity.block_ncc(df, GRID, 3), *keys)
    assert all(a[:5] == b[:5] and close(a[5], b[5]) for a, b in zip(rows(got, *keys), want, strict=True))


def test_packed_blocks_move_a_row_for_each_chunk_and_tile(random_stack):
    df, _ = random_stack
    cells = similarity.cell_moments_packed(pairs.tiled_chunks(df.where("v IS NOT NULL"), 4, 8), [GRID], 4, 8)
    pieces = similarity.block_pieces(cells, GRID, 3)
    assert pieces.count() == GRID.size * 5
    keys = "bx", "by", "z1", "z2"
    want = rows(similarity.block_ncc(df, GRID, 3), *keys)
    got = rows(similarity.block_similarity(pieces, GRID), *keys)
    assert all(a[:5] == b[:5] and close(a[5], b[5]) for a, b in zip(got, want, strict=True))
