"""DuckDB SQL giving the expected result of each query.

Written the direct way (range joins, self-joins, ``VALUES``) so that it does not
share the shape of the Spark plans it checks.
"""

from __future__ import annotations

import re

from sectionflow.operators.prep import gaussian_taps

ORACLES: dict[str, str] = {}

# Shared table expressions, by name, with the ones each needs before it.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "emb": (
        (),
        """SELECT vec_id AS z, p % 8 AS x, p // 8 AS y, CAST(embedding[p + 1] AS DOUBLE) AS v
           FROM embeddings, generate_series(0, 63) AS g(p)""",
    ),
    "es": (
        ("emb",),
        """SELECT z, x, y, avg(v) OVER (PARTITION BY x, y ORDER BY z
                                       ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM emb""",
    ),
    "en": ((), "SELECT max(vec_id) + 1 AS n FROM embeddings"),
    "ez": (("en",), "SELECT z FROM en, unnest(generate_series(0, n - 1)) AS u(z)"),
    "lines": (
        (),
        """SELECT l_orderkey // 16 AS z, l_partkey % 8 AS x, (l_partkey // 8) % 8 AS y,
                  l_quantity, l_discount, l_returnflag FROM lineitem""",
    ),
    "li": (("lines",), "SELECT z, x, y, sum(l_quantity) AS v FROM lines GROUP BY z, x, y"),
    "li16": (
        (),
        """SELECT l_orderkey // 16 AS z, l_partkey % 16 AS x, (l_partkey // 16) % 16 AS y,
                  sum(l_quantity) AS v FROM lineitem GROUP BY ALL""",
    ),
    "ln": ((), "SELECT max(l_orderkey) // 16 + 1 AS n FROM lineitem"),
    "lz": (("ln",), "SELECT z FROM ln, unnest(generate_series(0, n - 1)) AS u(z)"),
    "pix": ((), "SELECT i % 8 AS x, i // 8 AS y FROM generate_series(0, 63) AS g(i)"),
    "cells": (
        ("li", "lz", "pix"),
        """SELECT s.z, s.x, s.y, li.v FROM (SELECT z, x, y FROM lz, pix) s
           LEFT JOIN li ON li.z = s.z AND li.x = s.x AND li.y = s.y""",
    ),
    # 3 x 3 blocks, radius 2, step 2, on 8 x 8 pixels: half-open and closed windows.
    "blk": (
        (),
        """SELECT i % 3 AS bx, i // 3 AS by, 2 * (i % 3) AS x0, 2 * (i // 3) AS y0
           FROM generate_series(0, 8) AS g(i)""",
    ),
    "memb": (
        ("blk", "pix"),
        "SELECT bx, by, x, y FROM blk JOIN pix ON x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 4",
    ),
    "cmemb": (
        ("blk", "pix"),
        "SELECT bx, by, x, y FROM blk JOIN pix ON x BETWEEN x0 AND x0 + 4 AND y BETWEEN y0 AND y0 + 4",
    ),
    "lut": (
        ("lines", "lz", "blk"),
        """SELECT bx, by, lz.z, lz.z + 0.25::DOUBLE * ((coalesce(t.q, 0) + bx + 2 * by) % 4) AS c
           FROM lz CROSS JOIN blk
           LEFT JOIN (SELECT z, CAST(sum(l_quantity) AS BIGINT) AS q FROM lines GROUP BY z) t ON t.z = lz.z""",
    ),
    "elut": (
        ("blk",),
        """SELECT bx, by, vec_id AS z, vec_id + 0.25::DOUBLE * ((label + bx + 2 * by) % 4) AS c
           FROM embeddings CROSS JOIN blk""",
    ),
    "flut": (
        ("lut", "memb", "lines"),
        """SELECT lut.bx, lut.by, lut.z, CASE WHEN t.q % 2 = 1 THEN lut.c END AS c FROM lut JOIN (
             SELECT bx, by, CAST(sum(l_quantity) AS BIGINT) AS q FROM lines JOIN memb USING (x, y)
             GROUP BY bx, by) t ON t.bx = lut.bx AND t.by = lut.by""",
    ),
    "epairs": (
        ("emb",),
        """SELECT p.z AS z1, q.z AS z2, p.x, p.y, p.v AS a, q.v AS b FROM emb p JOIN emb q
           ON p.x = q.x AND p.y = q.y AND q.z < p.z AND q.z >= p.z - 5""",
    ),
    "spairs": (
        ("es",),
        """SELECT p.z AS z1, q.z AS z2, p.x, p.y, p.v AS a, q.v AS b FROM es p JOIN es q
           ON p.x = q.x AND p.y = q.y AND q.z < p.z AND q.z >= p.z - 5""",
    ),
    "lpairs": (
        ("li",),
        """SELECT p.z AS z1, q.z AS z2, p.x, p.y, p.v AS a, q.v AS b FROM li p JOIN li q
           ON p.x = q.x AND p.y = q.y AND q.z < p.z AND q.z >= p.z - 8""",
    ),
    "sim": (
        ("spairs", "memb"),
        """SELECT bx, by, z1, z2, count(*) AS n, {ncc} AS s
           FROM spairs JOIN memb USING (x, y) GROUP BY bx, by, z1, z2""",
    ),
    "inv": (
        ("lut",),
        """SELECT b.bx, b.by, b.z, min(CASE WHEN s.z IS NULL THEN NULL
                                          WHEN s.c1 > s.c THEN s.z + (b.z - s.c) / (s.c1 - s.c) ELSE s.z END) AS c
           FROM lut b LEFT JOIN (SELECT bx, by, z, c, lead(c) OVER (PARTITION BY bx, by ORDER BY z) AS c1 FROM lut) s
             ON s.bx = b.bx AND s.by = b.by
            AND ((s.c1 > s.c AND b.z >= s.c AND b.z < s.c1) OR (s.c1 IS NULL AND b.z = s.c))
           GROUP BY b.bx, b.by, b.z""",
    ),
    "crd": (
        ("inv",),
        """SELECT g.z, g.x, g.y,
             CASE WHEN (fx < 1 AND fy < 1 AND c00.c IS NULL) OR (fx > 0 AND fy < 1 AND c10.c IS NULL)
                    OR (fx < 1 AND fy > 0 AND c01.c IS NULL) OR (fx > 0 AND fy > 0 AND c11.c IS NULL) THEN NULL
                  ELSE coalesce(c00.c, 0) * (1 - fx) * (1 - fy) + coalesce(c10.c, 0) * fx * (1 - fy)
                     + coalesce(c01.c, 0) * (1 - fx) * fy + coalesce(c11.c, 0) * fx * fy END AS p
           FROM (SELECT z, x, y, CAST(floor(u) AS BIGINT) AS i, CAST(floor(w) AS BIGINT) AS j,
                        u - floor(u) AS fx, w - floor(w) AS fy
                 FROM (SELECT z, i % {side} AS x, i // {side} AS y,
                              least(greatest((i % {side} / {scale} - 2) / 2.0::DOUBLE, 0), {topx}) AS u,
                              least(greatest((i // {side} / {scale} - 2) / 2.0::DOUBLE, 0), {topy}) AS w
                       FROM lz, generate_series(0, {side} * {side} - 1) AS s(i))) g
           LEFT JOIN inv c00 ON c00.z = g.z AND c00.bx = g.i AND c00.by = g.j
           LEFT JOIN inv c10 ON c10.z = g.z AND c10.bx = g.i + 1 AND c10.by = g.j
           LEFT JOIN inv c01 ON c01.z = g.z AND c01.bx = g.i AND c01.by = g.j + 1
           LEFT JOIN inv c11 ON c11.z = g.z AND c11.bx = g.i + 1 AND c11.by = g.j + 1""",
    ),
}

NCC = """CASE WHEN count(*) * sum(a * a) - sum(a) * sum(a) > 0 AND count(*) * sum(b * b) - sum(b) * sum(b) > 0
   THEN (count(*) * sum(a * b) - sum(a) * sum(b))
        / sqrt(count(*) * sum(a * a) - sum(a) * sum(a)) / sqrt(count(*) * sum(b * b) - sum(b) * sum(b)) END"""

DEFAULTS = {"ncc": NCC, "side": 8, "scale": "1.0::DOUBLE", "topx": 2, "topy": 2}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None, **params) -> str:
    """Prefix ``body`` with the named table expressions and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    values = {**DEFAULTS, **params}
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1].format(**values)})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}"


def oracle(name: str, body: str, *needs: str, **kw) -> None:
    sql = with_ctes(body, *needs, **kw) if needs or kw else body
    # The block column is a reserved word in SQL; keywords are in capitals here.
    ORACLES[name] = re.sub(r"\bby\b", '"by"', sql)


# Sources and sinks

oracle("load_sections", "SELECT z, x, y, v FROM cells", "cells")
oracle("unpack_pixels", "SELECT z, x, y, round(v, 6) AS v FROM emb", "emb")
oracle(
    "load_masked",
    """SELECT li.z, li.x, li.y, li.v, coalesce(m.w, 1.0::DOUBLE) AS weight FROM li LEFT JOIN (
         SELECT z, x, y, sum(l_quantity) AS w FROM lines WHERE l_returnflag = 'R' GROUP BY z, x, y) m
       ON m.z = li.z AND m.x = li.x AND m.y = li.y""",
    "li",
)
oracle(
    "stack_channels",
    """SELECT 'quantity' AS channel, z, x, y, v FROM li UNION ALL
       SELECT 'discount', z, x, y, sum(round(l_discount * 100)) FROM lines GROUP BY z, x, y""",
    "li",
)
oracle(
    "pack_channels",
    """SELECT z, x, y, sum(l_quantity) AS quantity, sum(round(l_discount * 100)) AS discount
       FROM lines GROUP BY z, x, y""",
    "lines",
)
oracle("write_sections", "SELECT z, x, y, round(v, 6) AS v FROM emb", "emb")
oracle("write_single", "SELECT z, x, y, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM es", "es")
oracle(
    "numbered_sections",
    """SELECT z - (SELECT n // 4 FROM en) AS z, count(v) AS pixels, round(avg(v), 6) AS v, true AS found FROM emb
       WHERE z >= (SELECT n // 4 FROM en) AND z < (SELECT 3 * n // 4 FROM en) GROUP BY z""",
    "emb",
    "en",
)
oracle("write_report", "SELECT vec_id AS z, CAST(len(embedding) AS BIGINT) AS pixels, true AS ok FROM embeddings")

# Filters, masks, pixel preparation

oracle(
    "filter_range",
    "SELECT z, x, y, v FROM li, ln WHERE z >= n // 4 AND z < 3 * n // 4",
    "li",
    "ln",
)
oracle(
    "band_filter",
    f"SELECT z1, z2, count(*) AS n, round({NCC}, 6) AS s FROM lpairs WHERE z1 - z2 <= 5 GROUP BY z1, z2",
    "lpairs",
)
oracle("replace_value", "SELECT z, x, y, nullif(v, 5) AS v FROM li", "li")
oracle(
    "mask_values",
    "SELECT z, x, y, v, CASE WHEN v IN (1, 2, 3) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM cells",
    "cells",
)
oracle(
    "mask_value_table",
    """SELECT z, x, y, v, CASE WHEN count(*) OVER (PARTITION BY v) < 50 THEN 0.0::DOUBLE
                               ELSE 1.0::DOUBLE END AS weight FROM li""",
    "li",
)
oracle(
    "mask_missing",
    "SELECT z, x, y, coalesce(v, 0) AS v, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM cells",
    "cells",
)
oracle("downsample", "SELECT z, x // 2 AS x, y // 2 AS y, round(avg(v), 6) AS v FROM li GROUP BY ALL", "li")
oracle(
    "downsample_masked",
    """SELECT z, x // 2 AS x, y // 2 AS y, round(avg(coalesce(v, 0)), 6) AS v,
              round(avg(CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS weight
       FROM cells GROUP BY ALL""",
    "cells",
)


def _taps(sigma: float) -> str:
    half = gaussian_taps(sigma)
    rows = [f"({t}, {half[abs(t)]!r}::DOUBLE)" for t in range(1 - len(half), len(half))]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS w(t, w)"


oracle(
    "gaussian_blur",
    "SELECT z, x, y, round(v, 6) + 0 AS v FROM blur",
    "emb",
    "pix",
    extra={
        "tx": _taps(1.0),
        "ty": _taps(0.5),
        "across": """SELECT e.z, p.x, p.y, sum(w * e.v) / sum(w) AS v FROM pix p CROSS JOIN tx
                     JOIN emb e ON e.y = p.y AND e.x = least(greatest(p.x + t, 0), 7) GROUP BY e.z, p.x, p.y""",
        "blur": """SELECT e.z, p.x, p.y, sum(w * e.v) / sum(w) AS v FROM pix p CROSS JOIN ty
                   JOIN across e ON e.x = p.x AND e.y = least(greatest(p.y + t, 0), 7) GROUP BY e.z, p.x, p.y""",
    },
)

# Block grid on the part x supplier plane


def _axis(name: str, column: str, radius: int, step: int) -> str:
    return f"""SELECT b AS b{name}, {radius} + b * {step} AS c{name} FROM
               unnest(generate_series(0, (SELECT max({column}) FROM lineitem))) AS u(b)
               WHERE {radius} + b * {step} < (SELECT max({column}) + 1 FROM lineitem)"""


AXES = {"ax": _axis("x", "l_partkey", 20, 20), "ay": _axis("y", "l_suppkey", 3, 2)}
FINE_AXES = {"ax": _axis("x", "l_partkey", 10, 5), "ay": _axis("y", "l_suppkey", 2, 1)}

oracle("block_grid", "SELECT bx, by, cx, cy FROM ax, ay", extra=AXES)
oracle(
    "world_to_local",
    """SELECT l_partkey AS x, l_suppkey AS y, l_quantity AS v,
              CAST(trunc((l_partkey - 20) / 20.0::DOUBLE) AS BIGINT) AS bx,
              CAST(trunc((l_suppkey - 3) / 2.0::DOUBLE) AS BIGINT) AS by FROM lineitem""",
)
oracle(
    "grid_translate",
    """SELECT bx, by, cx, cy, round((cx - 20) / 20.0::DOUBLE, 6) AS px, round((cy - 3) / 2.0::DOUBLE, 6) AS py
       FROM ax, ay""",
    extra=FINE_AXES,
)
for name, upper in (("block_members", "<"), ("block_members_closed", "<=")):
    oracle(
        name,
        f"""SELECT bx, by, count(*) AS n, sum(v) AS v FROM
              (SELECT l_partkey AS x, l_suppkey AS y, l_quantity AS v FROM lineitem)
            JOIN ax ON x >= cx - 20 AND x {upper} cx + 20 JOIN ay ON y >= cy - 3 AND y {upper} cy + 3
            GROUP BY bx, by""",
        extra=AXES,
    )

# Pairs

for name in ("pair_sections", "band_join"):
    oracle(name, "SELECT z1, z2, x, y, round(a, 6) AS a, round(b, 6) AS b FROM epairs", "epairs")
oracle(
    "chunk_halo",
    "SELECT z1 // 40 AS chunk, z1, z2, x, y, round(a, 6) AS a, round(b, 6) AS b FROM epairs",
    "epairs",
)

# Similarity

oracle(
    "section_ncc",
    f"SELECT z1, z2, count(*) AS n, round({NCC}, 6) AS s FROM lpairs WHERE z1 - z2 <= 5 GROUP BY z1, z2",
    "lpairs",
)
oracle(
    "pair_moments",
    """SELECT x // 4 AS tx, y // 4 AS ty, z1, z2, count(*) AS n, round(sum(a), 6) AS sa, round(sum(a * a), 6) AS saa,
              round(sum(b), 6) AS sb, round(sum(b * b), 6) AS sbb, round(sum(a * b), 6) AS sab
       FROM epairs GROUP BY ALL""",
    "epairs",
)
oracle("tiled_ncc", "SELECT z1, z2, count(*) AS n, round(corr(a, b), 6) AS s FROM epairs GROUP BY z1, z2", "epairs")
oracle(
    "stack_correlation",
    """SELECT z1, z2, s FROM one UNION ALL SELECT z2, z1, s FROM one UNION ALL SELECT z, z, 1.0::DOUBLE FROM lz""",
    "lpairs",
    "lz",
    extra={"one": f"SELECT z1, z2, round({NCC}, 6) AS s FROM lpairs WHERE z1 - z2 <= 5 GROUP BY z1, z2"},
)
for name in ("block_ncc", "block_ncc_packed", "merge_strips"):
    oracle(name, "SELECT bx, by, z1, z2, n, round(s, 6) AS s FROM sim", "sim")
oracle(
    "block_pair_map",
    """SELECT bx, by, z1, count(*) AS n, string_agg(z2::VARCHAR, ',' ORDER BY z2) AS z2s, round(sum(s), 6) AS total
       FROM sim GROUP BY bx, by, z1""",
    "sim",
)
oracle("explode_map", "SELECT bx, by, z1, z2, round(s, 6) AS s FROM sim", "sim")
for name in ("similarity_matrix", "strip_to_matrix"):
    oracle(
        name,
        """SELECT bx, by, z1, z2, round(s, 6) AS s FROM sim
           UNION ALL SELECT bx, by, z2, z1, round(s, 6) FROM sim
           UNION ALL SELECT bx, by, z, z, 1.0::DOUBLE FROM blk, ez""",
        "sim",
        "ez",
    )
oracle(
    "band_strip",
    """SELECT blk.bx, blk.by, ez.z, k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE round(sim.s, 6) END AS s,
              (ez.z + k >= 0 AND ez.z + k < en.n) AS in_bounds
       FROM en, blk, ez CROSS JOIN generate_series(-5, 5) AS g(k)
       LEFT JOIN sim ON sim.bx = blk.bx AND sim.by = blk.by
        AND sim.z1 = greatest(ez.z, ez.z + k) AND sim.z2 = least(ez.z, ez.z + k)""",
    "sim",
    "ez",
    "en",
)

# Translation tolerance: offsets and window radius 1 in both directions.
TOLERANT = {
    "off": "SELECT i % 3 - 1 AS dx, i // 3 - 1 AS dy FROM generate_series(0, 8) AS g(i)",
    "prod": """SELECT p.z AS z1, q.z AS z2, dx, dy, q.x, q.y, p.v AS a, q.v AS b FROM es q CROSS JOIN off
               JOIN es p ON p.x = q.x + dx AND p.y = q.y + dy AND q.z < p.z AND q.z >= p.z - 5""",
    "win": f"""SELECT z1, z2, dx, dy, c.x, c.y, {NCC} AS s FROM pix c CROSS JOIN off o
               JOIN prod USING (dx, dy)
               WHERE prod.x BETWEEN c.x - 1 AND c.x + 1 AND prod.y BETWEEN c.y - 1 AND c.y + 1
                 AND c.x >= 1 AND c.x <= 7 AND c.y >= 1 AND c.y <= 7
                 AND c.x + dx >= 1 AND c.x + dx <= 7 AND c.y + dy >= 1 AND c.y + dy <= 7
               GROUP BY z1, z2, dx, dy, c.x, c.y""",
    "tol": """SELECT b.z1, b.z2, b.x, b.y, coalesce(m.s, 0) AS s,
                     CASE WHEN b.x BETWEEN 1 AND 6 AND b.y BETWEEN 1 AND 6 THEN 1.0::DOUBLE END AS weight
              FROM (SELECT z1, z2, x, y FROM prod WHERE dx = 0 AND dy = 0) b LEFT JOIN (
                SELECT z1, z2, x, y, greatest(max(s), 0) AS s FROM win GROUP BY z1, z2, x, y) m
              ON m.z1 = b.z1 AND m.z2 = b.z2 AND m.x = b.x AND m.y = b.y""",
}
oracle("tolerant_ncc", "SELECT z1, z2, x, y, round(s, 6) AS s, weight FROM tol", "es", "pix", extra=TOLERANT)
oracle(
    "tolerant_matrix",
    """SELECT bx, by, z1, z2, s FROM t UNION ALL SELECT bx, by, z2, z1, s FROM t
       UNION ALL SELECT bx, by, z, z, 1.0::DOUBLE FROM blk, ez""",
    "es",
    "cmemb",
    "ez",
    extra={
        **TOLERANT,
        "t": """SELECT bx, by, z1, z2, round(sum(weight * s) / sum(weight), 6) AS s FROM tol JOIN cmemb USING (x, y)
                WHERE weight IS NOT NULL GROUP BY bx, by, z1, z2""",
    },
)
oracle(
    "block_average",
    "SELECT bx, by, z, round(avg(v), 6) AS v FROM cells JOIN cmemb USING (x, y) WHERE v IS NOT NULL GROUP BY bx, by, z",
    "cells",
    "cmemb",
)

# Coordinates

oracle(
    "init_coords",
    "SELECT CAST(0 AS BIGINT) AS bx, CAST(0 AS BIGINT) AS by, z, CAST(z AS DOUBLE) AS c FROM ez",
    "ez",
)
FINE_MAP = {
    "map": """SELECT i % 7 AS bx, i // 7 AS by, (i % 7 - 1) / 2.0::DOUBLE AS px, (i // 7 - 1) / 2.0::DOUBLE AS py
              FROM generate_series(0, 48) AS g(i)"""
}
oracle(
    "interp_nearest",
    """SELECT m.bx, m.by, lut.z, lut.c FROM map m JOIN lut
       ON lut.bx <= m.px + 0.5 AND lut.bx > m.px - 0.5 AND lut.by <= m.py + 0.5 AND lut.by > m.py - 0.5""",
    "lut",
    extra=FINE_MAP,
)
oracle(
    "interp_linear",
    """SELECT m.bx, m.by, lut.z,
              round(sum((1 - abs(px - lut.bx)) * (1 - abs(py - lut.by)) * c)
                    / sum((1 - abs(px - lut.bx)) * (1 - abs(py - lut.by))), 6) AS c
       FROM map m JOIN lut ON abs(px - lut.bx) <= 1 AND abs(py - lut.by) <= 1 GROUP BY m.bx, m.by, lut.z""",
    "lut",
    extra=FINE_MAP,
)
oracle(
    "quality_gate",
    """SELECT blk.bx, blk.by, coalesce(t.good, 0) = (SELECT 5 * n - 15 FROM ln) AS ok FROM blk LEFT JOIN (
         SELECT bx, by, count(*) FILTER (s != 0) AS good FROM (
           SELECT bx, by, z1, z2, {ncc} AS s FROM lpairs JOIN memb USING (x, y) WHERE z1 - z2 <= 5
           GROUP BY bx, by, z1, z2) GROUP BY bx, by) t ON t.bx = blk.bx AND t.by = blk.by""".format(ncc=NCC),
    "lpairs",
    "memb",
    "ln",
)
oracle(
    "quality_gate_mixed",
    """SELECT blk.bx, blk.by, coalesce(t.good, 0) = (SELECT 5 * n - 15 FROM en) AS ok FROM blk LEFT JOIN (
         SELECT bx, by, count(*) FILTER (s >= (SELECT avg(low) FROM (SELECT min(s) AS low FROM sim GROUP BY bx, by)) AND s != 0) AS good
         FROM sim GROUP BY bx, by) t ON t.bx = blk.bx AND t.by = blk.by""",
    "sim",
    "blk",
    "en",
)
oracle(
    "dense_rows",
    """SELECT r.bx, r.by, r.z1, r.z2 - greatest(r.z1 - 5, 0) AS i, round(CASE WHEN r.z1 = r.z2 THEN 1.0::DOUBLE ELSE m.s END, 6) AS s
       FROM (SELECT bx, by, a.z AS z1, b.z AS z2 FROM blk, ez a, ez b WHERE abs(a.z - b.z) <= 5) r
       LEFT JOIN sim m ON m.bx = r.bx AND m.by = r.by AND m.z1 = greatest(r.z1, r.z2) AND m.z2 = least(r.z1, r.z2)""",
    "sim",
    "blk",
    "ez",
)
oracle(
    "status_grid",
    "SELECT bx, by, CASE WHEN count(*) > count(c) THEN 127 ELSE 0 END AS status FROM flut GROUP BY bx, by",
    "flut",
)

EDGES = {
    "edge": """SELECT bx, by, z1 AS z, z2 AS zr, s FROM sim WHERE s IS NOT NULL
               UNION ALL SELECT bx, by, z2, z1, s FROM sim WHERE s IS NOT NULL"""
}


def _curve(source: str, keys: str) -> str:
    """Falling curve rows (keys, d, f) for d = 0..5 from (keys, d, sp) edges."""
    k = ", ".join(f"k.{c}" for c in keys.split(", "))
    on = " AND ".join(f"b.{c} = k.{c}" for c in keys.split(", "))
    return f"""
      SELECT {keys}, d, min(f) OVER (PARTITION BY {keys} ORDER BY d) AS f FROM (
        SELECT {k}, r.d, CASE WHEN r.d = 0 THEN 1.0::DOUBLE ELSE b.f END AS f
        FROM (SELECT DISTINCT {keys} FROM {source}) k CROSS JOIN generate_series(0, 5) AS r(d)
        LEFT JOIN (SELECT {keys}, bin, sum(w * sp) / sum(w) AS f FROM (
                     SELECT {keys}, CAST(floor(d) AS BIGINT) AS bin, 1 - (d - floor(d)) AS w, sp FROM {source}
                     UNION ALL
                     SELECT {keys}, CAST(floor(d) AS BIGINT) + 1, d - floor(d), sp FROM {source})
                   WHERE w > 0 AND bin <= 5 GROUP BY {keys}, bin) b ON {on} AND b.bin = r.d)"""


oracle(
    "decay_curve",
    "SELECT bx, by, d, round(f, 6) AS f FROM cur",
    "sim",
    extra={
        **EDGES,
        "dist": "SELECT bx, by, z, abs(z - zr)::DOUBLE AS d, s AS sp FROM edge",
        "cur": _curve("dist", "bx, by"),
    },
)
LOCAL = """SELECT e.bx, e.by, t.z, e.d, e.sp FROM {src} e JOIN ez t ON t.z BETWEEN e.z - 3 AND e.z + 3"""
oracle(
    "decay_curve_local",
    "SELECT bx, by, z, d, round(f, 6) AS f FROM cur",
    "sim",
    "ez",
    extra={
        **EDGES,
        "dist": "SELECT bx, by, z, abs(z - zr)::DOUBLE AS d, s AS sp FROM edge",
        "near": LOCAL.format(src="dist"),
        "cur": _curve("near", "bx, by, z"),
    },
)


def _inference(
    rounds: int,
    inner: int,
    local: bool,
    border: bool,
    tag: str = "",
    sim: str = "sim",
    start: str = "SELECT bx, by, z, z::DOUBLE AS c FROM blk, ez",
    hold: float = 0.0,
    reorder: bool = False,
) -> dict[str, str]:
    """Rounds of curve, multipliers, votes and update, one CTE per step.

    ``hold`` is the weight of the start coordinates; ``tag`` prefixes the names; with
    ``reorder`` coordinates are put in order along their ranks.
    """
    t = tag
    out = {f"{t}edge": EDGES["edge"].replace("FROM sim", f"FROM {sim}")}
    out[f"{t}st0"] = f"SELECT bx, by, z, c, 1.0::DOUBLE AS m FROM ({start})"
    keys = "bx, by, z" if local else "bx, by"
    on_curve = " AND ".join(f"{{0}}.{c} = e.{c}" for c in keys.split(", "))
    lo, hi, on_seg = on_curve.format("lo"), on_curve.format("hi"), on_curve.format("g")
    for i in range(1, rounds + 1):
        st, pl, cu, fd = f"{t}st{i - 1}", f"{t}pl{i}", f"{t}cu{i}", f"{t}fd{i}"
        out[pl] = f"""SELECT e.bx, e.by, e.z, e.zr, e.s, p.c AS cz, q.c AS cr, abs(p.c - q.c) AS d,
              e.s * p.m * q.m AS sp FROM {t}edge e
            JOIN {st} p ON p.bx = e.bx AND p.by = e.by AND p.z = e.z
            JOIN {st} q ON q.bx = e.bx AND q.by = e.by AND q.z = e.zr"""
        if local:
            out[f"{t}nr{i}"] = LOCAL.format(src=pl)
        out[cu] = _curve(f"{t}nr{i}" if local else pl, keys)
        out[fd] = f"""SELECT e.*, lo.f + (hi.f - lo.f) * least(e.d - lo.d, 1) AS fd FROM {pl} e
            JOIN {cu} lo ON {lo} AND lo.d = least(floor(e.d), 5)
            JOIN {cu} hi ON {hi} AND hi.d = least(lo.d + 1, 5)"""
        m = st
        for j in range(1, inner + 1):
            new = f"{t}m{i}_{j}"
            out[new] = f"""SELECT bx, by, z, 0.9::DOUBLE * num / den + 0.1::DOUBLE AS m FROM (
                SELECT e.bx, e.by, e.z, sum(e.fd * e.s * q.m) AS num, sum(e.s * q.m * e.s * q.m) AS den
                FROM {fd} e JOIN {m} q ON q.bx = e.bx AND q.by = e.by AND q.z = e.zr GROUP BY e.bx, e.by, e.z)"""
            m = new
        segs = f"SELECT {keys}, d, f, lead(f) OVER (PARTITION BY {keys} ORDER BY d) AS f1 FROM {cu}"
        out[f"{t}sc{i}"] = f"""SELECT e.bx, e.by, e.z, e.zr, e.cz, e.cr, e.s * p.m * q.m AS sp FROM {pl} e
            JOIN {m} p ON p.bx = e.bx AND p.by = e.by AND p.z = e.z
            JOIN {m} q ON q.bx = e.bx AND q.by = e.by AND q.z = e.zr"""
        out[f"{t}sh{i}"] = f"""SELECT e.bx, e.by, e.z,
              avg(e.cr + sign(e.cz - e.cr) * (g.d + (g.f - e.sp) / (g.f - g.f1)) - e.cz) AS shift
            FROM {t}sc{i} e JOIN ({segs}) g ON {on_seg} AND g.f >= e.sp AND e.sp > g.f1
            GROUP BY e.bx, e.by, e.z"""
        out[f"{t}mv{i}"] = f"""SELECT a.bx, a.by, a.z, w.m,
              (1 - {hold}::DOUBLE) * (a.c + 0.6::DOUBLE * coalesce(h.shift, 0)) + {hold}::DOUBLE * o.c AS c
            FROM {st} a JOIN {t}st0 o ON o.bx = a.bx AND o.by = a.by AND o.z = a.z
            JOIN {m} w ON w.bx = a.bx AND w.by = a.by AND w.z = a.z
            LEFT JOIN {t}sh{i} h ON h.bx = a.bx AND h.by = a.by AND h.z = a.z"""
        monotone = f"""SELECT bx, by, z, m,
              max(c - z * 1e-8::DOUBLE) OVER (PARTITION BY bx, by ORDER BY z) + z * 1e-8::DOUBLE AS c FROM {t}mv{i}"""
        if reorder:
            monotone = f"""SELECT bx, by, z, m, max(c - r * 1e-8::DOUBLE) OVER (PARTITION BY bx, by ORDER BY r) + r * 1e-8::DOUBLE AS c
              FROM (SELECT *, row_number() OVER (PARTITION BY bx, by ORDER BY c, z) - 1 AS r FROM {t}mv{i})"""
        out[f"{t}st{i}"] = monotone
        if border:
            out[f"{t}mo{i}"] = monotone
            out[f"{t}st{i}"] = f"""SELECT a.bx, a.by, a.z, a.m, first + (a.c - f) * (last - first) / (l - f) AS c
              FROM {t}mo{i} a JOIN (SELECT bx, by, min_by(c, z) AS f, max_by(c, z) AS l FROM {t}mo{i} GROUP BY bx, by) e
                ON e.bx = a.bx AND e.by = a.by
              JOIN (SELECT bx, by, min_by(c, z) AS first, max_by(c, z) AS last FROM {t}st0 GROUP BY bx, by) o
                ON o.bx = a.bx AND o.by = a.by"""
            out[f"{t}st{i}"] = out.pop(f"{t}st{i}")
    return out


oracle(
    "infer_coords",
    "SELECT bx, by, z, round(c, 6) AS c FROM st2",
    "sim",
    "ez",
    extra=_inference(2, 2, False, True),
)
oracle(
    "infer_coords_local",
    "SELECT bx, by, z, round(c, 6) AS c FROM st2",
    "sim",
    "ez",
    extra=_inference(2, 2, True, False),
)
oracle(
    "infer_coords_reorder",
    "SELECT bx, by, z, round(c, 6) AS c FROM st2",
    "sim",
    "ez",
    extra=_inference(2, 2, False, False, reorder=True),
)
oracle(
    "infer_trace",
    """SELECT CAST(0 AS BIGINT) AS iter, bx, by, z, round(c, 6) AS c FROM st0
       UNION ALL SELECT 1, bx, by, z, round(c, 6) FROM st1 UNION ALL SELECT 2, bx, by, z, round(c, 6) FROM st2""",
    "sim",
    "ez",
    extra=_inference(2, 2, False, True),
)
oracle("cols_to_sections", "SELECT bx, by, z, c FROM flut", "flut")
oracle(
    "sections_to_cols",
    """SELECT bx, by, z // 100 * 100 AS z0, count(*) AS n,
              string_agg(CAST(c * 4 AS BIGINT)::VARCHAR, ',' ORDER BY z) AS quarters
       FROM lut GROUP BY bx, by, z // 100""",
    "lut",
)
oracle("lut_to_images", "SELECT z, bx, by, coalesce(c, 0) AS c FROM flut WHERE bx < 2", "flut")

# Repair


def _fill(passes: int) -> dict[str, str]:
    out = {
        "nb": """SELECT i % 3 - 1 AS dx, i // 3 - 1 AS dy,
                        CASE WHEN i % 3 = 1 OR i // 3 = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w
                 FROM generate_series(0, 8) AS g(i) WHERE i != 4""",
        "p0": "SELECT z, x, y, v FROM cells",
    }
    for i in range(1, passes + 1):
        before = f"p{i - 1}"
        out[f"p{i}"] = f"""SELECT z, x, y, v FROM {before} WHERE v IS NOT NULL
            UNION ALL SELECT h.z, h.x, h.y, sum(w * q.v) / sum(CASE WHEN q.v IS NOT NULL THEN w END)
            FROM {before} h CROSS JOIN nb LEFT JOIN {before} q ON q.z = h.z AND q.x = h.x + dx AND q.y = h.y + dy
            WHERE h.v IS NULL GROUP BY h.z, h.x, h.y"""
    return out


oracle("fill_holes", "SELECT z, x, y, round(v, 6) AS v FROM p8", "cells", extra=_fill(8))
oracle("invert_lut", "SELECT bx, by, z, round(c, 6) AS c FROM inv", "inv")

# Rendering

oracle("upsample_lut", "SELECT z, x, y, round(p, 6) AS p FROM crd", "crd", "lz")
oracle(
    "required_sections",
    """SELECT z AS target, CAST(floor(p) AS BIGINT) AS source FROM crd WHERE p IS NOT NULL
       UNION SELECT z, CAST(ceil(p) AS BIGINT) FROM crd WHERE p IS NOT NULL""",
    "crd",
    "lz",
)


def _mixed(source: str, renormalise: bool, top: str) -> str:
    """Value at p between sections floor(p) and floor(p) + 1."""
    lo, hi = "(1 - (t.p - floor(t.p)))", "(t.p - floor(t.p))"
    if renormalise:
        value = f"""(CASE WHEN a.z IS NULL THEN 0 ELSE {lo} * a.v END + CASE WHEN b.z IS NULL THEN 0 ELSE {hi} * b.v END)
                    / nullif(CASE WHEN a.z IS NULL THEN 0 ELSE {lo} END + CASE WHEN b.z IS NULL THEN 0 ELSE {hi} END, 0)"""
    else:
        value = f"CASE WHEN {hi} = 0 THEN a.v ELSE {lo} * a.v + {hi} * b.v END"
    return f"""SELECT t.z, t.x, t.y, round({value}, 6) AS v FROM
        (SELECT z, x, y, CASE WHEN p BETWEEN 0 AND {top} THEN p END AS p FROM crd) t
        LEFT JOIN {source} a ON a.z = floor(t.p) AND a.x = t.x AND a.y = t.y
        LEFT JOIN {source} b ON b.z = floor(t.p) + 1 AND b.x = t.x AND b.y = t.y"""


KEPT = """SELECT m.* FROM ({mixed}) m WHERE m.z IN (
            SELECT z FROM crd WHERE floor(p) IN (SELECT z FROM {source}) OR ceil(p) IN (SELECT z FROM {source}))"""
LAST = "(SELECT n - 1 FROM ln)"


def _render(name: str, source: str, *needs: str, extra: dict[str, str] | None = None, **params) -> None:
    body = KEPT.format(mixed=_mixed(source, True, LAST), source=source)
    oracle(name, body, *needs, "lz", "inv", extra={**(extra or {}), "crd": CTES["crd"][1].format(**{**DEFAULTS, **params})})


_render("render", "li", "li", "ln")
_render("render_scaled", "li16", "li16", "ln", side=16, scale="2.0::DOUBLE")
oracle(
    "transform_roundtrip",
    "SELECT * FROM (" + KEPT.format(mixed=_mixed("fwd", True, LAST), source="fwd") + ") WHERE x < 3 AND y < 3",
    "lut",
    "inv",
    "ln",
    extra={
        "fwd": "SELECT z, bx AS x, by AS y, c AS v FROM lut",
        "crd": CTES["crd"][1].format(**{**DEFAULTS, "side": 3}),
    },
)
oracle(
    "estimation_job",
    """SELECT b.stage, b.bx, b.by, n AS sections, true AS rising, n + 2 * (5 * n - 15) AS entries FROM en, (
         SELECT 0::BIGINT AS stage, 0::BIGINT AS bx, 0::BIGINT AS by
         UNION ALL SELECT 1, i % 2, i // 2 FROM generate_series(0, 3) AS g(i)) b""",
    "en",
)
# A target's position is 2 p from the middle of the stack on, with p where twice the coordinates reach its number.
EINV = """SELECT b.bx, b.by, b.z, 2 * min(CASE WHEN s.z IS NULL THEN NULL
                                              WHEN s.c1 > s.c THEN s.z + (b.z - s.c) / (s.c1 - s.c) ELSE s.z END)
                            + (SELECT n // 2 FROM en) AS c
          FROM elut b LEFT JOIN (SELECT bx, by, z, 2 * c AS c, 2 * lead(c) OVER (PARTITION BY bx, by ORDER BY z) AS c1 FROM elut) s
            ON s.bx = b.bx AND s.by = b.by
           AND ((s.c1 > s.c AND b.z >= s.c AND b.z < s.c1) OR (s.c1 IS NULL AND b.z = s.c))
          GROUP BY b.bx, b.by, b.z"""
oracle(
    "render_job",
    """SELECT ez.z, CASE WHEN k.z IS NULL THEN 0 ELSE 64 END AS pixels, k.z IS NOT NULL AS ok FROM ez LEFT JOIN (
         SELECT DISTINCT z FROM crd WHERE floor(p) IN (SELECT z FROM ez) OR ceil(p) IN (SELECT z FROM ez)) k ON k.z = ez.z""",
    "elut",
    "ez",
    extra={"lz": "SELECT z FROM ez", "inv": EINV, "crd": CTES["crd"][1].format(**DEFAULTS)},
)
oracle("warp_volume", _mixed("li", False, LAST), "li", "ln", "lz", "crd")
oracle(
    "warp_matrix",
    """SELECT bx, by, z1, z2, round(s, 6) AS s FROM (
         SELECT i.bx, i.by, i.z AS z1, j.z AS z2, sum(mat.s * i.w * j.w) AS s, sum(i.w * j.w) AS w
         FROM mat JOIN near i ON i.bx = mat.bx AND i.by = mat.by AND i.k = mat.z1
                  JOIN near j ON j.bx = mat.bx AND j.by = mat.by AND j.k = mat.z2
         GROUP BY i.bx, i.by, i.z, j.z) WHERE abs(w - 1) < 1e-9""",
    "sim",
    "ez",
    "elut",
    extra={
        "einv": CTES["inv"][1].replace("lut", "elut"),
        "near": """SELECT bx, by, z, CAST(floor(c) AS BIGINT) AS k, 1 - (c - floor(c)) AS w FROM einv
                   WHERE c IS NOT NULL UNION ALL
                   SELECT bx, by, z, CAST(floor(c) AS BIGINT) + 1, c - floor(c) FROM einv WHERE c > floor(c)""",
        "mat": """SELECT bx, by, z1, z2, s FROM sim UNION ALL SELECT bx, by, z2, z1, s FROM sim
                  UNION ALL SELECT bx, by, z, z, 1.0::DOUBLE FROM blk, ez""",
    },
)

# Pipeline: one block over the whole section, then 3 x 3 blocks started from it.


def _pipeline() -> dict[str, str]:
    first = _inference(2, 2, False, True, tag="a", sim="whole", start="SELECT 0 AS bx, 0 AS by, z, z::DOUBLE AS c FROM ez")
    second = _inference(
        2, 2, False, False, tag="b", sim="sim", start="SELECT blk.bx, blk.by, z, c FROM blk, (SELECT z, c FROM ast2)",
        hold=0.1,
    )
    whole = f"SELECT 0 AS bx, 0 AS by, z1, z2, {NCC} AS s FROM spairs GROUP BY z1, z2"
    return {"whole": whole, **first, **second, "back": CTES["inv"][1].replace("FROM lut", "FROM bst2")}


oracle(
    "estimate_stages",
    """SELECT f.bx, f.by, f.z, round(f.c, 6) AS c, round(b.c, 6) AS backward FROM bst2 f
       JOIN back b ON b.bx = f.bx AND b.by = f.by AND b.z = f.z""",
    "sim",
    "ez",
    extra=_pipeline(),
)
oracle(
    "stage_report",
    """SELECT CAST(0 AS BIGINT) AS stage, count(*) AS blocks, count(*) FILTER (lost > 0) AS failed FROM (
         SELECT bx, by, count(*) - count(c) AS lost FROM ast2 GROUP BY bx, by)
       UNION ALL SELECT 1, count(*), count(*) FILTER (lost > 0) FROM (
         SELECT bx, by, count(*) - count(c) AS lost FROM bst2 GROUP BY bx, by)""",
    "sim",
    "ez",
    extra=_pipeline(),
)
