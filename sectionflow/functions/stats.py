"""Correlation moments and missing-value helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("n", "sa", "saa", "sb", "sbb", "sab")

# Centred moments: pairs counted, means, sums of squares and of products about the means.
CENTRED = ("n", "ma", "mb", "qa", "qb", "cab")

# Square of the relative spacing of doubles, rounded up generously: what is left of a constant.
TINY = 1e-24


def present(value: Column) -> Column:
    """NaN to NULL; the only place where NaN is looked at."""
    return F.when(~F.isnan(value), value)


def moment_aggs(a: str = "a", b: str = "b") -> list[Column]:
    """Six mergeable sums over rows where both sides are present."""
    a_, b_ = F.col(a), F.col(b)
    both = a_.isNotNull() & b_.isNotNull()
    pick = lambda e: F.coalesce(F.sum(F.when(both, e)), F.lit(0.0))
    return [
        F.count(F.when(both, F.lit(1))).alias("n"),
        pick(a_).alias("sa"),
        pick(a_ * a_).alias("saa"),
        pick(b_).alias("sb"),
        pick(b_ * b_).alias("sbb"),
        pick(a_ * b_).alias("sab"),
    ]


def centred_aggs(a: str = "a", b: str = "b") -> list[Column]:
    """``CENTRED`` over rows where both sides are present; a large offset does not cancel."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    one, two = (F.when(both, F.col(c)) for c in (a, b))
    n = F.count(F.when(both, F.lit(1)))
    none = F.lit(0.0)
    return [
        n.alias("n"),
        F.coalesce(F.avg(one), none).alias("ma"),
        F.coalesce(F.avg(two), none).alias("mb"),
        F.coalesce(F.var_pop(one) * n, none).alias("qa"),
        F.coalesce(F.var_pop(two) * n, none).alias("qb"),
        F.coalesce(F.covar_pop(a, b) * n, none).alias("cab"),
    ]


def _joined(one: Column, two: Column) -> Column:
    """Two sets of centred moments as one, by the distances of their means."""
    n = one["n"] + two["n"]
    share = F.when(n > 0, two["n"] / n).otherwise(0.0)
    da, db, both = two["ma"] - one["ma"], two["mb"] - one["mb"], one["n"] * share
    return F.struct(
        n.alias("n"),
        (one["ma"] + da * share).alias("ma"),
        (one["mb"] + db * share).alias("mb"),
        (one["qa"] + two["qa"] + da * da * both).alias("qa"),
        (one["qb"] + two["qb"] + db * db * both).alias("qb"),
        (one["cab"] + two["cab"] + da * db * both).alias("cab"),
    )


def merge_centred(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``CENTRED`` of all rows of a key, which must be few: they are merged one by one."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), *(F.lit(0.0).alias(c) for c in CENTRED[1:]))
    found = rows.groupBy(*keys).agg(F.collect_list(F.struct(*CENTRED)).alias("_parts"))
    return found.select(*keys, F.aggregate("_parts", zero, _joined).alias("_m")).select(*keys, "_m.*")


def merge_centred_tree(
    rows: DataFrame, keys: Sequence[str], place: tuple[str, str], side: int, span: tuple[int, int], partitions: int | None = None
) -> DataFrame:
    """``CENTRED`` of the rows of a key that are spread over an area of ``span`` positions.

    ``place`` names the columns with a row's position.  Squares of ``side`` positions are
    merged first, then eight by eight squares at a time, so that no group grows with
    the area.  With ``partitions`` the rows of a step meet in that many.
    """
    def met(rows: DataFrame, keys: list[str]) -> DataFrame:
        return merge_centred(rows.repartition(partitions, *keys) if partitions else rows, keys)

    while max(span) > side:
        square = [F.expr(f"{c} div {side} * {side}").alias(c) for c in place]
        rows = met(rows.select(*keys, *CENTRED, *square), [*keys, *place])
        side *= 8
    return met(rows.select(*keys, *CENTRED), list(keys))


def ncc() -> Column:
    """Pearson correlation from ``CENTRED`` columns; NULL when a side does not vary."""
    n, ma, mb, qa, qb, cab = (F.col(c) for c in CENTRED)
    varies = (qa > TINY * n * ma * ma) & (qb > TINY * n * mb * mb)
    return F.when(varies, cab / F.sqrt(qa) / F.sqrt(qb))


def centred_ncc(a: str = "a", b: str = "b") -> Column:
    """The same as an aggregate over pairs, by centred moments, which a large offset does not cancel.

    A constant side has variance 0 exactly, or next to it where partial results merge.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    va, vb = (F.var_pop(F.when(both, F.col(c))) for c in (a, b))
    ma, mb = (F.avg(F.when(both, F.col(c))) for c in (a, b))
    varies = (va > TINY * ma * ma) & (vb > TINY * mb * mb)
    return F.when(varies, F.covar_pop(a, b) / F.sqrt(va) / F.sqrt(vb))


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(w*v)/sum(w) over present values; NULL when the weights add to 0."""
    w = F.when(value.isNotNull(), weight)
    total = F.sum(w)
    return F.when(total != 0, F.sum(w * value) / total)
