"""Mixing sources to target weights by temperature, realised as block permutations.

A source's weight is its share of the tokens to the power of an exponent, brought
to sum 1.  The exponent is the largest in [0, 1] (closest to the sources' own
shares) that reaches a target entropy, or else the smallest that keeps every
source within a limit of repetitions; an interval that holds it is cut again and
again.  The budget of a source is met by whole passes over its documents and one
partial pass; a pass is a permutation by a hash.  The stream of each source is
spread evenly over the blocks, so that every block has the target weights.

Only DataFrame operations are used.  A partial pass ends at a hash value, found
from sums by hash prefix and then within one prefix, so no source is ordered as a
whole, and documents are compared with it where they lie.

Defined cases: a NULL source is a source of its own; texts that are NULL or have
no words have 0 tokens: they are drawn like other documents of their source but
take nothing of the budget; a source without any token has weight 0 and each of
its documents is drawn once; repeated rows are drawn each; an empty table gives
an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.session import materialize

STEPS = 32  # parts of the interval of the exponent in each round
ROUNDS = 8
PREFIX_BITS = 12
HASH_BITS = 48
BLOCK_TOKENS = 1 << 20
ADDED = ("pass_no", "block", "slot", "weight", "mix_plan")


def n_tokens(text: str = "text") -> Column:
    """Words between ASCII white space, counted without an array of them."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int) -> Column:
    """Place of a document in the permutation of its source: a hash of its id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - HASH_BITS)


def narrow(docs: DataFrame, seed: int) -> DataFrame:
    """Columns source, h, n: what the plan needs of each document, without its text."""
    return docs.select("source", order_hash(seed).alias("h"), n_tokens().alias("n"))


def source_tokens(rows: DataFrame) -> DataFrame:
    """Columns source, tokens, docs."""
    return rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


def tempered(sources: DataFrame, exponents: list[float]) -> DataFrame:
    """Columns a, source, tokens, w: weights of all sources for each exponent."""
    every = sources.agg(F.sum("tokens")).first()[0]
    raw = sources.where("tokens > 0").select("source", "tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    raw = raw.withColumn("raw", F.pow(F.col("tokens") / F.lit(every), "a"))
    sums = raw.groupBy("a").agg(F.sum("raw").alias("sum"))  # a row for each exponent
    return raw.join(F.broadcast(sums), "a").select("a", "source", "tokens", (F.col("raw") / F.col("sum")).alias("w"))


def fit_exponent(sources: DataFrame, entropy: float, passes: float, budget: int) -> float:
    """Exponent that meets the target entropy as a share of the largest possible, within the limit of passes.

    Entropy falls and the largest number of passes over a source falls as the
    exponent grows, so each bound holds on one side of a value, which is enclosed in
    ``ROUNDS`` rounds of ``STEPS`` parts.  If both cannot be met the limit of passes
    comes first.
    """
    count = sources.where("tokens > 0").count()
    if count < 2:
        return 1.0

    def judge(low: float, high: float) -> list:
        by = tempered(sources, [low + i * (high - low) / STEPS for i in range(STEPS + 1)]).groupBy("a")
        bits = by.agg((-F.sum(F.col("w") * F.ln("w"))).alias("h"), F.max(F.col("w") * budget / F.col("tokens")).alias("p"))
        return bits.orderBy("a").collect()  # STEPS + 1 rows

    def enclose(holds, rising: bool) -> float:
        """Largest exponent for which ``holds``, or the smallest if it holds from there on."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            rows = judge(low, high)
            good = [r["a"] for r in rows if holds(r)]
            bad = [r["a"] for r in rows if not holds(r)]
            if not bad:
                return low if rising else high
            if not good:
                return high if rising else low
            low, high = (max(bad), min(good)) if rising else (max(good), min(bad))
        return high if rising else low

    target = entropy * math.log(count)
    by_entropy = enclose(lambda r: r["h"] >= target, rising=False)
    by_passes = enclose(lambda r: r["p"] <= passes, rising=True)
    return max(by_entropy, by_passes)


def source_weights(sources: DataFrame, entropy: float, passes: float, budget: int) -> DataFrame:
    """Columns source, tokens, docs, weight, passes: the plan of the mixture."""
    exponent = fit_exponent(sources, entropy, passes, budget)
    weights = tempered(sources, [exponent]).select(F.col("source").alias("s"), F.col("w").alias("weight"))
    joined = sources.join(weights, F.col("source").eqNullSafe(F.col("s")), "left")
    weight = F.coalesce("weight", F.lit(0.0))
    # a limit that the exponent cannot meet (all sources together are too small) still holds
    wanted = F.when(F.col("tokens") > 0, F.least(weight * budget / F.col("tokens"), F.lit(float(passes))))
    wanted = F.round(wanted, 9)  # a whole pass must not lack its last document by rounding
    return joined.select("source", "tokens", "docs", weight.alias("weight"), F.coalesce(wanted, F.lit(1.0)).alias("passes"))


def partial_ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Columns source, end: documents whose hash is below ``end`` belong to the partial pass of their source.

    The pass takes documents by hash as long as all of them fit; documents with one
    hash belong together.
    """
    shift = HASH_BITS - PREFIX_BITS
    sums = rows.groupBy("source", F.shiftright("h", shift).alias("prefix")).agg(F.sum("n").alias("n"))
    sums = materialize(sums, "mix-prefixes")
    rest = plan.select(F.col("source").alias("s"), ((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("rest"))
    so_far = Window.partitionBy("source").orderBy("prefix")  # at most 2 ** PREFIX_BITS rows a source
    sums = sums.withColumn("until", F.sum("n").over(so_far)).join(rest, F.col("source").eqNullSafe(F.col("s")))
    # the first prefix that does not fit as a whole
    cut = sums.where("until > rest").groupBy("s").agg(
        F.min(F.struct("prefix", (F.col("rest") - F.col("until") + F.col("n")).alias("room"))).alias("c")
    )
    cut = materialize(cut.select("s", "c.prefix", "c.room"), "mix-cuts")
    inside = rows.withColumn("prefix", F.shiftright("h", shift)).withColumnRenamed("prefix", "p")
    inside = inside.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("p") == F.col("prefix")))
    each = inside.groupBy("s", "h", "room").agg(F.sum("n").alias("n"))
    each = each.withColumn("until", F.sum("n").over(Window.partitionBy("s").orderBy("h"))).where("until > room")
    return each.groupBy("s").agg(F.min("h").alias("end"))


def mix(
    docs: DataFrame,
    entropy: float = 0.9,
    passes: float = 4.0,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 1,
) -> DataFrame:
    """The mixture: all columns of ``docs``, and pass_no, block, slot, weight; one row for each draw.

    Columns of ``docs`` with one of the added names are replaced.

    ``entropy`` is the target as a share of the largest possible, ``passes`` the limit
    of repetitions, ``budget`` the tokens of the mixture (by default as many as the
    documents have).  Read by block, then slot, the rows are the training order.
    """
    rows = materialize(narrow(docs, seed), "mix-rows")
    sources = materialize(source_tokens(rows), "mix-sources")
    budget = budget or int(sources.agg(F.sum("tokens")).first()[0] or 0)
    plan = materialize(source_weights(sources, entropy, passes, budget), "mix-plan")
    ends = partial_ends(rows, plan)
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = materialize(plan.select(F.struct("source", "weight", "passes", "end").alias("mix_plan")), "mix-decisions")
    blocks = max(1, round(budget / block_tokens))

    full = F.floor("mix_plan.passes").cast("int")
    h = order_hash(seed)
    # without an end the partial pass, if there is any, takes the whole source
    partial = (F.col("mix_plan.passes") > full) & (F.col("mix_plan.end").isNull() | (h < F.col("mix_plan.end")))
    count = full + F.when(partial, 1).otherwise(0)
    draws = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    own = [c for c in docs.columns if c not in ADDED]
    drawn = docs.select(*own).join(plan, F.col("source").eqNullSafe(F.col("mix_plan.source")))
    drawn = drawn.select(*own, "mix_plan", F.explode(draws).alias("pass_no"))
    along = (F.col("pass_no") - 1 + h / float(1 << HASH_BITS)) / F.greatest(F.col("mix_plan.passes"), F.lit(1e-9))
    block = F.least(F.floor(along * blocks), F.lit(blocks - 1)).cast("long")
    slot = F.xxhash64(F.lit(seed + 1), h, "pass_no")
    return drawn.select(*own, "pass_no", block.alias("block"), slot.alias("slot"), F.col("mix_plan.weight").alias("weight"))
