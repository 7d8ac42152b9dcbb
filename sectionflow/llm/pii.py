"""Personal data by patterns and by what terms disclose about it.

The base kinds are found by patterns and validated.  Around their values the
corpus is searched for terms that give them away: for an entity e (a value of a
base kind) and a term t near it, PMI(t; e) is set against the information content
IC(e) of the entity.  A term whose PMI reaches ``RATIO`` of the IC, that is a term
from which the entity can nearly be told, exceeds the disclosure threshold; it is
marked wherever it occurs in documents with that entity and later generalised or
removed.  Probabilities are shares of distinct texts; a pair needs ``SUPPORT`` of
them, so copies of one text disclose nothing by themselves.  An entity that every
text holds has no information, so nothing discloses it.

Only DataFrame operations are used.  Offsets come from the lengths of what lies
between the matches, summed up in rows, not in one row's arrays.

Defined cases: NULL counts as an empty text: no spans, hash of nothing; repeated
rows give repeated results and count as one text; spans of different kinds may
overlap; other columns are not read.  The patterns below match what the plain
patterns match, but without backtracking, so that long runs take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.llm.common import may_be_in
from sectionflow.session import materialize

# The base kinds in their order.  \G lets a match start right after the last one.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"  # kind of the spans that the method adds
WORD = r"\p{L}++"

REACH_CHARS = 80  # context on each side of a value ...
REACH_WORDS = 5  # ... of at most so many words
SUPPORT = 3  # distinct texts in which a term stands near an entity
RATIO = 0.9


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a short string of digits is right."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    terms = F.transform(values, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d))
    return F.aggregate(terms, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match of a kind (by its number) holds."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when((kind == 2) & n.between(14, 19), _luhn(digits))
        .when(kind == 3, n.between(10, 15))
        .otherwise(False)
    )


def _matches(rows: DataFrame, patterns: list[str], may_match: list[Column]) -> DataFrame:
    """Columns of ``rows`` but text, and kind, value, start, end, left, right for all matches of all patterns.

    ``rows`` has a column row that numbers its rows.
    """
    text = F.col("text")
    keep = [c for c in rows.columns if c != "text"]
    found = [
        F.when(
            may,
            F.struct(F.lit(k).alias("kind"), F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("values")),
        )
        for k, (p, may) in enumerate(zip(patterns, may_match))
    ]
    each = rows.select(*keep, F.explode(F.array(*found)).alias("f")).where("f is not null")
    each = each.select(*keep, "f.kind", "f.gaps", F.posexplode("f.values").alias("i", "value"))
    before, behind = F.get("gaps", F.col("i")), F.get("gaps", F.col("i") + 1)
    each = each.select(
        *keep,
        "kind",
        "i",
        "value",
        (F.length(before) + F.length("value")).alias("step"),
        F.when(F.length(before) > REACH_CHARS, F.substring(before, -REACH_CHARS, REACH_CHARS)).otherwise(before).alias("left"),
        F.substring(behind, 1, REACH_CHARS).alias("right"),
    )
    end = F.sum("step").over(Window.partitionBy("row", "kind").orderBy("i"))
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("step", "i")


def base_spans(docs: DataFrame) -> DataFrame:
    """Columns doc_id, h (hash of the text), kind (number), start, end, value, left, right of all valid matches."""
    text = F.col("text")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text"
    ).where(text.rlike("[0-9]") | text.contains("@"))
    may = [text.contains("@"), text.contains("."), text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), text.contains("+")]
    found = _matches(rows, list(KINDS.values()), may).where(_valid(F.col("kind"), F.col("value")))
    return found.select("doc_id", "h", "kind", "start", "end", "value", "left", "right")


def _context(left: Column, right: Column) -> tuple[Column, Column]:
    """The last words on the left and the first on the right; cut words at the far ends do not count."""
    cut_left = F.when(F.length(left) >= REACH_CHARS, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    cut_right = F.when(F.length(right) >= REACH_CHARS, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    words = [F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)) for x in (cut_left, cut_right)]
    return F.reverse(F.slice(F.reverse(words[0]), 1, REACH_WORDS)), F.slice(words[1], 1, REACH_WORDS)


def disclosing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Columns entity, term, bits (PMI), content (IC): pairs above the disclosure threshold."""
    entity = F.concat_ws(":", F.col("kind").cast("string"), F.lower("value"))
    before, behind = _context(F.col("left"), F.col("right"))
    near = spans.select(entity.alias("entity"), "h", F.explode(F.array_distinct(F.concat(before, behind))).alias("term"))
    together = near.distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    together = materialize(together, "disclosure-pairs")
    entities = spans.select(entity.alias("entity"), "h").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    wanted = materialize(together.select("term").distinct(), "disclosure-terms")
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    own = docs.select(F.xxhash64("text").alias("h"), F.explode(terms).alias("term"))
    counts = own.join(wanted, "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    texts = docs.select(F.xxhash64("text")).distinct().count()
    scored = together.join(entities, "entity").join(counts, "term")
    content = F.log2(F.lit(texts) / F.col("n_e"))
    bits = F.log2(F.lit(texts) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    scored = scored.select("entity", "term", bits.alias("bits"), content.alias("content"))
    return scored.where((F.col("content") > 0) & (F.col("bits") >= RATIO * F.col("content")))


def term_spans(docs: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Columns doc_id, h, kind, start, end: disclosing terms in the documents that hold their entity."""
    entity = F.concat_ws(":", F.col("kind").cast("string"), F.lower("value"))
    marked = spans.select("doc_id", "h", entity.alias("entity")).distinct().join(terms, "entity")
    marked = marked.groupBy("doc_id", "h").agg(F.collect_set("term").alias("terms"))
    marked = materialize(marked.toDF("d", "g", "terms"), "disclosed")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    rows = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).drop("d", "g")
    found = _matches(rows, [WORD], [F.lit(True)]).where(F.array_contains("terms", F.lower("value")))
    return found.select("doc_id", "h", F.lit(len(KINDS)).alias("kind"), "start", "end").distinct()


def all_spans(docs: DataFrame) -> DataFrame:
    """Columns doc_id, h, kind, start, end: base spans and disclosing terms, each once."""
    base = materialize(base_spans(docs), "pii-spans")
    terms = term_spans(docs, base, disclosing_terms(docs, base))
    return base.select("doc_id", "h", "kind", "start", "end").distinct().union(terms)


def _digest(kinds: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*map(F.lit, [*KINDS, TERM]))
    return F.array_join(
        F.transform(kinds, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans; one row per row."""
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    found = all_spans(docs).groupBy("doc_id", "h").agg(spans.alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(KINDS))
    kinds = F.transform("all", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{x}") for k, x in enumerate(KINDS)]
    digests = F.sha2(_digest(base), 256).alias("sha"), _digest(F.col("all")).alias("s")
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), *counts, *digests)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{x}", F.lit(0)).cast("long").alias(f"n_{x}") for x in KINDS),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("s", F.lit("")).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced: <EMAIL>, <IP>, <CARD>, <PHONE>; disclosing terms by <TERM>.

    Overlapping spans become one, named by the first.  ``n_chars`` follows if there is one.
    """
    spans = F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("pii_spans")
    found = all_spans(docs).groupBy(F.col("doc_id").alias("pii_d"), F.col("h").alias("pii_g")).agg(spans)
    found = materialize(found, "pii-by-document")
    names = F.array(*(F.lit(f"<{x.upper()}>") for x in [*KINDS, TERM]))
    text = F.col("text")

    def piece(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        added = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.struct(
            F.when(fresh, F.concat(a["parts"], added)).otherwise(a["parts"]).alias("parts"),
            F.greatest(a["at"], s["end"]).cast("int").alias("at"),
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    whole = F.aggregate(
        "pii_spans", start, piece, lambda a: F.array_join(F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, F.length(text)))), "")
    )
    # Only rows that may have a span move.
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    names_ = found.select(F.xxhash64(F.col("pii_d").isNull(), "pii_d", "pii_g").alias("h"))
    told = may_be_in(docs.withColumn("pii_h", F.xxhash64("text")), key, names_, "pii_maybe")
    rest = told.where("pii_maybe")
    joined = rest.join(found, F.col("doc_id").eqNullSafe(F.col("pii_d")) & (F.col("pii_h") == F.col("pii_g")), "left")
    clean = F.when(F.col("pii_spans").isNull(), F.col("text")).otherwise(whole)
    out = joined.withColumn("text", clean).select(*docs.columns).union(told.where("NOT pii_maybe").select(*docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
