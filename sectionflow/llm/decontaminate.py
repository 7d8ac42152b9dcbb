"""Benchmark decontamination with a positional inverted index.

Words of all documents that a benchmark window starts its search from are stored
as postings with their neighbourhood.  Of each window the term that is rarest in
the documents is looked up; offset-adjusted, its postings give the places where
the window could start, and the other terms are checked there.

Only DataFrame operations are used.  The benchmark tables (vocabulary, windows)
are written first, so the planner knows their size: it broadcasts them if they
are small and shuffles otherwise.

Defined cases: NULL and empty texts have no words and hits; an item of fewer
words than the window is one window, an item without words none; an item with a
NULL id causes hits but is not counted or named; repeated rows give repeated
results; equal windows of several items count for each; other columns are not
read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionflow.session import materialize

# Everything of ASCII that is no digit or lower-case letter separates words.
_SEPARATORS = "".join(c for c in map(chr, range(128)) if c not in string.ascii_letters + string.digits)
END = ""  # stands after the last word of a document; no word is empty


def words(text: str | Column = "text") -> Column:
    """Words of a text: A-Z in lower case, separators dropped."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.translate(text, string.ascii_uppercase + _SEPARATORS, string.ascii_lowercase + " " * len(_SEPARATORS))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), " "), "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Columns window (words), items (ids of the items that have it)."""
    own = benchmark.select("item_id", words().alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = own.select("item_id", "w", F.explode(starts).alias("at"))
    each = each.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Columns term, n: occurrences in all documents of the given terms (0 if none)."""
    found = docs.select(F.explode(words()).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def seed_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds term and off, the rarest term of each window and its place; windows that cannot occur go."""
    terms = windows.select("window", F.posexplode("window").alias("off", "term")).join(counts, "term")
    rarest = terms.groupBy("window").agg(F.min(F.struct("n", "term", "off")).alias("r")).where("r.n > 0")
    return windows.join(rarest, "window").select("window", "items", F.col("r.term").alias("term"), F.col("r.off").alias("off"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """Positional postings of the given terms, with up to ``reach`` words on both sides.

    Columns doc_id, h (hash of the text), pos, term, first (position of the first
    neighbour), near.  The sign ``END`` is a term too: its position is the number of
    words, so that every document has a row.
    """
    end = terms.sparkSession.range(1).select(F.lit(END).alias("term"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.concat(words(), F.array(F.lit(END))).alias("w"))
    rows = rows.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "term")).join(terms.union(end), "term")
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    near = F.when(F.col("term") != END, F.slice("w", first + 1, F.col("pos") - first + reach + 1))
    return rows.select("doc_id", "h", "pos", "term", first.alias("first"), near.alias("near"))


def phrase_matches(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """Columns doc_id, h, start, end, items: every place where a window stands word by word."""
    at = F.col("pos") - F.col("off")
    here = index.where(F.col("term") != END).join(seeds, "term").where(at >= F.col("first"))
    here = here.where(F.slice("near", at - F.col("first") + 1, F.size("window")) == F.col("window"))
    return here.select("doc_id", "h", at.alias("start"), (at + F.size("window")).alias("end"), "items")


def proximity_matches(index: DataFrame, seeds: DataFrame, slop: int) -> DataFrame:
    """Columns doc_id, h, start, end, items: spans with all terms of a window, in any order, with ``slop`` words more.

    The index must reach ``size + slop - 1`` words to both sides.  One row for each
    posting of the rarest term that is in such a span, with the first span found.
    """
    length = F.size("window") + slop
    low = F.greatest(F.lit(1), F.col("pos") - F.col("first") + 2 - length)
    whole = lambda s: F.size(F.array_except("window", F.slice("near", s, length))) == 0
    here = index.where(F.col("term") != END).join(seeds, "term")
    spans = F.filter(F.sequence(low, F.col("pos") - F.col("first") + 1), whole)
    here = here.withColumn("at", F.try_element_at(spans, F.lit(1))).where("at is not null")
    start = F.col("first") + F.col("at") - 1
    return here.select("doc_id", "h", start.alias("start"), (start + length).alias("end"), "items")


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The index and the matches of all windows of the benchmark in all documents."""
    windows = materialize(item_windows(benchmark, size), "windows")
    vocabulary = materialize(windows.select(F.explode("window").alias("term")).distinct(), "vocabulary")
    seeds = materialize(seed_windows(windows, term_counts(docs, vocabulary)), "seeds")
    terms = materialize(seeds.select("term").distinct(), "seed-terms")
    index = materialize(postings(docs, terms, size + slop - 1), "postings")
    return index, proximity_matches(index, seeds, slop) if slop else phrase_matches(index, seeds)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: doc_id, h, n_words, n_hit, items (sorted ids as strings), contaminated."""
    index, matches = find_windows(docs, benchmark, size)
    found = matches.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.collect_set("items").alias("items"),
    )
    # words in the union of the spans, which come by start
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"],
    )
    names = F.array_sort(F.array_distinct(F.flatten("items")).cast("array<string>"))
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), union.alias("n_hit"), names.alias("items"))
    every = index.where(F.col("term") == END)
    joined = every.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    hits = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "h",
        F.col("pos").cast("long").alias("n_words"),
        hits.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (hits > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any hit, with their columns."""
    bad = contamination(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("d"), F.col("h").alias("g"))
    bad = materialize(bad.distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["d"]) & (F.xxhash64(docs["text"]) == bad["g"]), "left_anti")
