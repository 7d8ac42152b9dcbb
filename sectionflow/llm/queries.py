"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.llm import collocations, decontaminate, hard_negatives, langid, lexicon, mixing, pii, quality, simhash, substrings, token_counts, topk, warc
from sectionflow.llm.common import bound_batches, fold, read_table
from sectionflow.session import scratch_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, radius=4)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    kept = substrings.without_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), folds=5, held_out=0)
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out, "score", "predicted")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nearer to equal weights than the sources are by themselves, so the exponent and the passes are the plan's
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), entropy=0.9999, passes=4.0)
    return mixed.select("doc_id", "source", "pass_no", "block", "slot", "weight")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark, 500)
    folder = scratch_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, benchmark, size=10)
    names = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names, "contaminated")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    coded = lexicon.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=10, longest=3, top=2000, covered=50)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_token_counts,
        op3_simhash_near_dedup,
        op4_substring_dedup,
        op5_quality_classifier,
        op6_top_k,
        op7_language_id,
        op8_source_mixing,
        op9_warc,
        op10_decontamination,
        op11_word_bpe,
        op12_collocations,
        op13_hard_negatives,
    )
}

# Kinds of words as in the operators; DuckDB's translate() leaves letters beyond ASCII alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
runs AS (
  SELECT doc_id, spot, array_to_string(w[spot:spot + 12], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS spot FROM d)
),
firsts AS (SELECT doc_id, spot, min(doc_id) OVER (PARTITION BY run) AS first_id FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(spot, spot + 13)) AS pos FROM firsts WHERE first_id < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept
  FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
named AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM named""",
    "op10_decontamination": rf"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9])
                                       WHEN len(w) > 0 THEN [w] ELSE [] END) AS win
  FROM b
),
lengths AS (SELECT DISTINCT len(win) AS l FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS spot FROM d),
hits AS (
  SELECT doc_id, spot, l, item_id
  FROM (SELECT doc_id, spot, l, w[spot:spot + l - 1] AS win FROM places, lengths WHERE spot + l - 1 <= len(w)) JOIN windows USING (win)
),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(spot, spot + l)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS spot FROM p, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k
),
f AS (
  SELECT lang, k, array_to_string(w[spot:spot + k - 1], ' ') AS phrase, any_value(w[spot:spot + k - 1]) AS ws, count(*) AS a
  FROM runs GROUP BY lang, k, phrase
),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, k, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, one.a AS l, two.a AS r, cut,
         (1000000::HUGEINT * cuts.a * cuts.a // (one.a::HUGEINT * two.a))::BIGINT AS score
  FROM cuts JOIN f one ON one.lang = cuts.lang AND one.phrase = x JOIN f two ON two.lang = cuts.lang AND two.phrase = y
),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored
),
longer AS (
  SELECT lang, phrase, max(a) AS top FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3
  ) GROUP BY lang, phrase
),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE nth = 1 AND (top IS NULL OR 100 * top < 50 * a)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM pairs WHERE same)
  WHERE nth <= 5
),
ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives JOIN pairs USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
}
