"""From raw documents to a training mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.llm import decontaminate, langid, mixing, pii, shingles
from sectionflow.llm.common import bound_batches, read_table
from sectionflow.session import materialize

LEAST_SHARE = 0.5  # of the letters that the language of a document must have


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language has half of the letters.

    NULL and empty texts have no letter and go; without a labelled row every document goes; ties
    go to the language first in the alphabet; repeated rows are judged alike and all stay or go;
    columns stay as they are, whatever their names.
    """
    bound_batches(spark)
    return langid.in_one_language(docs, langid.fit(docs, F.lit(True)), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word similarity of 0.8 or more.

    Texts without words are one group, and so are equal texts; a row without id stays only if
    no other of its group has one, and of equal smallest ids one row stays; columns stay as they are.
    """
    bound_batches(spark)
    return shingles.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    NULL and empty texts and items hold nothing; repeated rows stay or go together; without
    items all documents stay; columns stay as they are.
    """
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"), size=10)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it.

    NULL and empty texts stay; of overlapping spans the first names the replacement; repeated
    rows are changed alike; ``n_chars`` follows the text, other columns stay as they are.
    """
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the training mixture; a row for each draw, with pass_no, block, slot and weight.

    A NULL source is a source; documents without words take nothing of the budget; repeated
    rows are drawn each; columns with one of the added names are replaced.
    """
    return mixing.mix(docs, entropy=0.9, passes=4.0)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise),
    ("mixing", mix_sources),
]

# Viterbi labels and chains of links are beyond SQL; tests hold the stages against plain loops on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
