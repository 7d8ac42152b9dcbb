"""Helpers that several corpus operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sectionflow.session import materialize

Value = TypeVar("Value")


def ship(spark: SparkSession, value: Value) -> Callable[[], Value]:
    """Broadcast a model of bounded size; the returned function gives it to a task.

    It travels pickled with its classes, so executors need not have this package,
    and a worker process unpickles it once for all its tasks.
    """
    shared = spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(value)})

    def get() -> Value:
        held = shared.value
        if "value" not in held:
            held["value"] = pickle.loads(held.pop("pickled"))
        return held["value"]

    return get


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Rows per Arrow batch: with long texts the default of 10,000 is too much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; a NULL id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


FILTER_WORDS = 1 << 17  # of 64 bits, in the table of ``may_be_in``


def may_be_in(rows: DataFrame, key: Column, hashes: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false only where ``key`` is not among ``hashes(h)``, 64-bit hashes.

    A Bloom filter of one bit a hash as a table of ``FILTER_WORDS`` rows, which is broadcast
    whatever the size of ``hashes``: rows that a join could not meet stay where they are.
    With far more hashes than bits every row may be in, and nothing is lost but time.
    """
    word, bit = F.pmod(F.col("h"), F.lit(FILTER_WORDS)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(63)).cast("int")
    table = hashes.select(word.alias("word"), bit.alias("bit")).select("word", F.expr("shiftleft(1L, bit)").alias("bits"))
    table = materialize(table.groupBy("word").agg(F.bit_or("bits").alias("bits")), "filter")
    held = table.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
    keyed = rows.withColumn(f"{name}_h", key)
    keyed = keyed.withColumn(f"{name}_word", F.pmod(F.col(f"{name}_h"), F.lit(FILTER_WORDS)))
    met = keyed.join(F.broadcast(held), f"{name}_word", "left")
    shift = f"shiftrightunsigned({name}_bits, cast(shiftrightunsigned({name}_h, 32) & 63 AS int)) & 1"
    return met.withColumn(name, F.expr(f"coalesce({shift}, 0L) = 1L")).select(*rows.columns, name)
