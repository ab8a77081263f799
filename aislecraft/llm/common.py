"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislecraft.sources.storage import discard, shared_dir, ship, stored

__all__ = ["discard", "drawn", "forget", "learnable", "shared_dir", "ship", "small_batches", "small_enough", "stored", "table", "texts_of", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def learnable(doc_id) -> object:
    """True for the rows that a classifier may learn from: crc32(doc_id as text) mod 3 is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def small_enough(df: DataFrame, limit: int, size) -> bool:
    """Whether the rows of `df`, of `size` bytes each (a Column), are at most `limit` bytes together. One small aggregate reaches the driver."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def drawn(rows: DataFrame, label: str, most: Column, most_bytes: int) -> DataFrame:
    """A sample to learn from: label, key and text of about `most` different rows of each label, by a hash of doc_id and text.

    Texts of more than `most_bytes` bytes are not drawn. Rows are counted first
    and then drawn by a rate, without a window, so that no label's rows meet in
    one task; repeated rows are one.
    """
    fit = rows.where(F.octet_length("text") <= most_bytes).select(F.col(label).alias("label"), "text", F.xxhash64("doc_id", "text").alias("key"))
    rates = fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", (most / F.col("n")).alias("rate"))  # a row for each label
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return fit.join(F.broadcast(rates), "label").where(place < F.col("rate")).groupBy("label", "key").agg(F.min("text").alias("text"))


_CACHE: dict[object, object] = {}


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks of one operator; another operator's is dropped first, so that they never add up."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


def forget() -> None:
    """What a Python worker keeps goes: for tasks of an operator that keeps nothing, lest another operator's caches stand beside its own needs."""
    if _CACHE:
        _CACHE.clear()
        pa.default_memory_pool().release_unused()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch between Spark and Python where the rows are whole texts: by the usual 10,000 a batch is a whole partition, held on both sides.
TEXTS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches of TEXTS_AT_ONCE rows at most from now on, unless the session's are smaller."""
    rows = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(rows, TEXTS_AT_ONCE) if rows > 0 else TEXTS_AT_ONCE))
