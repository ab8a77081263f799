"""Connected components and bounded per-bucket counts as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import discard, stored

#: Buckets of one row on the way to the sums.
SLICE = 1 << 14


def packed_counts(counts: np.ndarray) -> pd.DataFrame:
    """The non-empty slices of an array of counts, as rows."""
    slices = [(k, counts[k : k + SLICE]) for k in range(0, len(counts), SLICE)]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pd.DataFrame([(k, squeeze(c.astype("<i8").tobytes())) for k, c in slices if c.any()], columns=["at", "counts"])


def summed_counts(parts: DataFrame, buckets: int) -> np.ndarray:
    """The sum of rows (at, counts) of packed_counts. What reaches the driver is `buckets` numbers, whatever the input."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        expand = zstandard.ZstdDecompressor().decompress
        total = sum(np.frombuffer(expand(c), "<i8") for c in pdf["counts"])
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "counts": [zstandard.ZstdCompressor(level=1).compress(total.astype("<i8").tobytes())]})

    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("at").applyInPandas(add, "at long, counts binary").collect():
        got = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), "<i8")
        out[row["at"] : row["at"] + len(got)] = got
    return out


def membership(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Boolean array of fixed size that is true where an id of `column` may be: at id mod `bits` of its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(bits, bool)
        for pdf in batches:
            seen[pdf["b"].to_numpy()] = True
        if seen.any():
            yield packed_counts(seen)

    return summed_counts(ids.select(slot(F.col(column), bits).alias("b")).mapInPandas(run, "at long, counts binary"), bits) > 0


def slot(id_: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(bits)).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for every end of the edges (a, b): the smallest id that it reaches.

    Every round takes the smallest label among neighbours and then the label of
    that label, so that long chains shrink by doubling; each is written to the
    shared folder. Only a count of changes reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stored(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        discard(labels)
        labels = new.select("id", "label")
        labels._stored_at = new._stored_at
        if new.where("label <> old").limit(1).count() == 0:
            discard(both)
            return labels
    raise RuntimeError(f"no fixed point after {rounds} rounds")
