"""Hard negatives by segment summaries.

Vectors are cut into segments, and every segment's mean and deviation are stored
for each level of ever shorter segments. The inner product of two vectors is, per
segment, its length times (the product of the means, plus or minus at most the
product of the deviations), so that the sums over segments bound it from both
sides. An anchor's rows are bounded by the longest segments first and opened in
the order of their upper bounds, in growing steps; what a step opens goes through
shorter and shorter segments, and only what their bounds leave gets its exact
score. The k-th best score so far raises the floor, and no row is opened whose
upper bound is below it.

Anchors meet all rows in blocks of both, dealt by a hash, so that no label, id or
group of copies decides how much a task gets. A task returns at most k rows for
an anchor (positives) or for an anchor and positive (negatives).

Cases: rows without vec_id, label or vector, with null or non-finite components,
with components that no long holds after scaling, with an empty vector or one of
another length than most take no part; zero vectors do; rows that agree in
vec_id, label and vector are one row; rows that share only a vec_id are told
apart by anchor_row, positive_row and negative_row, and none of them is a
positive of another; ties go to the smaller vec_id; scores beyond a long are held
at its ends; an anchor without positives, or a positive without negatives in its
window, gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.llm.common import discard, stored
from aislecraft.llm.vectors import exact, largest, matrix, whole_rows

#: Positives of an anchor; negatives of a positive; a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
#: Components of a segment on each level, longest first.
SEGMENTS = (16, 4)
#: Rows and anchors of a task; anchors whose bounds it holds at a time.
ROWS, ANCHORS, CHUNK = 4096, 16_384, 128
#: Rows of an anchor that are opened at first; each further step opens twice as many.
FIRST = 64


def cuts(width: int, length: int) -> np.ndarray:
    """Where segments of about `length` components begin, and the end."""
    return np.linspace(0, width, max(1, -(-width // length)) + 1).astype(int)


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's mean and deviation, both times the root of its length, all levels side by side: products of them add up to bounds."""
    x, means, deviations = x.astype(float), [], []
    for length in SEGMENTS:
        at = cuts(x.shape[1], length)
        for a, b in zip(at, at[1:]):
            part = x[:, a:b]
            mean = part.mean(axis=1)
            means.append(mean * (b - a) ** 0.5)
            deviations.append(np.linalg.norm(part - mean[:, None], axis=1))
    return np.stack(means, axis=1), np.stack(deviations, axis=1)


def summarised(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, x, row (a hash that tells rows of one vec_id apart), means, deviations of the rows that take part, and their length."""
    rows, width = whole_rows(vectors, F.col("label").cast("long").alias("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).distinct().withColumn("row", F.xxhash64("vec_id", "label", "x"))
    lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                means, deviations = summaries(matrix(batch.column(2), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(means), lists(deviations)], ["vec_id", "label", "x", "row", "means", "deviations"])

    return rows.select("vec_id", "label", "x", "row").mapInArrow(run, "vec_id long, label long, x array<long>, row long, means array<double>, deviations array<double>"), width


class Block:
    """Rows of a task as arrays."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.rows, self.labels = (pdf[c].to_numpy() for c in ("vec_id", "row", "label"))
        self.x, self.means, self.deviations = (np.stack(pdf[c].to_list()) for c in ("x", "means", "deviations"))
        self.reach = largest(self.x)

    def levels(self) -> list[slice]:
        ends = np.cumsum([0, *(len(cuts(self.x.shape[1], n)) - 1 for n in SEGMENTS)])
        return [slice(a, b) for a, b in zip(ends, ends[1:])]


def bounds(q_mean: np.ndarray, q_dev: np.ndarray, means: np.ndarray, devs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each q with each row of a level's summaries, beyond the rounding of doubles."""
    middle, spread = q_mean @ means.T, q_dev @ devs.T
    spread = spread + 1e-9 * (np.abs(middle) + spread) + 1e-6
    return middle - spread, middle + spread


def scores(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of whole vectors, held at the ends of a long."""
    if most < 2**53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)  # doubles hold every partial sum
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in (exact(x, most) * exact(q, most)).sum(axis=1)], np.int64)


def best(block: Block, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places in `at` of the k first rows by score, then vec_id, then row."""
    return np.lexsort((block.rows[at], block.ids[at], -score))[:k]


def searched(anchors: Block, rows: Block, k: int, valid, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, rows, scores): the k best valid rows whose score lies in each window [low, high] of each anchor.

    low, high: anchors x windows, as doubles, that the exact scores are compared with.
    """
    first, *finer = rows.levels()
    most = rows.x.shape[1] * max(rows.reach, 1) * max(anchors.reach, 1)

    def open_to(lower: np.ndarray, upper: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which rows may lie in any window (the last axis of lo and hi)."""
        keep = np.zeros(lower.shape, bool)
        for w in range(lo.shape[-1]):
            keep |= (upper >= lo[..., w : w + 1]) & (lower <= hi[..., w : w + 1])
        return keep

    for a in range(0, len(anchors.ids), CHUNK):
        part = slice(a, a + CHUNK)
        lower, upper = bounds(anchors.means[part, first], anchors.deviations[part, first], rows.means[:, first], rows.deviations[:, first])
        kept = valid(part) & open_to(lower, upper, low[part], high[part])
        for j, mask in enumerate(kept, a):
            at = np.flatnonzero(mask)
            at = at[np.argsort(-upper[j - a, at], kind="stable")]  # the most promising first
            floor, score, scored = low[j].copy(), np.array([], np.int64), np.array([], np.int64)
            begin, step = 0, FIRST
            while begin < len(at) and upper[j - a, at[begin]] >= floor.min():
                new, begin, step = at[begin : begin + step], begin + step, 2 * step
                for level in finer:
                    if len(new):
                        new = new[open_to(*bounds(anchors.means[j, level], anchors.deviations[j, level], rows.means[new, level], rows.deviations[new, level]), floor, high[j])]
                scored, score = np.concatenate((scored, new)), np.concatenate((score, scores(anchors.x[j], rows.x[new], most)))
                for w in range(len(floor)):  # what is below the k-th best so far is of no use
                    inside = score[(score >= floor[w]) & (score <= high[j, w])]
                    if len(inside) >= k:
                        floor[w] = np.partition(inside, -k)[-k]
            for w in range(len(floor)):
                inside = np.flatnonzero((score >= floor[w]) & (score <= high[j, w]))
                if len(inside):
                    found = inside[best(rows, scored[inside], score[inside], k)]
                    yield j, w, scored[found], score[found]


def _frame(columns: list[str], parts: list[tuple]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({c: np.array([], np.int64) for c in columns})
    return pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*parts)))))


def positives_in(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The first rows of each anchor's label, of another vec_id, among a block of rows."""
    columns, found = ["anchor_id", "anchor_row", "vec_id", "row", "score"], []
    if len(left) and len(right):
        anchors, rows = Block(left), Block(right)
        valid = lambda part: (anchors.labels[part, None] == rows.labels) & (anchors.ids[part, None] != rows.ids)
        everything = np.full((len(left), 1), np.inf)
        for j, _, at, score in searched(anchors, rows, POSITIVES, valid, -everything, everything):
            found.append((np.full(len(at), anchors.ids[j]), np.full(len(at), anchors.rows[j]), rows.ids[at], rows.rows[at], score))
    return _frame(columns, found)


def negatives_in(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The first rows of another label in the window of each of an anchor's positives, among a block of rows."""
    columns, found = ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"], []
    if len(left) and len(right):
        anchors, rows = Block(left), Block(right)
        positives = [list(p) for p in left["positives"]]
        low, high = np.full((len(left), POSITIVES), np.inf), np.full((len(left), POSITIVES), -np.inf)
        for j, each in enumerate(positives):
            for w, p in enumerate(each):  # whole numbers: the window's ends are rounded inwards
                low[j, w], high[j, w] = -(-WINDOW[0] * int(p["score"]) // 100), WINDOW[1] * int(p["score"]) // 100
        valid = lambda part: anchors.labels[part, None] != rows.labels
        for j, w, at, score in searched(anchors, rows, NEGATIVES, valid, low, high):
            p, n = positives[j][w], len(at)
            found.append((*(np.full(n, v) for v in (anchors.ids[j], anchors.rows[j], p["vec_id"], p["row"], p["score"])), rows.ids[at], rows.rows[at], score))
    return _frame(columns, found)


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and the rows' hashes, for the rows of `vectors` (vec_id, embedding, label) that are `anchors` (a condition on vec_id)."""
    rows, width = summarised(vectors)
    if not width:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, anchor_row long, positive_row long, negative_row long")
    rows = stored(rows, "summaries")
    asked = rows.where(anchors)
    n, m = (max(1, df.count()) for df in (rows, asked))
    of_rows, of_anchors = -(-n // ROWS), -(-m // ANCHORS)
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    deal = lambda blocks: F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    dealt = rows.select("*", deal(of_rows).alias("block"), every(of_anchors).alias("turn")).groupBy("block", "turn")

    def meet(df: DataFrame, find, schema: str) -> DataFrame:
        turns = df.select("*", deal(of_anchors).alias("turn"), every(of_rows).alias("block")).groupBy("block", "turn")
        return turns.cogroup(dealt).applyInPandas(find, schema)

    near = meet(asked, positives_in, "anchor_id long, anchor_row long, vec_id long, row long, score long")
    near = ranked(near, ["anchor_id", "anchor_row"], [F.desc("score"), F.col("vec_id"), F.col("row")], POSITIVES)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("vec_id", "row", "score")).alias("positives"))
    with_positives = stored(asked.join(lists, ["vec_id", "row"]), "positives")
    found = meet(with_positives, negatives_in, "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long, negative_id long, negative_row long, negative_score long")
    found = ranked(found, ["anchor_id", "anchor_row", "positive_id", "positive_row"], [F.desc("negative_score"), F.col("negative_id"), F.col("negative_row")], NEGATIVES)
    out = stored(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "anchor_row", "positive_row", "negative_row"), "negatives")
    discard(rows, with_positives)
    return out
