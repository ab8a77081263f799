"""Windows over scores: top-k, normalisation, tie breaking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_uniform


def ranked(scores: DataFrame, key: str = "user_id", item: str = "item_id", score: str = "score", rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(F.round(score, 9)), item)
    return scores.withColumn(rank, F.row_number().over(order))


def top_k(scores: DataFrame, k: int, key: str = "user_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The k best of each key, ties to the smaller item."""
    return ranked(scores, key, item, score).where(F.col("rank") <= k)


def top_k_candidates(scores: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    return top_k(scores.join(candidates.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"), k)


def row_minmax(scores: DataFrame, *keys: str) -> DataFrame:
    """Scores of each user from 1e-8 to 1 + 1e-8; equal scores become 1e-8."""
    w = Window.partitionBy(*(keys or ("user_id",)))
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0) + 1e-8)


def break_ties(scores: DataFrame, filler: DataFrame, penalty: float = 1e-12, by_value: bool = False) -> DataFrame:
    """Scores with a small addition: the filler's value, or the place of its value from below; users without predictions have none."""
    place = F.col("f") if by_value else F.row_number().over(Window.partitionBy("user_id").orderBy(F.round("f", 9), "item_id")).cast("double")
    extra = filler.select("user_id", "item_id", F.col("score").alias("f")).withColumn("f", place)
    return scores.join(extra, ["user_id", "item_id"], "left").select("user_id", "item_id", (F.col("score") + F.coalesce("f", F.lit(0.0)) * penalty).alias("score"))


def _below(w: Window) -> F.Column:
    low = F.min("score").over(w)
    return low - 0.02 * F.abs(low)


def demote_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    """Seen items score a little below the user's least."""
    flagged = scores.join(seen.select("user_id", "item_id").withColumn("_s", F.lit(True)), ["user_id", "item_id"], "left")
    return flagged.select("user_id", "item_id", F.when(F.col("_s"), _below(Window.partitionBy("user_id"))).otherwise(F.col("score")).alias("score"))


def score_floor(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """A score for every candidate: missing or non-finite ones a little below the user's least, 1e-8 at least for users of one score or none."""
    joined = candidates.select("user_id", "item_id").join(scores.select("user_id", "item_id", "score"), ["user_id", "item_id"], "left")
    finite = joined.withColumn("score", F.when(F.abs("score") < float("inf"), F.col("score")))
    w = Window.partitionBy("user_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    filled = F.coalesce("score", low - 0.02 * F.abs(low), F.lit(1e-8))
    return finite.select("user_id", "item_id", F.when(low < high, filled).otherwise(F.greatest(filled, F.lit(1e-8))).alias("score"))


def add_noise(scores: DataFrame, weight: float = 1e-3, seed: int = 97) -> DataFrame:
    return scores.withColumn("score", F.col("score") + hash_uniform(seed, F.col("user_id"), F.col("item_id")) * weight)


def reduce_score(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """Scores of the last share of the users (by id) become 0."""
    from aislecraft.operators.ingest import places

    users = places(scores.select("user_id").distinct(), F.desc("user_id"))
    n = users.agg(F.floor(F.count(F.lit(1)) * share).alias("_most"))
    last = users.crossJoin(F.broadcast(n)).where(F.col("place") < F.col("_most")).select("user_id", F.lit(True).alias("_last"))  # one row
    return scores.join(last, "user_id", "left").select("user_id", "item_id", F.when(F.col("_last"), 0.0).otherwise(F.col("score")).alias("score"))


def filter_negatives(scores: DataFrame, positives: DataFrame, keep: int = 25) -> DataFrame:
    """The best `keep` candidates of each user, positives first."""
    marked = row_minmax(scores).join(positives.select("user_id", "item_id").withColumn("_p", F.lit(10.0)), ["user_id", "item_id"], "left")
    return top_k(marked.select("user_id", "item_id", (F.col("score") + F.coalesce("_p", F.lit(0.0))).alias("score")), keep).select("user_id", "item_id", "rank")


def filler_ranks(scores: DataFrame) -> DataFrame:
    """Rank from below over the largest rank plus 1, one decimal."""
    up = F.row_number().over(Window.partitionBy("user_id").orderBy(F.round("score", 9), F.desc("item_id")))
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return scores.select("user_id", "item_id", F.round(up / (n + 1), 1).alias("filler"))


def ltr_rank(rows: DataFrame) -> DataFrame:
    """Places within a query by score, of equal scores the less relevant first, then by document."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rel", "doc_id")
    return rows.withColumn("rank", F.row_number().over(order))
