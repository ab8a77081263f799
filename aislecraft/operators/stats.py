"""Aggregations and statistics of interaction and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(inter: DataFrame, key: str, name: str) -> DataFrame:
    return inter.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def dataset_stats(inter: DataFrame) -> DataFrame:
    """One row: users, items, interactions, density in percent, and the least, mean and most per user and per item."""
    def side(key: str, tag: str) -> DataFrame:
        c = counts(inter, key, "n")
        return c.agg(F.count(F.lit(1)).alias(f"n_{tag}s"), F.sum("n").alias(f"n_by_{tag}"), F.min("n").alias(f"min_{tag}"), F.avg("n").alias(f"avg_{tag}"), F.max("n").alias(f"max_{tag}"))

    both = side("user_id", "user").crossJoin(side("item_id", "item"))  # two rows of one
    density = 100 * F.col("n_by_user") / (F.col("n_users") * F.col("n_items"))
    return both.select("n_users", "n_items", F.col("n_by_user").alias("n_interactions"), density.alias("density"), "min_user", "avg_user", "max_user", "min_item", "avg_item", "max_item")


def basic_features(candidates: DataFrame, inter: DataFrame) -> DataFrame:
    """Profile length and popularity of each candidate, with logarithms."""
    length = F.coalesce("profile_length", F.lit(0))
    pop = F.coalesce("popularity", F.lit(0))
    joined = candidates.join(counts(inter, "user_id", "profile_length"), "user_id", "left").join(counts(inter, "item_id", "popularity"), "item_id", "left")
    return joined.select("user_id", "item_id", length.alias("profile_length"), pop.alias("popularity"), F.log1p(length).alias("profile_log"), F.log1p(pop).alias("popularity_log"))


def mean_rating(inter: DataFrame, key: str, name: str) -> DataFrame:
    return inter.groupBy(key).agg((F.sum("rating") / (F.count(F.lit(1)) + 1e-6)).alias(name))


def count_difference(merged: DataFrame, target: DataFrame, key: str, name: str) -> DataFrame:
    """How much larger the merged count is than the target's, not below 0, with its logarithm."""
    both = counts(merged, key, "_m").join(counts(target, key, "_t"), key, "left")
    diff = F.greatest(F.col("_m") - F.coalesce("_t", F.lit(0)), F.lit(0))
    return both.select(key, diff.alias(name), F.log1p(diff).alias(f"{name}_log"))


def bucket(n: Column) -> Column:
    """Activity buckets of a profile length."""
    return F.when(n < 5, "cold").when(n < 8, "quite_cold").when(n < 12, "quite_warm").otherwise("warm")


def global_effects(inter: DataFrame, lambda_user: float = 10, lambda_item: float = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mean (one row), item biases and user biases."""
    mu = inter.agg(F.avg("rating").alias("mu"))
    rows = inter.crossJoin(F.broadcast(mu))  # one row
    items = rows.groupBy("item_id").agg((F.sum(F.col("rating") - F.col("mu")) / (F.count(F.lit(1)) + lambda_item)).alias("bi"))
    users = rows.join(items, "item_id").groupBy("user_id").agg((F.sum(F.col("rating") - F.col("mu") - F.col("bi")) / (F.count(F.lit(1)) + lambda_user)).alias("bu"))
    return mu, items, users


def cold_share(every: DataFrame, inter: DataFrame, key: str) -> DataFrame:
    """One row: how many ids have no interaction, and their share."""
    flagged = every.select(key).distinct().join(inter.select(key).distinct().withColumn("_w", F.lit(1)), key, "left")
    cold = F.count(F.when(F.col("_w").isNull(), 1))
    return flagged.agg(cold.alias("n_cold"), (cold / F.count(F.lit(1))).alias("share"))


def recommendation_counts(lists: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    lists = lists.join(ignored, "item_id", "left_anti") if ignored is not None else lists
    return counts(lists, "item_id", "n")


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, constant: one pass over all columns."""
    row = df.agg(*[(F.count_distinct(c) <= 1).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("constant")) for c in columns])).alias("x")).select("x.column", "x.constant")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair of columns, the later one second, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.a", "x.b", "x.r")


def useless_columns(df: DataFrame, columns: list[str], most: float = 0.95, alpha: float = 0.05) -> list[str]:
    """Constant columns, and those that a later column follows: |r| of `most` at least and significant."""
    import math

    constant = [r["column"] for r in constant_columns(df, columns).collect() if r["constant"]]  # one row for each column
    n = df.count()

    def p_value(r: float) -> float:
        t = abs(r) * math.sqrt(max(n - 2, 1) / max(1e-300, 1 - r * r))
        return math.erfc(t / math.sqrt(2))

    tied = [r["a"] for r in correlations(df, [c for c in columns if c not in constant]).collect() if r["r"] is not None and r["r"] == r["r"] and abs(r["r"]) >= most and p_value(r["r"]) <= alpha]
    return sorted({*constant, *tied}, key=columns.index)


def importance_filter(importance: DataFrame) -> DataFrame:
    """Features to remove: harmful on average and never of use."""
    return importance.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.max("drop").alias("max_drop")).where("mean_drop < 0 and max_drop <= 1e-8")


def fold_average(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("cutoff", "metric").agg(F.avg("value").alias("value"))


def weighted_objective(metrics: DataFrame, weight: Column) -> DataFrame:
    return metrics.agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("objective"))


def l1_rows(rows: DataFrame, row: str, value: str) -> DataFrame:
    return rows.withColumn(value, F.col(value) / F.sum(F.abs(value)).over(Window.partitionBy(row)))
