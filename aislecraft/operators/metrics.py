"""Ranking metrics over recommended lists (user_id, item_id, rank) and test rows (user_id, item_id, rating).

All accuracy metrics of all cutoffs come from one pass: hits by user and cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = ("precision", "precision_min", "recall", "recall_min", "map", "mrr", "arhr", "ndcg", "f1", "hit_rate", "auc")


def per_user(lists: DataFrame, test: DataFrame, cutoffs: list[int], least_ratings: int = 1) -> DataFrame:
    """cutoff, user_id and every accuracy metric, for users with `least_ratings` test rows at least; a user without a list has zeros."""
    evaluated = test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_test")).where(F.col("n_test") >= least_ratings)
    marked = lists.select("user_id", "item_id", "rank").join(test.select("user_id", "item_id", F.lit(1).alias("rel")), ["user_id", "item_id"], "left").fillna(0, ["rel"])
    by_user = Window.partitionBy("user_id").orderBy("rank")
    cum = marked.withColumn("cum", F.sum("rel").over(by_user)).withColumn("cutoff", F.explode(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: c >= F.col("rank"))))
    rel, rank = F.col("rel"), F.col("rank")
    sums = cum.groupBy("cutoff", "user_id").agg(
        F.count(F.lit(1)).alias("len"), F.sum(rel).alias("hits"), F.sum(rel * F.col("cum") / rank).alias("ap"), F.min(F.when(rel == 1, rank)).alias("first"),
        F.sum(rel / rank).alias("arhr"), F.sum(rel / F.log(rank + 1)).alias("dcg"), F.sum(rel * (rank - F.col("cum"))).alias("above"),
    )
    every = evaluated.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    joined = every.join(sums, ["cutoff", "user_id"], "left").fillna(0, ["len", "hits", "ap", "arhr", "dcg", "above"])
    n, hits, size = F.col("n_test"), F.col("hits"), F.col("len")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("cutoff"), n).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log(i + F.lit(1.0)))
    negatives = size - hits
    precision, recall = ratio(hits, size), ratio(hits, n)
    return joined.select(
        F.col("cutoff").cast("long").alias("cutoff"), "user_id",
        precision.alias("precision"), ratio(hits, F.least(size, n)).alias("precision_min"), recall.alias("recall"), ratio(hits, F.least(n, size)).alias("recall_min"),
        ratio(F.col("ap"), F.least(n, size)).alias("map"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.col("arhr"), (F.col("dcg") / ideal).alias("ndcg"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), hits.cast("double").alias("hit_rate"),
        F.when(negatives > 0, ratio(hits * negatives - F.col("above"), hits * negatives)).alias("auc"),
    )


def global_metric(users: DataFrame, metric: str) -> DataFrame:
    """cutoff, value: the mean over evaluated users; users without a value (AUC of a list of hits only) don't count."""
    return users.groupBy("cutoff").agg(F.avg(metric).alias("value"))


def rmse(scores: DataFrame, test: DataFrame) -> DataFrame:
    """Root mean squared error of each user, then the mean."""
    both = test.join(scores.select("user_id", "item_id", "score"), ["user_id", "item_id"]).where(F.abs("score") < float("inf"))
    users = both.groupBy("user_id").agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("rating"), 2))).alias("r"))
    return users.agg(F.avg("r").alias("value"))


def coverage_item(lists: DataFrame, test: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Shares of the catalogue that is recommended, and recommended with a hit."""
    hit = lists.join(test.select("user_id", "item_id", F.lit(1).alias("_h")), ["user_id", "item_id"], "left")
    seen = hit.groupBy("item_id").agg(F.max("_h").alias("_h"))
    joined = catalogue.select("item_id").distinct().join(seen.withColumn("_r", F.lit(1)), "item_id", "left")
    return joined.agg((F.count("_r") / F.count(F.lit(1))).alias("coverage"), (F.count("_h") / F.count(F.lit(1))).alias("coverage_test"))


def coverage_user(lists: DataFrame, users: DataFrame) -> DataFrame:
    joined = users.select("user_id").distinct().join(lists.select("user_id").distinct().withColumn("_r", F.lit(1)), "user_id", "left")
    return joined.agg((F.count("_r") / F.count(F.lit(1))).alias("coverage"))


def _total(counts: DataFrame) -> DataFrame:
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_items"))))  # one row


def herfindahl(counts: DataFrame) -> DataFrame:
    return _total(counts).agg((1 - F.sum(F.pow(F.col("n") / F.col("_t"), 2))).alias("value"))


def shannon(counts: DataFrame) -> DataFrame:
    p = F.col("n") / F.col("_t")
    return _total(counts).agg((-F.sum(p * F.log2(p))).alias("value"))


def gini(counts: DataFrame) -> DataFrame:
    """2 * sum((m + 1 - i) / (m + 1) * c_i / sum(c)) over items in ascending order of their counts, by a histogram of the counts."""
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("many"))
    last = F.sum("many").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))  # distinct counts only
    sums = counts.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("m"))
    places = histogram.withColumn("last", last).crossJoin(F.broadcast(sums))  # one row
    first = F.col("last") - F.col("many") + 1
    weight = F.col("many") * (F.col("m") + 1) - (first + F.col("last")) * F.col("many") / 2
    return places.agg((2 * F.sum(weight / (F.col("m") + 1) * F.col("n") / F.col("_t"))).alias("value"))


def novelty(lists: DataFrame, popularity: DataFrame) -> DataFrame:
    """Mean over users of the summed information of their items over the number of items."""
    info = _total(popularity).select("item_id", (-F.log2(F.col("n") / F.col("_t")) / F.col("_items")).alias("_i"))
    users = lists.join(info, "item_id", "left").groupBy("user_id").agg(F.coalesce(F.sum("_i"), F.lit(0.0)).alias("v"))
    return users.agg(F.avg("v").alias("value"))


def average_popularity(lists: DataFrame, popularity: DataFrame) -> DataFrame:
    top = popularity.agg(F.max("n").alias("_m"))
    share = popularity.crossJoin(F.broadcast(top)).select("item_id", (F.col("n") / F.col("_m")).alias("_p"))  # one row
    users = lists.join(share, "item_id", "left").groupBy("user_id").agg((F.coalesce(F.sum("_p"), F.lit(0.0)) / F.count(F.lit(1))).alias("v"))
    return users.agg(F.avg("v").alias("value"))


def inter_list(lists: DataFrame, k: int) -> DataFrame:
    """Mean diversity between lists of k items, from squared counts."""
    users = lists.agg(F.count_distinct("user_id").alias("u"))
    squares = lists.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    u = F.col("u")
    return squares.crossJoin(users).select((1 - ((F.col("s") - u * k) / k) / (u * u - u)).alias("value"))  # rows of one


def _list_pairs(lists: DataFrame) -> DataFrame:
    """user_id, src, dst, m: ordered pairs of each user's list of m items; the last item starts no pair. Lists are short: a constant number of pairs for each user."""
    size = Window.partitionBy("user_id")
    a = lists.select("user_id", F.col("item_id").alias("src"), F.col("rank").alias("ra"), F.max("rank").over(size).alias("last"), F.count(F.lit(1)).over(size).alias("m"))
    b = lists.select("user_id", F.col("item_id").alias("dst"), F.col("rank").alias("rb"))
    return a.join(b, "user_id").where("ra <> rb and ra < last").select("user_id", "src", "dst", "m")


def _mean_diversity(scored: DataFrame) -> DataFrame:
    users = scored.groupBy("user_id").agg((F.sum(1 - F.coalesce("weight", F.lit(0.0))) / (F.first("m") * (F.first("m") - 1))).alias("v"))
    return users.agg(F.avg("v").alias("value"))


def intra_list(lists: DataFrame, similarity: DataFrame) -> DataFrame:
    """Mean over users of 1 - similarity of the pairs of their list; missing pairs have similarity 0."""
    return _mean_diversity(_list_pairs(lists).join(similarity.select("src", "dst", "weight"), ["src", "dst"], "left"))


def intra_list_of(lists: DataFrame, sets: DataFrame, size: float) -> DataFrame:
    """The same with the similarity |A and B| / size of the items' feature sets (item_id, features): only pairs that stand in a list are compared."""
    of = lambda key, name: sets.select(F.col("item_id").alias(key), F.col("features").alias(name))
    pairs = _list_pairs(lists).join(of("src", "_a"), "src", "left").join(of("dst", "_b"), "dst", "left")
    return _mean_diversity(pairs.withColumn("weight", F.size(F.array_intersect("_a", "_b")) / size).withColumn("weight", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("weight"))))


def sampled_correction(spark, n_items: int, n_samples: int, cutoff: int, metric: str, gamma: float | None = 0.01) -> list[float]:
    """Weights of the ranks in a list of n_samples sampled items, so that the expected value is that of a metric over all n_items.

    The normal equations are summed over the catalogue's ranks on Spark; with
    `gamma` they are solved with a bias-variance trade-off, without it by least
    squares between 0 and 1. The system is as large as the list.
    """
    import numpy as np

    m = {"precision": lambda r: (r < cutoff) / cutoff, "map": lambda r: (r < cutoff) / (r + 1), "recall": lambda r: (r < cutoff) * 1.0, "ndcg": lambda r: (r < cutoff) / np.log2(r + 2)}[metric]
    log_fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n_items + 1)))))

    def partial(batches):
        import pandas as pd

        ata, atb, c = np.zeros((n_samples, n_samples)), np.zeros(n_samples), np.zeros(n_samples)
        for pdf in batches:
            big, k, n = pdf["id"].to_numpy()[:, None], np.arange(n_samples)[None, :], n_samples - 1
            ok = (k <= big) & (n - k <= n_items - big) & (k <= n)
            choose = lambda a, b: log_fact[a] - log_fact[b] - log_fact[a - b]
            kk, left = np.where(ok, k, 0), np.where(ok, n - k, 0)
            a = np.where(ok, np.exp(choose(np.broadcast_to(big, ok.shape), kk) + choose(np.broadcast_to(n_items - big, ok.shape), np.minimum(left, n_items - big)) - choose(n_items, n)), 0.0)
            ata += a.T @ a / n_items
            atb += a.T @ m(big[:, 0]) / n_items
            c += a.sum(axis=0) / n_items
        yield pd.DataFrame({"v": [np.concatenate((ata.ravel(), atb, c)).tolist()]})

    rows = spark.range(n_items).mapInPandas(partial, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # n_samples squared numbers
    v = np.zeros(n_samples * n_samples + 2 * n_samples)
    for r in rows:
        v[r["i"]] = r["x"]
    ata, atb, c = v[: n_samples**2].reshape(n_samples, -1), v[n_samples**2 : -n_samples], v[-n_samples:]
    if gamma is not None:
        x = np.linalg.lstsq((1 - gamma) * ata + gamma * np.diag(c), atb, rcond=None)[0]
    else:
        x, step = np.zeros(n_samples), 1 / max(np.linalg.eigvalsh(ata)[-1], 1e-12)
        for _ in range(20_000):
            new = np.clip(x - step * (ata @ x - atb), 0, 1)
            if np.abs(new - x).max() < 1e-12:
                break
            x = new
    x = np.clip(x, 0, 1)
    x[cutoff:] = 0
    return x.tolist()


def corrected(hits: DataFrame, weights: list[float]) -> DataFrame:
    """Mean over users of the weights at their hits' ranks (from 1)."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    value = F.coalesce(F.get(table, F.col("rank").cast("int") - 1), F.lit(0.0))
    return hits.groupBy("user_id").agg(F.sum(F.col("rel") * value).alias("v")).agg(F.avg("v").alias("value"))


def moments(column: Column) -> tuple[Column, Column, Column]:
    return F.count(column), F.avg(column), F.stddev_samp(column)
