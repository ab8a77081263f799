"""Queries of feature generation and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislecraft.operators import ensemble, factors, ltr, ranking, splits, stats
from aislecraft.plans.base import query
from aislecraft.plans.evaluate import VIEWS as HELD
from aislecraft.plans.evaluate import algo_ndcg
from aislecraft.plans.sql import h, u
from aislecraft.sources import files
from aislecraft.sources.storage import fresh_path
from aislecraft.sources.views import SOURCES, TARGETS, Views

ALGOS = ["toppop", "global", "mean"]
MARKETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
BUCKETS = ["cold", "quite_cold", "quite_warm", "warm"]
#: Weight and sign by bucket and algorithm.
WEIGHTS = [(b, a, round((k + 1) * (0.5 - 0.3 * n), 2)) for k, b in enumerate(BUCKETS) for n, a in enumerate(ALGOS)]

VIEWS = HELD | {
    "norm": "SELECT algo, user_id, item_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + 1e-8 AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WINDOW w AS (PARTITION BY algo, user_id))",
    "n_sparse": "SELECT user_id, count(*) AS n FROM sparse GROUP BY 1",
    "n_inter": "SELECT user_id, count(*) AS n FROM interactions GROUP BY 1",
    "buckets": "SELECT user_id, CASE WHEN n < 5 THEN 'cold' WHEN n < 8 THEN 'quite_cold' WHEN n < 12 THEN 'quite_warm' ELSE 'warm' END AS bucket FROM (SELECT user_id, coalesce(s.n, 0) AS n FROM n_inter LEFT JOIN n_sparse s USING (user_id))",
    "first_level": "SELECT user_id, item_id, sum(score * w) AS score FROM norm JOIN buckets USING (user_id) JOIN (VALUES " + ", ".join(f"('{b}', '{a}', {w})" for b, a, w in WEIGHTS) + ") AS t(bucket, algo, w) USING (bucket, algo) GROUP BY 1, 2",
}


def buckets(v: Views):
    every = v.interactions().select("user_id").distinct()
    n = every.join(stats.counts(v.sparse(), "user_id", "n"), "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))
    return n.select("user_id", stats.bucket(F.col("n")).alias("bucket"))


def first_level(v: Views):
    weights = v.spark.createDataFrame(WEIGHTS, "bucket string, algo string, w double")
    return ensemble.weighted_sum(v.scores().join(buckets(v), "user_id"), weights, ["bucket", "algo"])


@query("ensemble_sum", "SELECT user_id, item_id, round(sum(score), 6) AS score FROM scores GROUP BY 1, 2")
def ensemble_sum(v: Views):
    return ensemble.score_sum(v.scores())


@query("folder_features", "SELECT item_id, " + ", ".join(f"coalesce(max(n) FILTER (WHERE market = '{m}'), 0) AS {m.lower().replace(' ', '_')}_popularity, round(max(iar) FILTER (WHERE market = '{m}'), 6) AS {m.lower().replace(' ', '_')}_iar" for m in MARKETS) + " FROM (SELECT market, item_id, count(*) AS n, sum(rating) / (count(*) + 1e-6) AS iar FROM interactions GROUP BY 1, 2) GROUP BY 1")
def folder_features(v: Views):
    long = v.interactions().groupBy("market", "item_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("rating") / (F.count(F.lit(1)) + 1e-6)).alias("iar"))
    pop = ensemble.pivoted(long, ["item_id"], "market", MARKETS, "n", "_popularity").fillna(0)
    return pop.join(ensemble.pivoted(long, ["item_id"], "market", MARKETS, "iar", "_iar"), "item_id")


@query("score_features", "SELECT user_id, item_id, " + ", ".join(f"round(max(s.score) FILTER (WHERE algo = '{a}'), 6) AS {a}, round(max(n.score) FILTER (WHERE algo = '{a}'), 6) AS {a}_norm" for a in ALGOS) + " FROM scores s JOIN norm n USING (algo, user_id, item_id) GROUP BY 1, 2", **VIEWS)
def score_features(v: Views):
    return ensemble.score_features(v.scores(), ALGOS)


@query("ensemble_first_level", "SELECT user_id, item_id, round(score, 6) AS score FROM first_level", **VIEWS)
def ensemble_first_level(v: Views):
    return first_level(v)


@query("ensemble_features", "SELECT user_id, item_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + 1e-8, 6) AS ensemble_norm FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (SELECT f.user_id, f.item_id, f.score + coalesce(r, 0) * 1e-3 AS score FROM first_level f LEFT JOIN (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9), item_id) AS r FROM scores WHERE algo = 'toppop') USING (user_id, item_id)) WINDOW w AS (PARTITION BY user_id))", **VIEWS)
def ensemble_features(v: Views):
    tied = ranking.break_ties(first_level(v), v.scores().where("algo = 'toppop'"), 1e-3)
    return ranking.row_minmax(tied).select("user_id", "item_id", F.col("score").alias("ensemble_norm"))


@query("ensemble_last_level", "SELECT user_id, item_id, round(sum(score * w), 6) AS score FROM norm JOIN (VALUES ('toppop', 0.2), ('global', 0.7), ('mean', -0.1)) AS t(algo, w) USING (algo) GROUP BY 1, 2", **VIEWS)
def ensemble_last_level(v: Views):
    weights = v.spark.createDataFrame([("toppop", 0.2), ("global", 0.7), ("mean", -0.1)], "algo string, w double")
    return ensemble.weighted_sum(v.scores(), weights, ["algo"])


@query("ensemble_ndcg_power", "SELECT user_id, item_id, round(sum(score * value * value), 6) AS score FROM norm JOIN (SELECT algo, user_id, value FROM a_ndcg LEFT JOIN n_sparse t USING (user_id) LEFT JOIN n_inter m USING (user_id) WHERE algo <> 'mean' OR (coalesce(t.n, 0) < 4 AND coalesce(m.n, 0) >= 4)) USING (algo, user_id) GROUP BY 1, 2", **VIEWS)
def ensemble_ndcg_power(v: Views):
    weights = ensemble.ndcg_weights(algo_ndcg(v), ["mean"], stats.counts(v.sparse(), "user_id", "n"), stats.counts(v.interactions(), "user_id", "n"))
    return ensemble.by_user_weight(v.scores(), weights)


@query("ensemble_pldiff", "SELECT user_id, item_id, round(sum(score * sqrt(greatest(m.n - coalesce(t.n, 0), 0) + 1)), 6) AS score FROM norm JOIN n_inter m USING (user_id) LEFT JOIN n_sparse t USING (user_id) GROUP BY 1, 2", **VIEWS)
def ensemble_pldiff(v: Views):
    diff = stats.count_difference(v.interactions(), v.sparse(), "user_id", "d").select("user_id", F.pow(F.col("d") + 1, 0.5).alias("w"))
    algos = v.spark.createDataFrame([(a,) for a in ALGOS], "algo string")
    return ensemble.by_user_weight(v.scores(), diff.crossJoin(F.broadcast(algos)))  # three algorithms


@query("fill_solution", "SELECT b.user_id, b.item_id, round(coalesce(p.score + 2, b.score), 6) AS score FROM (SELECT * FROM norm WHERE algo = 'global') b LEFT JOIN (SELECT user_id, item_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + 1e-8 AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WHERE algo = 'mean' AND score > 2.9 WINDOW w AS (PARTITION BY user_id))) p USING (user_id, item_id)", **VIEWS)
def fill_solution(v: Views):
    s = v.scores()
    return ensemble.fill(s.where("algo = 'mean' and score > 2.9"), s.where("algo = 'global'"))


@query("oof_average", "SELECT user_id, item_id, round(avg(score), 6) AS score FROM norm GROUP BY 1, 2", **VIEWS)
def oof_average(v: Views):
    return ensemble.oof_average(ranking.row_minmax(v.scores(), "algo", "user_id"))


@query("fold_average", f"SELECT 10::BIGINT AS cutoff, algo AS metric, round(avg(value), 6) AS value FROM (SELECT fold, algo, avg(value) AS value FROM a_ndcg JOIN (SELECT user_id, (row_number() OVER (ORDER BY {h(7, 'user_id')}, user_id) - 1) % 5 AS fold FROM (SELECT DISTINCT user_id FROM interactions)) USING (user_id) GROUP BY 1, 2) GROUP BY 2", **VIEWS)
def fold_average(v: Views):
    folds = algo_ndcg(v).join(splits.group_kfold(v.interactions(), 5, 7), "user_id").groupBy("fold", F.col("algo").alias("metric")).agg(F.avg("value").alias("value"))
    return stats.fold_average(folds.withColumn("cutoff", F.lit(10).cast("long")))


@query("weighted_objective", "SELECT round(sum(value * CASE algo WHEN 'global' THEN 2 ELSE 1 END) / sum(CASE algo WHEN 'global' THEN 2 ELSE 1 END), 6) AS objective FROM (SELECT algo, avg(value) AS value FROM a_ndcg GROUP BY 1)", **VIEWS)
def weighted_objective(v: Views):
    means = algo_ndcg(v).groupBy("algo").agg(F.avg("value").alias("value"))
    return stats.weighted_objective(means, F.when(F.col("algo") == "global", 2.0).otherwise(1.0))


@query(
    "weight_sweep",
    "SELECT bucket, arg_max(vector, (round(value, 9), -vector)) AS vector, round(max(value), 6) AS value FROM (SELECT bucket, vector, avg(value) AS value FROM (SELECT vector, user_id, max(CASE WHEN t.item_id IS NOT NULL AND rank <= 10 THEN ln(2) / ln(rank + 1) ELSE 0 END) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vector, user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM tried) LEFT JOIN test t USING (user_id, item_id) GROUP BY 1, 2) JOIN buckets USING (user_id) GROUP BY 1, 2) GROUP BY 1",
    **VIEWS,
    tried=f"SELECT vector, user_id, item_id, sum(score * {u(5, 'vector', 'algo')}) AS score FROM norm, (SELECT unnest(range(0, 6)) AS vector) GROUP BY 1, 2, 3",
)
def weight_sweep(v: Views):
    return ensemble.weight_sweep(v.scores(), v.test(), buckets(v), ALGOS, 6, 5)


@query("weight_search")
def weight_search(v: Views):
    """From equal weights of the three models, each bucket's weights by exact line searches."""
    start = {b: {a: 1.0 / len(ALGOS) for a in ALGOS} for b in BUCKETS}
    return ensemble.weight_search(v.scores(), v.test(), buckets(v), start)


@query(
    "early_stop_epoch",
    "SELECT model, coalesce(min(best) FILTER (WHERE epoch = stop), arg_max(best, epoch)) AS best_epoch, coalesce(any_value(stop), max(epoch)) AS stop_epoch FROM (SELECT *, min(CASE WHEN epoch - best >= 3 THEN epoch END) OVER (PARTITION BY model) AS stop FROM (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY model ORDER BY epoch) AS best FROM (SELECT *, coalesce(value > max(value) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * 1.002, true) AS better FROM epochs))) GROUP BY 1",
    epochs="SELECT event_type AS model, day(ts)::BIGINT AS epoch, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
)
def early_stop(v: Views):
    epochs = v.table("events").where("value is not null").groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(F.avg("value").alias("value"))
    return ensemble.early_stop(epochs)


#: Latent factors of the last stage's frame.
RANK = 4


def final_features(v: Views):
    """Candidates with counts, raw and normalised scores, the first-level ensemble and latent factors."""
    keys = ["user_id", "item_id"]
    frame = stats.basic_features(v.candidates(), v.train()).join(ensemble.score_features(v.scores(), ALGOS), keys, "left")
    frame = frame.join(first_level(v).withColumnRenamed("score", "ensemble"), keys, "left")
    users, items = factors.als(v.train(), RANK, 3)
    both = factors.factor_features(v.candidates(), users, items)
    latent = both.select(*keys, "u_norm", "i_norm", *[F.col(f"{s}_vec")[k].alias(f"{s}_{k}") for s in "ui" for k in range(RANK)])
    return frame.join(latent, keys, "left")


@query("final_stage")
def final_stage(v: Views):
    """The whole last stage: a stored frame, columns of no use removed, the ranker over grouped folds of the source markets and the mean of its models on the target markets, ties broken by the first-level ensemble, score files written and read again; market, n_users and mean NDCG at 10."""
    keys = ["user_id", "item_id"]
    people = v.interactions().select("market", "user_id").distinct()
    frame = files.kept_frame(v.spark, fresh_path(v.spark, "frame"), lambda: final_features(v).join(people, "user_id"))
    columns = [c for c in frame.columns if c not in (*keys, "market")]
    gone = stats.useless_columns(frame.fillna(0.0, columns), columns)
    kept = [c for c in columns if c not in gone]
    rows = ltr.labels(frame, v.test()).join(frame, keys).select("market", F.col("user_id").alias("qid"), F.col("item_id").alias("doc_id"), F.col("label").cast("double").alias("rel"), *kept).fillna(0.0, kept)
    held, told = ltr.cross_validated(rows.where(F.col("market").isin(SOURCES)), kept, 3, 687, rows.where(F.col("market").isin(TARGETS)), rounds=4, patience=2)
    out = None
    for scores, path in ((held, fresh_path(v.spark, "valid-scores")), (told, fresh_path(v.spark, "test-scores"))):
        named = scores.select(F.col("qid").alias("user_id"), F.col("doc_id").alias("item_id"), "score")
        files.write_scores(ranking.break_ties(named, ranking.row_minmax(first_level(v)), 1e-8, by_value=True), path, compress=False)
        one = files.read_scores(v.spark, path).select(F.col("user_id").cast("long").alias("qid"), F.col("item_id").cast("long").alias("doc_id"), "score")
        out = one if out is None else out.unionByName(one)
    values = ltr.ndcg(out.join(rows.select("market", "qid", "doc_id", "rel"), ["qid", "doc_id"]))
    return values.join(people.withColumnRenamed("user_id", "qid"), "qid").groupBy("market").agg(F.count(F.lit(1)).alias("n_users"), F.avg("value").alias("ndcg"))
