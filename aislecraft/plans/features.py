"""Queries of scalar functions, statistics and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislecraft.functions import text as fn
from aislecraft.operators import models, ranking, stats
from aislecraft.plans.base import query
from aislecraft.plans.sql import u
from aislecraft.sources.views import Views

STOP = "[" + ", ".join(f"'{w}'" for w in fn.STOP_WORDS) + "]"
FILTERED = f"list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({STOP}, w))"


@query("tag_filter", f"SELECT doc_id, array_to_string({FILTERED}, ' ') AS tags FROM documents")
def tag_filter(v: Views):
    return v.table("documents").select("doc_id", F.array_join(fn.tag_filter(F.col("text")), " ").alias("tags"))


@query("item_tokens", "SELECT DISTINCT p_partkey AS item_id, unnest(string_split(trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM part")
def item_tokens(v: Views):
    line = F.to_json(F.struct("p_name", "p_brand", F.array(F.array("p_type")).alias("categories")))
    parsed = F.from_json(line, "p_name string, p_brand string, categories array<array<string>>")
    rows = v.table("part").select(F.col("p_partkey").alias("item_id"), parsed.alias("j"))
    whole = F.concat_ws(" ", "j.p_name", "j.p_brand", F.array_join(F.flatten("j.categories"), " "))
    return rows.select("item_id", F.explode(F.array_distinct(fn.tag_filter(whole))).alias("token"))


@query("multivalue_split", "SELECT doc_id, unnest(list_filter(list_transform(string_split(lang || ', ' || source || ',,', ','), lambda x: trim(lower(x))), lambda x: x <> '')) AS value FROM documents")
def multivalue(v: Views):
    return v.table("documents").select("doc_id", F.explode(fn.multivalue(F.concat("lang", F.lit(", "), "source", F.lit(",,")))).alias("value"))


@query("prefixed_features", "SELECT p_partkey AS item_id, 'size_' || p_size AS feature, CASE WHEN p_size > 25 THEN 'LARGE_YES' ELSE 'LARGE_NO' END AS flag FROM part")
def prefixed(v: Views):
    return v.table("part").select(F.col("p_partkey").alias("item_id"), fn.prefixed("size", F.col("p_size")).alias("feature"), F.when(F.col("p_size") > 25, "LARGE_YES").otherwise("LARGE_NO").alias("flag"))


@query("multi_hot", "SELECT item_id, feature, 1.0::DOUBLE AS value FROM item_features")
def multi_hot(v: Views):
    return v.item_features().withColumn("value", F.lit(1.0))


@query("year_feature", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, year(l_shipdate)::BIGINT AS year FROM lineitem")
def year_feature(v: Views):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", fn.year_of(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("year"))


@query("overlapping_years", "SELECT o_orderkey, unnest(generate_series(year(o_orderdate) - 2, year(o_orderdate) + 2, 1))::BIGINT AS year FROM orders")
def overlapping(v: Views):
    return v.table("orders").select("o_orderkey", F.explode(fn.overlapping(F.year("o_orderdate"), 2, 1)).alias("year"))


@query("modular_bucket", "SELECT p_partkey AS item_id, (floor(p_retailprice)::BIGINT % 5) AS bucket, round(CASE WHEN p_size = 1 THEN 0 ELSE p_retailprice END, 6) AS price, p_retailprice > 950 AS dear FROM part")
def modular(v: Views):
    return v.table("part").select(F.col("p_partkey").alias("item_id"), F.pmod(F.floor("p_retailprice"), F.lit(5)).alias("bucket"), F.when(F.col("p_size") == 1, 0.0).otherwise(F.col("p_retailprice")).alias("price"), (F.col("p_retailprice") > 950).alias("dear"))


@query("embedding_l2", "SELECT id, round(n, 6) AS norm, round(vec[1] / n, 6) AS v0, round(vec[64] / n, 6) AS v63 FROM (SELECT *, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM factors)")
def embedding_l2(v: Views):
    return v.factors().select("id", fn.l2_norm(F.col("vec")).alias("norm"), fn.l2_normalised(F.col("vec")).alias("n")).select("id", "norm", F.col("n")[0].alias("v0"), F.col("n")[63].alias("v63"))


@query("l1_rows", "SELECT user_id, item_id, round(rating / sum(abs(rating)) OVER (PARTITION BY user_id), 6) AS rating FROM interactions")
def l1_rows(v: Views):
    return stats.l1_rows(v.interactions().select("user_id", "item_id", "rating"), "user_id", "rating")


@query("basic_features", "SELECT c.user_id, c.item_id, coalesce(a, 0) AS profile_length, coalesce(b, 0) AS popularity, round(ln(coalesce(a, 0) + 1), 6) AS profile_log, round(ln(coalesce(b, 0) + 1), 6) AS popularity_log FROM candidates c LEFT JOIN (SELECT user_id, count(*) AS a FROM train GROUP BY 1) USING (user_id) LEFT JOIN (SELECT item_id, count(*) AS b FROM train GROUP BY 1) USING (item_id)")
def basic(v: Views):
    return stats.basic_features(v.candidates(), v.train())


@query("dataset_stats", "SELECT n_users, n_items, n_interactions, round(100.0 * n_interactions / (n_users * n_items), 6) AS density, min_user, round(avg_user, 6) AS avg_user, max_user, min_item, round(avg_item, 6) AS avg_item, max_item FROM (SELECT count(*) AS n_users, sum(n)::BIGINT AS n_interactions, min(n) AS min_user, avg(n) AS avg_user, max(n) AS max_user FROM (SELECT count(*) AS n FROM interactions GROUP BY user_id)), (SELECT count(*) AS n_items, min(n) AS min_item, avg(n) AS avg_item, max(n) AS max_item FROM (SELECT count(*) AS n FROM interactions GROUP BY item_id))")
def dataset_stats(v: Views):
    return stats.dataset_stats(v.interactions())


@query("avg_rating_features", "SELECT c.user_id, c.item_id, round(uar, 6) AS uar, round(iar, 6) AS iar FROM candidates c LEFT JOIN (SELECT user_id, sum(rating) / (count(*) + 1e-6) AS uar FROM train GROUP BY 1) USING (user_id) LEFT JOIN (SELECT item_id, sum(rating) / (count(*) + 1e-6) AS iar FROM train GROUP BY 1) USING (item_id)")
def avg_rating(v: Views):
    train = v.train()
    return v.candidates().join(stats.mean_rating(train, "user_id", "uar"), "user_id", "left").join(stats.mean_rating(train, "item_id", "iar"), "item_id", "left").select("user_id", "item_id", "uar", "iar")


def _diff(key: str, name: str) -> str:
    return f"SELECT {key}, greatest(m - coalesce(t, 0), 0) AS {name}, round(ln(greatest(m - coalesce(t, 0), 0) + 1), 6) AS {name}_log FROM (SELECT {key}, count(*) AS m FROM interactions GROUP BY 1) LEFT JOIN (SELECT {key}, count(*) AS t FROM interactions WHERE market = 'EUROPE' GROUP BY 1) USING ({key})"


@query("pop_diff_features", _diff("item_id", "pop_diff"))
def pop_diff(v: Views):
    inter = v.interactions()
    return stats.count_difference(inter, inter.where("market = 'EUROPE'"), "item_id", "pop_diff")


@query("profile_diff", _diff("user_id", "profile_diff"))
def profile_diff(v: Views):
    inter = v.interactions()
    return stats.count_difference(inter, inter.where("market = 'EUROPE'"), "user_id", "profile_diff")


@query("user_buckets", "SELECT user_id, n, CASE WHEN n < 5 THEN 'cold' WHEN n < 8 THEN 'quite_cold' WHEN n < 12 THEN 'quite_warm' ELSE 'warm' END AS bucket FROM (SELECT user_id, count(*) AS n FROM interactions GROUP BY 1)")
def user_buckets(v: Views):
    return stats.counts(v.interactions(), "user_id", "n").withColumn("bucket", stats.bucket(F.col("n")))


@query("global_effects", "SELECT 'item' AS axis, item_id AS id, round(bi, 6) AS bias FROM ge_i UNION ALL SELECT 'user', user_id, round(bu, 6) FROM ge_u")
def global_effects(v: Views):
    _, items, users = stats.global_effects(v.train())
    return items.select(F.lit("item").alias("axis"), F.col("item_id").alias("id"), F.col("bi").alias("bias")).union(users.select(F.lit("user"), "user_id", "bu"))


@query("cold_entities", "SELECT count(*) FILTER (WHERE s.user_id IS NULL) AS n_cold, round(count(*) FILTER (WHERE s.user_id IS NULL) / count(*), 6) AS share FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) c LEFT JOIN (SELECT DISTINCT user_id FROM interactions) s USING (user_id)")
def cold_entities(v: Views):
    return stats.cold_share(v.table("customer").select(F.col("c_custkey").alias("user_id")), v.interactions(), "user_id")


@query("rec_counts", "SELECT item_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM scores WHERE algo = 'global') WHERE r <= 10 AND item_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 45) GROUP BY 1")
def rec_counts(v: Views):
    lists = ranking.top_k(v.scores().where("algo = 'global'"), 10)
    return stats.recommendation_counts(lists, v.table("part").where("p_size > 45").select(F.col("p_partkey").alias("item_id")))


@query("constant_columns", "SELECT unnest(['l_quantity', 'l_tax', 'one']) AS \"column\", unnest([a <= 1, b <= 1, true]) AS constant FROM (SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT l_tax) AS b FROM lineitem)")
def constant_columns(v: Views):
    return stats.constant_columns(v.table("lineitem").withColumn("one", F.lit(1)), ["l_quantity", "l_tax", "one"])


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query("feature_correlation", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def feature_correlation(v: Views):
    return stats.correlations(v.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("fi_filter", "SELECT feature, round(avg(d), 6) AS mean_drop, round(max(d), 6) AS max_drop FROM (SELECT event_type AS feature, day(ts) AS fold, avg(value) - 60 AS d FROM events GROUP BY 1, 2) GROUP BY 1 HAVING avg(d) < 0 AND max(d) <= 1e-8")
def fi_filter(v: Views):
    folds = v.table("events").groupBy(F.col("event_type").alias("feature"), F.dayofmonth("ts").alias("fold")).agg((F.avg("value") - 60).alias("drop"))
    return stats.importance_filter(folds)


@query("topk_per_user", "SELECT user_id, item_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(rating, 9) DESC, item_id) AS r FROM interactions) WHERE r <= 10")
def topk_per_user(v: Views):
    return ranking.top_k(v.interactions().withColumnRenamed("rating", "score"), 10).select("user_id", "item_id", "rank")


@query("topk_candidates", "SELECT user_id, item_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM scores WHERE algo = 'global') WHERE r <= 10")
def topk_candidates(v: Views):
    return ranking.top_k_candidates(models.global_effects(v.train(), v.candidates()), v.candidates(), 10).select("user_id", "item_id", "rank")


@query("row_minmax", "SELECT user_id, item_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + 1e-8, 6) AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WHERE algo = 'global' WINDOW w AS (PARTITION BY user_id))")
def row_minmax(v: Views):
    return ranking.row_minmax(v.scores().where("algo = 'global'")).select("user_id", "item_id", "score")


@query("break_ties", "SELECT a.user_id, a.item_id, round(a.score + coalesce(f, 0) * 1e-3, 6) AS score FROM scores a LEFT JOIN (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9), item_id) AS f FROM scores WHERE algo = 'global') b USING (user_id, item_id) WHERE a.algo = 'toppop'")
def break_ties(v: Views):
    s = v.scores()
    return ranking.break_ties(s.where("algo = 'toppop'"), s.where("algo = 'global'"), 1e-3)


@query("demote_seen", "SELECT c.user_id, c.item_id, round(CASE WHEN s.item_id IS NOT NULL THEN lo - 0.02 * abs(lo) ELSE score END, 6) AS score FROM (SELECT *, min(score) OVER (PARTITION BY user_id) AS lo FROM scores WHERE algo = 'global') c LEFT JOIN sparse s ON s.user_id = c.user_id AND s.item_id = c.item_id")
def demote_seen(v: Views):
    return ranking.demote_seen(v.scores().where("algo = 'global'"), v.sparse())


@query("score_floor", "SELECT user_id, item_id, round(CASE WHEN lo < hi THEN f ELSE greatest(f, 1e-8) END, 6) AS score FROM (SELECT *, coalesce(score, lo - 0.02 * abs(lo), 1e-8) AS f FROM (SELECT c.user_id, c.item_id, s.score, min(s.score) OVER w AS lo, max(s.score) OVER w AS hi FROM candidates c LEFT JOIN (SELECT * FROM scores WHERE algo = 'mean' AND score > 2.9) s USING (user_id, item_id) WINDOW w AS (PARTITION BY c.user_id)))")
def score_floor(v: Views):
    return ranking.score_floor(v.candidates(), v.scores().where("algo = 'mean' and score > 2.9"))


@query("add_noise", f"SELECT user_id, item_id, round(score + {u(97, 'user_id', 'item_id')} * 1e-3, 6) AS score FROM scores WHERE algo = 'global'")
def add_noise(v: Views):
    return ranking.add_noise(v.scores().where("algo = 'global'")).select("user_id", "item_id", "score")


@query("reduce_score", "SELECT user_id, item_id, round(CASE WHEN r <= floor(n * 0.1) THEN 0 ELSE score END, 6) AS score FROM scores JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM scores WHERE algo = 'global')) USING (user_id) WHERE algo = 'global'")
def reduce_score(v: Views):
    return ranking.reduce_score(v.scores().where("algo = 'global'"))


@query("filter_negatives", "SELECT user_id, item_id, r AS rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END + 1e-8 + CASE WHEN t.item_id IS NULL THEN 0 ELSE 10 END, 9) DESC, item_id) AS r FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM scores WHERE algo = 'global' WINDOW w AS (PARTITION BY user_id)) LEFT JOIN test t USING (user_id, item_id)) WHERE r <= 25")
def filter_negatives(v: Views):
    return ranking.filter_negatives(v.scores().where("algo = 'global'"), v.test())


@query("filler_ranks", "SELECT user_id, item_id, round(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9), item_id DESC) / (count(*) OVER (PARTITION BY user_id) + 1), 1) AS filler FROM scores WHERE algo = 'global'")
def filler_ranks(v: Views):
    return ranking.filler_ranks(v.scores().where("algo = 'global'"))


@query("ltr_rank", "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rel, doc_id) AS rank FROM ltr")
def ltr_rank(v: Views):
    return ranking.ltr_rank(v.ltr()).select("qid", "doc_id", "rank")
