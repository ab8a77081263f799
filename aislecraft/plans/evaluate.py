"""Queries of ranking metrics, significance tests and learning-to-rank metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_uniform
from aislecraft.operators import ltr, metrics, models, ranking, significance, stats
from aislecraft.plans.base import query
from aislecraft.plans.sql import h, u
from aislecraft.sources.storage import stored
from aislecraft.sources.views import SEED, Views

CUTOFFS = [5, 10, 20]

VIEWS = {
    "hold": f"SELECT *, CASE WHEN {u(42, chr(39) + 'hold' + chr(39), 'user_id', 'item_id')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM interactions",
    "h_test": "SELECT user_id, item_id, rating FROM hold WHERE part = 'test'",
    "h_pop": "SELECT item_id, count(*) AS n FROM hold WHERE part = 'train' GROUP BY 1",
    "h_scores": "SELECT c.user_id, c.item_id, log10(coalesce(n, 0) + 1) AS score FROM (SELECT user_id, item_id FROM negs UNION SELECT user_id, item_id FROM h_test) c LEFT JOIN h_pop USING (item_id)",
    "h_lists": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM h_scores) WHERE rank <= 20",
    "h_cum": "SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY rank) AS cum FROM (SELECT l.user_id, l.item_id, rank, (t.item_id IS NOT NULL)::INT AS rel FROM h_lists l LEFT JOIN h_test t USING (user_id, item_id))",
    "h_sums": "SELECT cutoff, user_id, count(*) AS len, sum(rel) AS hits, sum(rel * cum / rank) AS ap, min(rank) FILTER (WHERE rel = 1) AS first, sum(rel / rank) AS arhr, sum(rel / ln(rank + 1)) AS dcg, sum(rel * (rank - cum)) AS above FROM h_cum JOIN (SELECT unnest([5, 10, 20]) AS cutoff) ON rank <= cutoff GROUP BY 1, 2",
    "h_user": "SELECT cutoff::BIGINT AS cutoff, user_id, hits / len AS \"precision\", hits / least(len, n_test) AS precision_min, hits / n_test AS recall, hits / least(n_test, len) AS recall_min, ap / least(n_test, len) AS map, coalesce(1 / first, 0) AS mrr, arhr, dcg / list_sum(list_transform(range(1, least(cutoff, n_test) + 1), lambda i: 1 / ln(i + 1))) AS ndcg, CASE WHEN hits > 0 THEN 2 * (hits / len) * (hits / n_test) / (hits / len + hits / n_test) ELSE 0 END AS f1, hits::DOUBLE AS hit_rate, CASE WHEN len > hits THEN CASE WHEN hits > 0 THEN (hits * (len - hits) - above) / (hits * (len - hits)) ELSE 0 END END AS auc FROM h_sums JOIN (SELECT user_id, count(*) AS n_test FROM h_test GROUP BY 1) USING (user_id)",
    "h_top": "SELECT * FROM h_lists WHERE rank <= 10",
    "h_counts": "SELECT item_id, count(*) AS n FROM h_top GROUP BY 1",
    "h_profiles": "SELECT user_id, item_id FROM (SELECT DISTINCT user_id FROM hold) LEFT JOIN (SELECT user_id, item_id FROM hold WHERE part = 'train') USING (user_id)",
    "a_rank": "SELECT algo, user_id, item_id, row_number() OVER (PARTITION BY algo, user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM scores",
    "a_ndcg": "SELECT algo, user_id, max(CASE WHEN t.item_id IS NOT NULL AND rank <= 10 THEN ln(2) / ln(rank + 1) ELSE 0 END) AS value FROM a_rank LEFT JOIN test t USING (user_id, item_id) GROUP BY 1, 2",
    "a_pairs": "SELECT a.user_id, a.value AS a, b.value AS b FROM a_ndcg a JOIN a_ndcg b USING (user_id) WHERE a.algo = 'global' AND b.algo = 'toppop'",
    "l_rank": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rel, doc_id) AS rank, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS best FROM ltr",
}


def hold(v: Views) -> DataFrame:
    return v.written().withColumn("part", F.when(hash_uniform(SEED, F.lit("hold"), F.col("user_id"), F.col("item_id")) < 0.8, "train").otherwise("test"))


def held(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists of 20 (user_id, item_id, rank), test rows and popularity: negatives and test items ranked by popularity in train."""
    rows = hold(v)
    test, pop = rows.where("part = 'test'").select("user_id", "item_id", "rating"), stats.counts(rows.where("part = 'train'"), "item_id", "n")
    from aislecraft.operators.negatives import fixed_negatives

    inter = v.interactions()
    negatives = fixed_negatives(inter.select("user_id").distinct(), inter, inter.select("item_id").distinct(), 99, SEED)
    cand = negatives.select("user_id", "item_id").union(test.select("user_id", "item_id"))  # negatives are unseen: no row twice
    scores = cand.join(pop, "item_id", "left").select("user_id", "item_id", F.log10(F.coalesce("n", F.lit(0)) + 1).alias("score"))
    return ranking.top_k(scores, 20), test, pop


def eval_query(name: str, metric: str) -> None:
    @query(name, f'SELECT cutoff, round(avg("{metric}"), 6) AS value FROM h_user GROUP BY 1', **VIEWS)
    def run(v: Views):
        lists, test, _ = held(v)
        return metrics.global_metric(metrics.per_user(lists, test, CUTOFFS), metric)


for _name, _metric in {"precision": "precision", "precision_min": "precision_min", "recall": "recall", "recall_min": "recall_min", "map": "map", "mrr": "mrr", "arhr": "arhr", "ndcg": "ndcg", "f1": "f1", "hit_rate": "hit_rate", "auc": "auc"}.items():
    eval_query(f"eval_{_name}", _metric)


@query("metric_per_user", 'SELECT cutoff, user_id, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM h_user', **VIEWS)
def metric_per_user(v: Views):
    lists, test, _ = held(v)
    return metrics.per_user(lists, test, CUTOFFS).select("cutoff", "user_id", "precision", "recall", "ndcg")


@query("eval_rmse", "SELECT round(avg(r), 6) AS value FROM (SELECT sqrt(avg((score - rating) ** 2)) AS r FROM scores s JOIN test t USING (user_id, item_id) WHERE algo = 'global' GROUP BY s.user_id)", **VIEWS)
def eval_rmse(v: Views):
    return metrics.rmse(v.scores().where("algo = 'global'"), v.test().select("user_id", "item_id", "rating"))


@query("eval_coverage_item", "SELECT round(count(r.item_id) / count(*), 6) AS coverage, round(count(h) / count(*), 6) AS coverage_test FROM (SELECT DISTINCT item_id FROM interactions) c LEFT JOIN (SELECT item_id, max(CASE WHEN t.user_id IS NOT NULL THEN 1 END) AS h FROM h_top l LEFT JOIN h_test t USING (user_id, item_id) GROUP BY 1) r USING (item_id)", **VIEWS)
def coverage_item(v: Views):
    lists, test, _ = held(v)
    return metrics.coverage_item(lists.where("rank <= 10"), test, v.interactions())


@query("eval_coverage_user", "SELECT round(count(l.user_id) / count(*), 6) AS coverage FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) LEFT JOIN (SELECT DISTINCT user_id FROM h_top) l USING (user_id)", **VIEWS)
def coverage_user(v: Views):
    return metrics.coverage_user(held(v)[0], v.table("customer").select(F.col("c_custkey").alias("user_id")))


def diversity(name: str, f, sql: str) -> None:
    @query(name, sql, **VIEWS)
    def run(v: Views):
        return f(stats.recommendation_counts(held(v)[0].where("rank <= 10")))


GINI = "SELECT round(2 * sum((m + 1 - i) / (m + 1) * n / t), 6) AS value FROM (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m, sum(n) OVER () AS t FROM {})"
HERF = "SELECT round(1 - sum((n / t) ** 2), 6) AS value FROM (SELECT n, sum(n) OVER () AS t FROM {})"
SHAN = "SELECT round(-sum(n / t * log2(n / t)), 6) AS value FROM (SELECT n, sum(n) OVER () AS t FROM {})"
diversity("eval_gini", metrics.gini, GINI.format("h_counts"))
diversity("eval_herfindahl", metrics.herfindahl, HERF.format("h_counts"))
diversity("eval_shannon", metrics.shannon, SHAN.format("h_counts"))

NOVELTY = "SELECT {} AS value FROM (SELECT user_id, coalesce(sum(-log2(n / t) / items), 0) AS v FROM {} LEFT JOIN (SELECT item_id, n, sum(n) OVER () AS t, count(*) OVER () AS items FROM h_pop) USING (item_id) GROUP BY 1)"
POPULARITY = "SELECT {} AS value FROM (SELECT user_id, coalesce(sum(n / m), 0) / count(*) AS v FROM {} LEFT JOIN (SELECT item_id, n, max(n) OVER () AS m FROM h_pop) USING (item_id) GROUP BY 1)"
MEAN = "round(avg(v), 6)"


@query("eval_novelty", NOVELTY.format(MEAN, "h_top"), **VIEWS)
def novelty(v: Views):
    lists, _, pop = held(v)
    return metrics.novelty(lists.where("rank <= 10"), pop)


@query("eval_avg_popularity", POPULARITY.format(MEAN, "h_top"), **VIEWS)
def avg_popularity(v: Views):
    lists, _, pop = held(v)
    return metrics.average_popularity(lists.where("rank <= 10"), pop)


@query("eval_inter_list", "SELECT round(1 - ((s - users * 10) / 10) / (users * users - users), 6) AS value FROM (SELECT sum(n * n)::DOUBLE AS s FROM h_counts), (SELECT count(DISTINCT user_id) AS users FROM h_top)", **VIEWS)
def inter_list(v: Views):
    return metrics.inter_list(held(v)[0].where("rank <= 10"), 10)


@query("eval_intra_list", "SELECT round(avg(v), 6) AS value FROM (SELECT user_id, sum(1 - coalesce(w, 0)) / (max(m) * (max(m) - 1)) AS v FROM (SELECT a.user_id, a.item_id AS src, b.item_id AS dst, a.m FROM (SELECT *, max(rank) OVER (PARTITION BY user_id) AS last, count(*) OVER (PARTITION BY user_id) AS m FROM h_top) a JOIN h_top b USING (user_id) WHERE a.rank <> b.rank AND a.rank < last) LEFT JOIN (SELECT a.item_id AS src, b.item_id AS dst, count(*) / 5.0 AS w FROM item_features a JOIN item_features b USING (feature) GROUP BY 1, 2) USING (src, dst) GROUP BY 1)", **VIEWS)
def intra_list(v: Views):
    """Similarity: the share of five features that two items have in common."""
    sets = v.item_features().groupBy("item_id").agg(F.collect_set("feature").alias("features"))
    return metrics.intra_list_of(held(v)[0].where("rank <= 10"), sets, 5)


def _ratio(name: str, top: str, below: str) -> str:
    return f"SELECT '{name}' AS metric, round(a.value / b.value, 6) AS value FROM ({top}) a, ({below}) b"


RATIOS = [_ratio(name, sql.format("h_counts"), sql.format("h_pop")) for name, sql in (("shannon", SHAN), ("herfindahl", HERF), ("gini", GINI))]
RATIOS += [_ratio(name, sql.format("avg(v)", "h_top"), sql.format("avg(v)", "h_profiles")) for name, sql in (("novelty", NOVELTY), ("avg_popularity", POPULARITY))]


@query("eval_ratio", " UNION ALL ".join(RATIOS), **VIEWS)
def ratio(v: Views):
    """Of the five metrics that have one: the value of the lists over that of the profiles in train, of all users."""
    lists, _, pop = held(v)
    lists, pop, rows = stored(lists.where("rank <= 10").select("user_id", "item_id"), "lists"), stored(pop, "popularity"), hold(v)
    profiles = rows.select("user_id").distinct().join(rows.where("part = 'train'").select("user_id", "item_id"), "user_id", "left")
    counts, out = stats.recommendation_counts(lists), None
    both = {name: [f(x).select(F.round("value", 6).alias("value")) for x in (counts, pop)] for name, f in (("shannon", metrics.shannon), ("herfindahl", metrics.herfindahl), ("gini", metrics.gini))}
    both |= {name: [f(x, pop) for x in (lists, profiles)] for name, f in (("novelty", metrics.novelty), ("avg_popularity", metrics.average_popularity))}
    for name, (top, below) in both.items():
        of_rows = top.withColumnRenamed("value", "x").crossJoin(below.withColumnRenamed("value", "y"))  # rows of one
        one = of_rows.select(F.lit(name).alias("metric"), F.round(F.col("x") / F.col("y"), 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("eval_holdout", "SELECT round(avg(CASE WHEN hit IS NULL THEN 0 ELSE hit / 10 END), 6) AS value FROM (SELECT DISTINCT user_id FROM h_test) t LEFT JOIN (SELECT user_id, count(t.item_id) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (SELECT a.user_id, s.dst AS item_id, sum(a.rating * s.w) AS score FROM hold a JOIN co s ON s.src = a.item_id WHERE part = 'train' GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM hold b WHERE b.part = 'train' AND b.user_id = x.user_id AND b.item_id = x.item_id)) LEFT JOIN h_test t USING (user_id, item_id) WHERE r <= 10 GROUP BY 1) USING (user_id)", **VIEWS, co="SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM (SELECT a.item_id AS src, b.item_id AS dst, count(*) AS w FROM hold a JOIN hold b USING (user_id) WHERE a.part = 'train' AND b.part = 'train' AND a.item_id <> b.item_id GROUP BY 1, 2)) WHERE r <= 20")
def eval_holdout(v: Views):
    """The whole catalogue minus seen items, reached through co-occurrence: precision at 10."""
    from aislecraft.operators import models, similarity

    rows = hold(v)
    train, test = rows.where("part = 'train'").select("user_id", "item_id", "rating"), rows.where("part = 'test'").select("user_id", "item_id", "rating")
    binary = train.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.lit(1.0).alias("value"))
    together = similarity.pair_sums(binary, best=(20, lambda dot, n, si, sj: dot))
    near = similarity.top_neighbours(together.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("dot").alias("weight")), 20, "src", "dst")
    scores = models.item_scores(train, near).join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    lists = ranking.top_k(scores, 10)
    hits = lists.join(test.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").groupBy("user_id").agg((F.count(F.lit(1)) / 10).alias("p"))
    return test.select("user_id").distinct().join(hits, "user_id", "left").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("value"))


@query("eval_negatives", "SELECT algo, round(avg(value), 6) AS value FROM a_ndcg GROUP BY 1", **VIEWS)
def eval_negatives(v: Views):
    return algo_ndcg(v).groupBy("algo").agg(F.avg("value").alias("value"))


def algo_ndcg(v: Views) -> DataFrame:
    """algo, user_id, value: NDCG at 10 over the candidates."""
    order = Window.partitionBy("algo", "user_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    ranks = v.scores().withColumn("rank", F.row_number().over(order)).join(v.test().select("user_id", "item_id", F.lit(1).alias("rel")), ["user_id", "item_id"], "left")
    return ranks.groupBy("algo", "user_id").agg(F.max(F.when((F.col("rel") == 1) & (F.col("rank") <= 10), F.log(F.lit(2.0)) / F.log(F.col("rank") + 1)).otherwise(0.0)).alias("value"))


@query("eval_scores_ndcg", "SELECT round(avg(value), 6) AS value FROM a_ndcg WHERE algo = 'mean'", **VIEWS)
def scores_ndcg(v: Views):
    return algo_ndcg(v).where("algo = 'mean'").agg(F.avg("value").alias("value"))


def _pairs(v: Views) -> DataFrame:
    values = algo_ndcg(v)
    return values.where("algo = 'global'").select("user_id", F.col("value").alias("a")).join(values.where("algo = 'toppop'").select("user_id", F.col("value").alias("b")), "user_id")


@query("paired_t", "SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM a_pairs", **VIEWS)
def paired_t(v: Views):
    return significance.paired_t(_pairs(v))


@query("two_sample_t", "SELECT a.algo AS a, b.algo AS b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t FROM (SELECT algo, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM a_ndcg GROUP BY 1) a JOIN (SELECT algo, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM a_ndcg GROUP BY 1) b ON a.algo < b.algo", **VIEWS)
def two_sample_t(v: Views):
    return significance.two_sample_t(algo_ndcg(v))


@query("wilcoxon", "SELECT n, w_plus, w_minus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM (SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), 6) AS w_plus, round(sum(CASE WHEN d < 0 THEN rk ELSE 0 END), 6) AS w_minus, sum(c * c - 1) AS ties FROM (SELECT d, c, rank() OVER (ORDER BY abs(d)) + (c - 1) / 2 AS rk FROM (SELECT d, count(*) OVER (PARTITION BY abs(d)) AS c FROM (SELECT round(a - b, 9) AS d FROM a_pairs) WHERE d <> 0)))", **VIEWS)
def wilcoxon(v: Views):
    return significance.wilcoxon(_pairs(v))


@query("significance")
def significant(v: Views):
    """The three models' NDCG of the users, the gate's choice of test, p-values and decisions."""
    return significance.compare(algo_ndcg(v), "global", ["mean", "toppop"])


@query("normality")
def normality(v: Views):
    return significance.normality(v.table("events").select("value").na.drop())


def corrected(name: str, gamma: float | None) -> None:
    @query(name)
    def run(v: Views):
        lists, test = ranking.top_k(models.top_pop(v.train(), v.candidates()), 20), v.test()
        n = v.interactions().select("item_id").distinct().count()
        weights = metrics.sampled_correction(v.spark, n, 100, 10, "ndcg", gamma)  # a user's test item is ranked among 100: itself and 99 sampled ones
        hits = lists.join(test.select("user_id", "item_id", F.lit(1).alias("rel")), ["user_id", "item_id"], "left").fillna(0, ["rel"])
        return metrics.corrected(hits, weights)


corrected("eval_corrected_bv", 0.01)
corrected("eval_corrected_cls", None)


@query("ltr_dcg", "SELECT qid, round(sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END), 6) AS value FROM l_rank GROUP BY 1", **VIEWS)
def ltr_dcg(v: Views):
    return ltr.dcg(v.ltr())


NDCG = "SELECT qid, CASE WHEN b > 0 THEN a / b ELSE 0 END AS value FROM (SELECT qid, sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS a, sum(CASE WHEN best <= 10 THEN (2 ** rel - 1) / log2(best + 1) ELSE 0 END) AS b FROM l_rank GROUP BY 1)"


@query("ltr_ndcg", f"SELECT qid, round(value, 6) AS value FROM ({NDCG})", **VIEWS)
def ltr_ndcg(v: Views):
    return ltr.ndcg(v.ltr())


@query("ltr_err", "SELECT qid, round(sum(CASE WHEN rank <= 10 THEN p * r / rank ELSE 0 END), 6) AS value FROM (SELECT qid, rank, p, exp(coalesce(sum(ln(1 - p)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS r FROM (SELECT qid, rank, (2 ** rel - 1) / 4 AS p FROM l_rank)) GROUP BY 1", **VIEWS)
def ltr_err(v: Views):
    return ltr.err(v.ltr(), 2)


@query("ltr_ap", "SELECT qid, round(CASE WHEN sum(r) > 0 THEN sum(CASE WHEN rank <= 10 THEN r * cum / rank ELSE 0 END) / sum(r) ELSE 0 END, 6) AS value FROM (SELECT *, sum(r) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM (SELECT *, (rel > 0.5)::INT AS r FROM l_rank)) GROUP BY 1", **VIEWS)
def ltr_ap(v: Views):
    return ltr.ap(v.ltr())


@query("ltr_auc", "SELECT qid, round(CASE WHEN sum(r) > 0 AND sum(r) < count(*) THEN 1 - sum(r * (rank - cum)) / (sum(r) * (count(*) - sum(r))) ELSE 0 END, 6) AS value FROM (SELECT *, sum(r) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM (SELECT *, (rel > 0.5)::INT AS r FROM l_rank)) GROUP BY 1", **VIEWS)
def ltr_auc(v: Views):
    return ltr.auc(v.ltr())


@query("ltr_kendall", "SELECT qid, round(CASE WHEN n > 1 THEN coalesce(s, 0) / (n * (n - 1) / 2) ELSE 0 END, 6) AS value FROM (SELECT qid, count(*) AS n FROM l_rank GROUP BY 1) LEFT JOIN (SELECT a.qid, sum(sign(a.rel - b.rel)) AS s FROM l_rank a JOIN l_rank b ON a.qid = b.qid AND a.rank < b.rank GROUP BY 1) USING (qid)", **VIEWS)
def ltr_kendall(v: Views):
    return ltr.kendall(v.ltr())


@query("ltr_random_ev", "SELECT qid, round(e, 6) AS dcg, round(CASE WHEN ideal > 0 THEN e / ideal ELSE 0 END, 6) AS ndcg FROM (SELECT qid, ideal, g / n * list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))) AS e FROM (SELECT qid, count(*) AS n, sum(2 ** rel - 1) AS g, sum(CASE WHEN best <= 10 THEN (2 ** rel - 1) / log2(best + 1) ELSE 0 END) AS ideal FROM l_rank GROUP BY 1))", **VIEWS)
def ltr_random(v: Views):
    return ltr.random_dcg(v.ltr())


@query("ltr_mean", f"SELECT round(avg(value), 6) AS value FROM ({NDCG})", **VIEWS)
def ltr_mean(v: Views):
    return ltr.mean_metric(ltr.ndcg(v.ltr()))


@query(
    "ltr_lambdas",
    "SELECT qid, doc_id, round(coalesce(l, 0), 6) AS lambda, round(coalesce(w, 0), 6) AS delta FROM ltr LEFT JOIN (SELECT qid, doc_id, sum(l) AS l, sum(w) AS w FROM (SELECT qid, a_doc AS doc_id, l, w FROM l_pairs UNION ALL SELECT qid, b_doc, -l, w FROM l_pairs) GROUP BY 1, 2) USING (qid, doc_id)",
    **VIEWS,
    l_gain="SELECT *, 2 ** rel - 1 AS g, CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END AS d, sum(CASE WHEN best <= 10 THEN (2 ** rel - 1) / log2(best + 1) ELSE 0 END) OVER (PARTITION BY qid) AS ideal FROM l_rank",
    l_pairs="SELECT qid, a_doc, b_doc, CASE WHEN worse THEN -lg * ch ELSE lg * ch END AS l, (1 - lg) * lg * ch AS w FROM (SELECT a.qid, a.doc_id AS a_doc, b.doc_id AS b_doc, a.rel < b.rel AS worse, abs((b.g - a.g) * (a.d - b.d) / a.ideal) AS ch, 1 / (1 + exp(CASE WHEN a.rel < b.rel THEN b.score - a.score ELSE a.score - b.score END)) AS lg FROM l_gain a JOIN l_gain b ON a.qid = b.qid AND a.rank < b.rank AND a.rel <> b.rel WHERE a.rank <= 10 AND a.ideal > 0)",
)
def ltr_lambdas(v: Views):
    return ltr.lambdas(v.ltr())


@query("ltr_labels", "SELECT c.user_id, c.item_id, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END::BIGINT AS label FROM candidates c LEFT JOIN test t USING (user_id, item_id)", **VIEWS)
def ltr_labels(v: Views):
    return ltr.labels(v.candidates(), v.test())


def _document_features(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", "source", F.length("text").cast("double").alias("f_len"), F.size(F.split("text", " ")).cast("double").alias("f_words"), F.size(F.split("text", "\n")).cast("double").alias("f_lines"))


def _features(v: Views) -> DataFrame:
    return v.ltr().join(_document_features(v).drop("source"), "doc_id")


@query("ltr_gbt")
def ltr_gbt(v: Views):
    """Boosted rounds of lambda gradients on three features; the mean NDCG before and after."""
    rows = _features(v)
    boosted = ltr.lambda_mart(rows, ["f_len", "f_words", "f_lines"], rounds=3)
    return ltr.mean_metric(ltr.ndcg(boosted)).withColumn("model", F.lit("boosted")).unionByName(ltr.mean_metric(ltr.ndcg(rows.withColumn("score", F.lit(0.0)))).withColumn("model", F.lit("none")))


@query("ltr_cv")
def ltr_cv(v: Views):
    """Grouped folds with early stopping: the mean out-of-fold NDCG of each fold's queries."""
    held, _ = ltr.cross_validated(_features(v), ["f_len", "f_words", "f_lines"], 3, 13, rounds=4, patience=2)
    values = ltr.ndcg(held).join(held.select("qid", "fold").distinct(), "qid")
    return values.groupBy("fold").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("value").alias("ndcg"))


#: NDCG of the documents whose features f are dealt anew.
def _dealt(f: str | None) -> str:
    fresh = lambda c: f"d.{c}" if c == f else f"a.{c}"
    rows = f"SELECT a.qid, a.doc_id, a.rel, {fresh('f_len')} - 100 * {fresh('f_lines')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS n FROM l_feat) a JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {h(7, chr(39) + str(f) + chr(39), 'qid', 'doc_id')}, doc_id) AS n FROM l_feat) d ON a.qid = d.qid AND a.n = d.n"
    ranks = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rel, doc_id) AS rank, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS best FROM ({rows})"
    return f"SELECT avg(CASE WHEN b > 0 THEN a / b ELSE 0 END) AS value FROM (SELECT qid, sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS a, sum(CASE WHEN best <= 10 THEN (2 ** rel - 1) / log2(best + 1) ELSE 0 END) AS b FROM ({ranks}) GROUP BY 1)"


@query(
    "permutation_importance",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, round((SELECT value FROM ({_dealt(None)})) - value, 6) AS drop FROM ({_dealt(f)})" for f in ("f_len", "f_lines")),
    **VIEWS,
    l_feat="SELECT l.qid, doc_id, l.rel, length(text)::DOUBLE AS f_len, len(string_split(text, chr(10)))::DOUBLE AS f_lines FROM ltr l JOIN documents d USING (doc_id)",
)
def permutation(v: Views):
    """Of a given expression over two features."""
    return ltr.permutation_importance(_features(v).drop("score"), ["f_len", "f_lines"], F.col("f_len") - 100 * F.col("f_lines"))


NAMES = ["f_len", "f_words", "f_lines"]


@query("ranker_importance")
def ranker_importance(v: Views):
    """Of the trained rankers of grouped folds, by fold and feature."""
    rows = stored(_features(v).drop("score"), "features")
    held, _, models = ltr.folded(rows, NAMES, 3, 13, rounds=3)
    return ltr.fold_importance(rows, NAMES, held, models)


@query("oof_ranker")
def oof_ranker(v: Views):
    """Out-of-fold scores of the labelled documents, and the folds' mean of all documents without labels (fold is null)."""
    rows = stored(_features(v).drop("score"), "features")
    others = _document_features(v).join(rows.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("source", "qid")
    held, told, _ = ltr.folded(rows, NAMES, 3, 13, others, rounds=3)
    return held.select("fold", "qid", "doc_id", "score").unionByName(told.select(F.lit(None).cast("long").alias("fold"), "qid", "doc_id", "score"))
