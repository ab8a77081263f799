"""Queries of similarities and recommenders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_uniform
from aislecraft.operators import dense, factors, ingest, metrics, models, peritem, ranking, similarity
from aislecraft.plans.base import query
from aislecraft.plans.sql import u
from aislecraft.sources.views import Views

K = 10

VIEWS = {
    "mat": "SELECT user_id AS row, item_id AS col, rating AS value FROM train",
    "mat_user_mean": "SELECT row, col, value - avg(value) OVER (PARTITION BY row) AS value FROM mat",
    "mat_item_mean": "SELECT row, col, value - avg(value) OVER (PARTITION BY col) AS value FROM mat",
    "mat_one": "SELECT row, col, 1.0::DOUBLE AS value FROM mat",
    "feat": "SELECT feature AS row, item_id AS col, 1.0::DOUBLE AS value FROM item_features WHERE feature IN (SELECT feature FROM item_features GROUP BY 1 HAVING count(DISTINCT item_id) >= 5 AND count(DISTINCT item_id) <= 0.3 * (SELECT count(DISTINCT item_id) FROM item_features))",
    "umat": "SELECT item_id AS row, user_id AS col, rating AS value FROM train",
    "ufeat": "SELECT feature AS row, user_id AS col, 1.0::DOUBLE AS value FROM user_features WHERE user_id IN (SELECT user_id FROM train)",
    "tfi": "SELECT m.row, m.col, sqrt(value) * ln((SELECT count(DISTINCT col) FROM mat) / (1 + df)) AS value FROM mat m JOIN (SELECT row, count(*) AS df FROM mat GROUP BY 1) USING (row)",
    "hyb": "SELECT 'u' || row::VARCHAR AS row, col, value FROM mat UNION ALL SELECT 'f' || row, col, value * 0.3 FROM feat",
}


def _pairs(m: str) -> str:
    return f"SELECT a.col AS i, b.col AS j, sum(a.value * b.value) AS dot, count(*) AS n FROM {m} a JOIN {m} b ON a.row = b.row AND a.col <> b.col GROUP BY 1, 2"


def _sim(m: str, weight: str, k: int = K) -> str:
    """The best k `src` of each `dst`, both of matrix m."""
    return f"SELECT src, dst, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(weight, 9) DESC, src) AS rank FROM (SELECT j AS src, i AS dst, {weight} AS weight FROM (SELECT p.*, x.s AS si, y.s AS sj FROM ({_pairs(m)}) p JOIN (SELECT col, sum(value * value) AS s FROM {m} GROUP BY 1) x ON x.col = i JOIN (SELECT col, sum(value * value) AS s FROM {m} GROUP BY 1) y ON y.col = j)) WHERE weight <> 0) WHERE rank <= {k}"


COSINE = "dot / (sqrt(si) * sqrt(sj) + {s} + 1e-6)"


def _out(sql: str) -> str:
    return f"SELECT src, dst, rank, round(weight, 6) AS weight FROM ({sql})"


def mat(v: Views) -> DataFrame:
    return v.train().select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("value"))


def umat(v: Views) -> DataFrame:
    return v.train().select(F.col("item_id").alias("row"), F.col("user_id").alias("col"), F.col("rating").alias("value"))


def feat(v: Views) -> DataFrame:
    return ingest.prune_features(v.item_features()).select(F.col("feature").alias("row"), F.col("item_id").alias("col"), F.lit(1.0).alias("value"))


def ufeat(v: Views) -> DataFrame:
    return ingest.restrict(v.user_features(), v.train(), "user_id").select(F.col("feature").alias("row"), F.col("user_id").alias("col"), F.lit(1.0).alias("value"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "rank", "weight")


@query("cooccurrence", f"SELECT i, j, round(dot, 6) AS dot, n FROM ({_pairs('mat')}) WHERE n >= 2", **VIEWS)
def cooccurrence(v: Views):
    return similarity.cooccurrence(mat(v), 2).select("i", "j", "dot", "n")


def sim_query(kind: str, matrix: str, weight: str, **options) -> None:
    @query(f"sim_{kind}", _out(_sim(matrix, weight)), **VIEWS)
    def run(v: Views):
        return _shown(similarity.similar(mat(v), kind, K, **options))


sim_query("cosine", "mat", COSINE.format(s=100), shrink=100)
sim_query("adjusted", "mat_user_mean", COSINE.format(s=10), shrink=10)
sim_query("pearson", "mat_item_mean", COSINE.format(s=10), shrink=10)
sim_query("asymmetric", "mat", "dot / (sqrt(si) ** 0.6 * sqrt(sj) ** 1.4 + 10 + 1e-6)", shrink=10, alpha=0.3)
sim_query("jaccard", "mat_one", "dot / (si + sj - dot + 10 + 1e-6)", shrink=10)
sim_query("dice", "mat_one", "dot / (si + sj + 10 + 1e-6)", shrink=10)
sim_query("tversky", "mat_one", "dot / (dot + (si - dot) * 0.7 + (sj - dot) * 0.4 + 1e-6)", alpha=0.7, beta=0.4)
sim_query("dot", "mat", "dot / 100", shrink=100)
sim_query("euclidean", "mat", "1 / (sqrt(greatest(si + sj - 2 * dot, 0)) + 1 + 1e-6)", shrink=1)


@query("similarity_topk", f"SELECT src, dst, rank, round(weight, 6) AS weight FROM ({_sim('mat', COSINE.format(s=0), 3)})", **VIEWS)
def similarity_topk(v: Views):
    return _shown(similarity.similar(mat(v), "cosine", 3))


@query("sim_row_weighted", f"SELECT src, dst, rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(weight, 9) DESC, src) AS rank FROM (SELECT b.col AS src, a.col AS dst, sum(a.value * b.value * {u(5, 'a.row')}) AS weight FROM mat a JOIN mat b ON a.row = b.row AND a.col <> b.col GROUP BY 1, 2) WHERE weight <> 0) WHERE rank <= 10", **VIEWS)
def sim_row_weighted(v: Views):
    weights = v.train().select(F.col("user_id").alias("row")).distinct().withColumn("w", hash_uniform(5, F.col("row")))
    return _shown(similarity.similar(mat(v), "dot", K, weights=weights))


@query("tf_idf", "SELECT col AS user_id, row AS item_id, round(sqrt(value) * ln((SELECT count(DISTINCT row) FROM umat) / (1 + df)), 6) AS value FROM umat JOIN (SELECT col, count(*) AS df FROM umat GROUP BY 1) USING (col)", **VIEWS)
def tf_idf(v: Views):
    return similarity.tf_idf(umat(v)).select(F.col("col").alias("user_id"), F.col("row").alias("item_id"), "value")


@query("bm25", "SELECT col AS user_id, row AS item_id, round(value * 2.2 / (1.2 * (0.25 + 0.75 * len / (SELECT sum(value) / count(DISTINCT row) FROM umat)) + value) * ln((SELECT count(DISTINCT row) FROM umat) / (1 + df)), 6) AS value FROM umat JOIN (SELECT col, count(*) AS df FROM umat GROUP BY 1) USING (col) JOIN (SELECT row, sum(value) AS len FROM umat GROUP BY 1) USING (row)", **VIEWS)
def bm25(v: Views):
    return similarity.bm25(umat(v)).select(F.col("col").alias("user_id"), F.col("row").alias("item_id"), "value")


@query("sim_factors", "SELECT src, dst, rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(weight, 9) DESC, src) AS rank FROM (SELECT b.id AS src, a.id AS dst, list_dot_product(a.vec, b.vec) AS weight FROM factors a JOIN factors b ON a.id <> b.id)) WHERE rank <= 10")
def sim_factors(v: Views):
    return _shown(similarity.of_factors(v.factors(), K))


SIM = {"s_cos": _sim("mat", COSINE.format(s=100), 20), "s_feat": _sim("feat", COSINE.format(s=1), 20)}


@query("sim_hybrid", "SELECT src, dst, rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(weight, 9) DESC, src) AS rank FROM (SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, weight * 0.6 AS w FROM s_cos UNION ALL SELECT src, dst, weight * 0.4 FROM s_feat) GROUP BY 1, 2)) WHERE rank <= 10", **VIEWS, **SIM)
def sim_hybrid(v: Views):
    return _shown(similarity.blend(similarity.similar(mat(v), "cosine", 20, 100), similarity.similar_groups(feat(v), "cosine", 20, shrink=1), 0.6, K))


@query("sim_feature_weighted", f"SELECT src, dst, rank, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(weight, 9) DESC, src) AS rank FROM (SELECT b.col AS src, a.col AS dst, sum({u(6, 'a.row')}) AS weight FROM feat a JOIN feat b ON a.row = b.row AND a.col <> b.col GROUP BY 1, 2) WHERE weight <> 0) WHERE rank <= 10", **VIEWS)
def sim_feature_weighted(v: Views):
    f = feat(v).select(F.col("row").alias("feature"), F.col("col").alias("item_id"))
    weights = f.select("feature").distinct().withColumn("w", hash_uniform(6, F.col("feature")))
    return _shown(similarity.feature_weighted(f, weights, K))


@query("sim_overlap", "SELECT count(*) AS pairs, count(c.src) AS shared, round(count(c.src) / count(*), 6) AS share FROM s_feat f LEFT JOIN s_cos c ON c.src = f.src AND c.dst = f.dst", **VIEWS, **SIM)
def sim_overlap(v: Views):
    return similarity.overlap(similarity.similar_groups(feat(v), "cosine", 20, shrink=1), similarity.similar(mat(v), "cosine", 20, 100))


@query("knn_graph", f"SELECT src, dst, 1.0::DOUBLE AS weight FROM ({_sim('feat', '1 / (sqrt(greatest(si + sj - 2 * dot, 0)) + 1e-6)', 5)}) UNION ALL SELECT DISTINCT col, col, 1.0::DOUBLE FROM feat", **VIEWS)
def knn_graph(v: Views):
    f = feat(v)
    near = similarity.similar_groups(f, "euclidean", 5).select("src", "dst")
    return near.union(f.select(F.col("col").alias("src"), F.col("col").alias("dst")).distinct()).withColumn("weight", F.lit(1.0))


def _scored(sim: str, profile: str = "mat") -> str:
    """Scores of candidates: profile (row user, col item) times a similarity."""
    return f"SELECT p.row AS user_id, s.dst AS item_id, sum(p.value * s.weight) AS score FROM {profile} p JOIN ({sim}) s ON s.src = p.col GROUP BY 1, 2"


def _ranked(scored: str) -> str:
    return f"SELECT s.user_id, s.item_id, round(s.score, 6) AS score FROM ({scored}) s JOIN candidates c ON c.user_id = s.user_id AND c.item_id = s.item_id"


def profile(v: Views) -> DataFrame:
    return v.train().select("user_id", "item_id", "rating")


@query("score_item_knn", _ranked(_scored(_sim("mat", COSINE.format(s=100), 20))), **VIEWS)
def score_item_knn(v: Views):
    return models.item_scores(profile(v), similarity.similar(mat(v), "cosine", 20, 100), v.candidates())


@query("rec_itemknn", _ranked(_scored(_sim("tfi", COSINE.format(s=100), 20), "tfi")), **VIEWS)
def rec_itemknn(v: Views):
    """TF-IDF weighting with items as documents and users as terms; the weighted matrix is the profile too."""
    weighted = similarity.tf_idf(umat(v)).select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    prof = weighted.select(F.col("row").alias("user_id"), F.col("col").alias("item_id"), F.col("value").alias("rating"))
    return models.item_scores(prof, similarity.similar(weighted, "cosine", 20, 100), v.candidates())


@query("rec_userknn", f"SELECT s.user_id, s.item_id, round(s.score, 6) AS score FROM (SELECT s.dst AS user_id, p.col AS item_id, sum(p.value * s.weight) AS score FROM mat p JOIN ({_sim('umat', COSINE.format(s=100), 20)}) s ON s.src = p.row GROUP BY 1, 2) s JOIN candidates c ON c.user_id = s.user_id AND c.item_id = s.item_id", **VIEWS)
def rec_userknn(v: Views):
    return models.user_scores(profile(v), similarity.similar(umat(v), "cosine", 20, 100), v.candidates())


@query("rec_itemknn_cbf", _ranked(_scored(_sim("feat", COSINE.format(s=1), 20))), **VIEWS)
def rec_itemknn_cbf(v: Views):
    return models.item_scores(profile(v), similarity.similar_groups(feat(v), "cosine", 20, shrink=1), v.candidates())


@query("rec_userknn_cbf", f"SELECT s.user_id, s.item_id, round(s.score, 6) AS score FROM (SELECT s.dst AS user_id, p.col AS item_id, sum(p.value * s.weight) AS score FROM mat p JOIN ({_sim('ufeat', COSINE.format(s=1), 20)}) s ON s.src = p.row GROUP BY 1, 2) s JOIN candidates c ON c.user_id = s.user_id AND c.item_id = s.item_id", **VIEWS)
def rec_userknn_cbf(v: Views):
    return models.user_scores(profile(v), similarity.similar_groups(ufeat(v), "cosine", 20, shrink=1), v.candidates())


@query("rec_hybrid", _ranked(_scored(_sim("hyb", COSINE.format(s=10), 20))), **VIEWS)
def rec_hybrid(v: Views):
    return models.item_scores(profile(v), similarity.similar(ingest.hybrid_stack(mat(v), feat(v), 0.3), "cosine", 20, 10), v.candidates())


@query("rec_custom_sim", _ranked(_scored(_sim("mat_one", "dot / (si + sj - dot + 1e-6)", 5))), **VIEWS)
def rec_custom(v: Views):
    supplied = similarity.similar(mat(v), "jaccard", 50).select("src", "dst", "weight")
    return models.item_scores(profile(v), similarity.top_neighbours(supplied, 5), v.candidates())


def _walk(beta: float) -> str:
    return f"SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS r FROM (SELECT src, dst, w / n ** 0.9{' / d ** ' + str(beta) if beta else ''} AS weight FROM (SELECT a.col AS src, b.col AS dst, sum((b.value / s) ** 0.9) AS w FROM mat a JOIN mat b ON a.row = b.row AND a.col <> b.col JOIN (SELECT row, sum(value) AS s FROM mat GROUP BY 1) x ON x.row = a.row GROUP BY 1, 2) JOIN (SELECT col AS src, count(*) AS n FROM mat GROUP BY 1) USING (src) JOIN (SELECT col AS dst, count(*) AS d FROM mat GROUP BY 1) USING (dst))) WHERE r <= 20"


@query("rec_p3alpha", _ranked(_scored(_walk(0))), **VIEWS)
def rec_p3alpha(v: Views):
    return models.item_scores(profile(v), models.random_walk(mat(v), 0.9, 0.0, 20), v.candidates())


@query("rec_rp3beta", _ranked(_scored(_walk(0.6))), **VIEWS)
def rec_rp3beta(v: Views):
    return models.item_scores(profile(v), models.random_walk(mat(v), 0.9, 0.6, 20), v.candidates())


for _name, _algo in {"rec_toppop": "toppop", "rec_global_effects": "global"}.items():

    def _simple(name: str, algo: str) -> None:
        @query(name, f"SELECT user_id, item_id, round(score, 6) AS score FROM scores WHERE algo = '{algo}'")
        def run(v: Views):
            f = models.top_pop if algo == "toppop" else models.global_effects
            return f(v.train(), v.candidates())

    _simple(_name, _algo)


@query("rec_random", f"SELECT user_id, item_id, round({u(1, 'user_id', 'item_id')}, 6) AS score FROM candidates")
def rec_random(v: Views):
    return models.random_scores(v.candidates())


@query("rec_predefined", "SELECT user_id, item_id, r AS rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM scores WHERE algo = 'mean') WHERE r <= 5")
def rec_predefined(v: Views):
    return models.predefined(v.scores().where("algo = 'mean'"), 5).select("user_id", "item_id", "rank")


@query("score_candidates", "SELECT algo, user_id, item_id, round(CASE WHEN lo < hi THEN f ELSE greatest(f, 1e-8) END, 6) AS score FROM (SELECT *, coalesce(score, lo - 0.02 * abs(lo), 1e-8) AS f FROM (SELECT g.algo, c.user_id, c.item_id, s.score, min(s.score) OVER w AS lo, max(s.score) OVER w AS hi FROM candidates c CROSS JOIN (SELECT unnest(['toppop', 'mean']) AS algo) g LEFT JOIN scores s ON s.algo = g.algo AND s.user_id = c.user_id AND s.item_id = c.item_id WINDOW w AS (PARTITION BY g.algo, c.user_id)))")
def score_candidates(v: Views):
    out, cand, scores = None, v.candidates(), v.scores()
    for algo in ("toppop", "mean"):
        one = ranking.score_floor(cand, scores.where(F.col("algo") == algo)).select(F.lit(algo).alias("algo"), "user_id", "item_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query("item_pairs", 'SELECT "row", i, j FROM t_pairs JOIN (SELECT i, j FROM (SELECT *, max(n) OVER () AS m FROM (SELECT i, j, count(*) AS n FROM t_pairs GROUP BY 1, 2)) WHERE n > 0.1 * m) USING (i, j)', **VIEWS, t_pairs='SELECT a.user_id AS "row", a.item_id AS i, b.item_id AS j FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id < b.item_id')
def item_pairs(v: Views):
    m = v.train().select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.lit(1.0).alias("value"))
    return peritem.item_pairs(m)


@query("score_factors", "SELECT user_id, item_id, round(list_dot_product(u.vec, i.vec), 6) AS score FROM fp JOIN factors u ON u.id = user_id JOIN factors i ON i.id = item_id", fp="SELECT user_id, item_id FROM candidates")
def score_factors(v: Views):
    """The candidates of users and items that have a vector."""
    return factors.score(v.candidates(), v.factors(), v.factors())


@query("fold_in", "SELECT user_id, count(*) AS n, round(sum(vec[1]) / sqrt(count(*)), 6) AS v0, round(sum(vec[64]) / sqrt(count(*)), 6) AS v63 FROM fp JOIN factors ON id = item_id GROUP BY 1", fp="SELECT user_id, item_id FROM train")
def fold_in(v: Views):
    """Profiles in train, of the items that have a vector."""
    p = v.train().select("user_id", "item_id").join(v.factors().select(F.col("id").alias("item_id")), "item_id", "left_semi")
    vec = factors.fold_in(p, v.factors()).withColumnRenamed("id", "user_id")
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(vec, "user_id").select("user_id", "n", F.col("vec")[0].alias("v0"), F.col("vec")[63].alias("v63"))


@query(
    "cold_user_knn",
    "SELECT t.user_id, s.dst AS item_id, round(sum(s.weight), 6) AS score FROM train t JOIN f_sim s ON s.src = t.item_id GROUP BY 1, 2",
    f_sim="SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(weight, 9) DESC, src) AS rank FROM (SELECT b.id AS src, a.id AS dst, list_dot_product(a.vec, b.vec) AS weight FROM factors a JOIN factors b ON a.id <> b.id) WHERE weight <> 0) WHERE rank <= 10",
)
def cold_user_knn(v: Views):
    """Users without a factor, scored from the similarity of the item factors."""
    p = v.train().select("user_id", "item_id", F.lit(1.0).alias("rating"))
    return models.item_scores(p, similarity.of_factors(v.factors(), K))


@query("rec_ials")
def rec_ials(v: Views):
    users, items = factors.als(v.train(), 16, 5)
    return factors.score(v.candidates(), users, items)


@query("rec_nmf")
def rec_nmf(v: Views):
    users, items = factors.als(v.train(), 16, 5, implicit=False, nonnegative=True)
    return factors.score(v.candidates(), users, items)


@query("rec_puresvd")
def rec_puresvd(v: Views):
    users, items = factors.pure_svd(v.train(), 16)
    return factors.score(v.candidates(), users, items)


@query("rec_svd_similarity")
def rec_svd_similarity(v: Views):
    return _shown(similarity.of_factors(factors.pure_svd(v.train(), 16)[1], K))


@query("factor_features")
def factor_features(v: Views):
    users, items = factors.als(v.train(), 16, 5)
    both = factors.factor_features(v.candidates(), users, items)
    return both.select("user_id", "item_id", "u_norm", "i_norm", F.col("u_vec")[0].alias("u_0"), F.col("i_vec")[0].alias("i_0"))


@query("rec_ease")
def rec_ease(v: Views):
    """Every item's regression on all others, the hundred largest weights of each."""
    return models.item_scores(profile(v), dense.ease(mat(v), 100.0, 100), v.candidates())


@query("rec_ease_neighbours")
def rec_ease_neighbours(v: Views):
    """Regressions on the 200 items that are most often found with each: where the dense inverse is too large."""
    return models.item_scores(profile(v), peritem.ridge(mat(v), 100.0, 200), v.candidates())


@query("rec_ease_pairs")
def rec_ease_pairs(v: Views):
    """Regressions on items and frequent pairs of items."""
    m = v.train().select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.lit(1.0).alias("value"))
    extended, named = peritem.with_pairs(m, peritem.item_pairs(m, 0.6))
    return peritem.higher_order_scores(extended, peritem.higher_order(extended, named, 100.0, 100.0, 50), v.candidates())


@query("rec_slim")
def rec_slim(v: Views):
    sim = peritem.slim(mat(v), 10.0, 0.1, 30, 10)
    return models.item_scores(profile(v), sim, v.candidates())


@query("flagship_ndcg", f"SELECT market, round(avg(v), 6) AS ndcg FROM (SELECT market, user_id, max(CASE WHEN hit AND r <= 10 THEN ln(2) / ln(r + 1) ELSE 0 END) AS v FROM (SELECT t.market, t.user_id, s.item_id = t.item_id AS hit, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.score, 9) DESC, s.item_id) AS r FROM test t LEFT JOIN (SELECT s.* FROM ({_scored(_sim('mat', COSINE.format(s=100), 50))}) s JOIN candidates c ON c.user_id = s.user_id AND c.item_id = s.item_id) s USING (user_id)) GROUP BY 1, 2) GROUP BY 1", **VIEWS)
def flagship(v: Views):
    """Item neighbours on train, candidates ranked, NDCG at 10 of each market."""
    scores = models.item_scores(profile(v), similarity.similar(mat(v), "cosine", 50, 100), v.candidates())
    test = v.test()
    users = metrics.per_user(ranking.top_k(scores, 10), test.select("user_id", "item_id", "rating"), [10])
    return test.select("market", "user_id").join(users, "user_id").groupBy("market").agg(F.avg("ndcg").alias("ndcg"))
