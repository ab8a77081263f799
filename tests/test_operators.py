import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecraft.operators import ensemble, ingest, ltr, metrics, negatives, peritem, ranking, significance, splits, stats
from aislecraft.sources import files
from aislecraft.sources.storage import fresh_path

#: Relevances in ranked order and the expected value, by metric.
GOLDEN = {
    "ap": [([0], 0), ([1], 1), ([1, 0], 1), ([0, 1], 0.5), ([1, 0, 1, 0], 5 / 6), ([0, 1, 1, 1], 23 / 36), ([1, 0, 1, 0, 1], 5 / 9), ([1, 0, 1, 0, 0], 5 / 6)],
    "dcg": [([0], 0), ([1], 1), ([2], 3), ([2, 1, 0], 3.6309297535714578), ([0, 0, 0], 0), ([2, 5, 1], 23.058822360715183), ([2, 5, 1, 9], 23.058822360715183)],
    "ndcg": [([0], 0), ([1], 1), ([2], 1), ([2, 1, 0], 1), ([1, 2, 0], 0.7967075809905066), ([0, 0, 0], 0), ([2, 5, 1], 0.6905329824556825), ([2, 5, 1, 9], 0.04333885914794999), ([3, 2, 1, 1], 1)],
    "err": [([0], 0), ([1], 0.0625), ([2], 0.1875), ([3], 0.4375), ([4], 0.9375), ([0, 0, 0], 0), ([4, 2, 0], 0.943359375), ([1, 2.5, 4], 0.40663047881522385), ([2, 4, 1], 0.5694173177083334), ([2, 4, 1, 2], 0.5694173177083334)],
    "kendall": [([0], 0), ([1], 0), ([2], 0), ([0, 0, 0], 0), ([4, 2, 0], 1), ([1, 2.5, 4], -1), ([4, 4, 2], 2 / 3), ([2, 4, 1, 2], 1 / 6)],
}


def queries(spark, lists):
    rows = [(str(q), k, float(-k), float(r)) for q, rel in enumerate(lists) for k, r in enumerate(rel)]
    return spark.createDataFrame(rows, "qid string, doc_id long, score double, rel double")


@pytest.mark.parametrize("metric", GOLDEN)
def test_golden(spark, metric):
    rows = queries(spark, [x for x, _ in GOLDEN[metric]])
    f = {"ap": lambda r: ltr.ap(r, 4), "dcg": lambda r: ltr.dcg(r, 3), "ndcg": lambda r: ltr.ndcg(r, 3), "err": lambda r: ltr.err(r, 4, 3), "kendall": ltr.kendall}[metric]
    got = {int(r["qid"]): r["value"] for r in f(rows).collect()}
    for q, (_, want) in enumerate(GOLDEN[metric]):
        assert got[q] == pytest.approx(want, abs=1e-9), (metric, GOLDEN[metric][q])


def test_auc_of_every_short_list(spark):
    lists = [list(x) for n in range(1, 6) for x in itertools.product((0, 1), repeat=n)]
    got = {int(r["qid"]): r["value"] for r in ltr.auc(queries(spark, lists)).collect()}
    for q, rel in enumerate(lists):
        pos, neg = [k for k, r in enumerate(rel) if r], [k for k, r in enumerate(rel) if not r]
        want = sum(p < n for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0
        assert got[q] == pytest.approx(want)


def test_full_neighbourhood_ridge_is_ease(spark):
    x = (np.random.default_rng(1).random((30, 8)) < 0.4) * 1.0
    rows = [(int(u), int(i), 1.0) for u, i in zip(*np.nonzero(x))]
    got = peritem.ridge(spark.createDataFrame(rows, "row long, col long, value double"), 5.0, 100)
    p = np.linalg.inv(x.T @ x + 5 * np.eye(8))
    want = -p / np.diag(p)
    np.fill_diagonal(want, 0)
    b = np.zeros((8, 8))
    for r in got.collect():
        b[r["src"], r["dst"]] = r["weight"]
    # pairs that never occur together have no Gram entry but may have a weight: both sides must agree
    assert np.allclose(b, want, atol=1e-8)


def test_slim_is_not_negative(spark):
    x = (np.random.default_rng(2).random((40, 6)) < 0.5) * 1.0
    rows = [(int(u), int(i), 1.0) for u, i in zip(*np.nonzero(x))]
    out = peritem.slim(spark.createDataFrame(rows, "row long, col long, value double"), 1.0, 0.1).collect()
    assert out and all(r["weight"] > 0 and r["src"] != r["dst"] for r in out)


def inter(spark, n_users=20, n_items=30, share=0.3, seed=3):
    x = np.random.default_rng(seed).random((n_users, n_items))
    rows = [("m", int(u), int(i), float(1 + int(x[u, i] * 1000) % 5)) for u, i in zip(*np.nonzero(x < share))]
    return spark.createDataFrame(rows, "market string, user_id long, item_id long, rating double")


def test_splits_cover_and_are_disjoint(spark):
    rows = inter(spark)
    parts = splits.leave_k_out(rows, 1, 5).cache()
    assert parts.count() == parts.select("user_id", "item_id").distinct().count()
    for r in parts.groupBy("user_id").agg(F.count(F.when(F.col("part") == "test", 1)).alias("t"), F.count(F.when(F.col("part") == "valid", 1)).alias("v")).collect():
        assert (r["t"], r["v"]) == (1, 1)
    folds = splits.group_kfold(rows, 5, 1).groupBy("fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_kcore_is_stable(spark):
    core = ingest.kcore(inter(spark, share=0.15), 4, 3).cache()
    for key, other, k in (("user_id", "item_id", 4), ("item_id", "user_id", 3)):
        least = core.groupBy(key).agg(F.count_distinct(other).alias("n")).agg(F.min("n")).first()[0]
        assert least is None or least >= k


def test_combined_core(spark):
    rows = inter(spark, share=0.4)
    features = rows.select("item_id").distinct().select("item_id", F.explode(F.array(F.concat(F.lit("a"), F.col("item_id") % 4), F.concat(F.lit("b"), F.col("item_id") % 5))).alias("feature"))
    core, kept = ingest.combined_kcore(rows, features, 3, 3, 1, 2, 0.5)
    assert core.join(kept.select("item_id").distinct(), "item_id", "left_anti").count() == 0


def test_combined_core_equals_sql_where_rounds_end_early(spark, tmp_path):
    """On tables that are not stable after the rounds of the SQL the query stops where the SQL does."""
    import duckdb

    from aislecraft.plans import registry

    con, source = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("customer", "nation", "region", "orders", "part"):
        os.symlink(f"{source}/{t}.parquet", tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{source}/{t}.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (1 + (l_partkey * 7 + l_orderkey * 6) % 2000 AS l_partkey) FROM '{source}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = registry.queries()["combined_kcore"](spark, str(tmp_path)).select("kind", "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT kind, a, b FROM ({registry.oracle_sql()['combined_kcore']})").fetchall())


def test_negatives_are_unseen_and_exact(spark):
    rows = inter(spark, 10, 400, 0.1)
    out = negatives.fixed_negatives(rows.select("user_id").distinct(), rows, rows.select("item_id").distinct(), 20, 1).cache()
    assert {r["count"] for r in out.groupBy("user_id").count().collect()} == {20}
    assert out.join(rows, ["user_id", "item_id"]).count() == 0
    assert out.select("user_id", "item_id").distinct().count() == out.count()


def test_minmax_and_top_k(spark):
    scores = spark.createDataFrame([(1, k, float(k % 7)) for k in range(30)] + [(2, k, 3.0) for k in range(4)], "user_id long, item_id long, score double")
    norm = ranking.row_minmax(scores)
    low, high = norm.agg(F.min("score"), F.max("score")).first()
    assert low == pytest.approx(1e-8) and high == pytest.approx(1 + 1e-8)
    ranks = ranking.top_k(scores, 5).groupBy("user_id").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert {tuple(r["r"]) for r in ranks} == {(1, 2, 3, 4, 5), (1, 2, 3, 4)}


def test_metrics_of_an_empty_list(spark):
    test = spark.createDataFrame([(1, 5, 1.0), (2, 6, 1.0)], "user_id long, item_id long, rating double")
    lists = spark.createDataFrame([(1, 5, 1)], "user_id long, item_id long, rank int")
    got = {r["user_id"]: r for r in metrics.per_user(lists, test, [5]).collect()}
    assert got[1]["ndcg"] == 1 and got[1]["auc"] is None and got[2]["ndcg"] == 0 and got[2]["precision"] == 0


def test_correction_of_nearly_the_whole_catalogue(spark):
    weights = metrics.sampled_correction(spark, 50, 50, 10, "recall", None)
    assert np.allclose(weights[:9], 1, atol=1e-2) and not any(weights[10:])


def test_files(spark):
    scores = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.25)], "user_id long, item_id long, score double")
    path = fresh_path(spark, "t")
    files.write_scores(scores, path, "s1")
    back = files.read_scores(spark, path).collect()
    assert sorted((r["user_id"], r["item_id"], r["score"]) for r in back) == [("s11", "2", 0.5), ("s13", "4", 0.25)]
    assert files.unknown_ids(files.read_scores(spark, path), spark.createDataFrame([("s11",)], "user_id string"), "user_id").count() == 1
    rows = inter(spark)
    root = fresh_path(spark, "cache")
    rows.write.parquet(f"{root}/implicit/core")
    df, left = files.longest_cached(spark, root, ["implicit", "core", "sample"])
    assert left == ["sample"] and ingest.same_rows(df, rows)
    files.write_matrix(rows, fresh_path(spark, "m"))


def test_json_drops_bad_lines(spark):
    path = fresh_path(spark, "j")
    spark.createDataFrame([('{"reviewerID": "a", "asin": "b", "overall": 4.0}',), ("{broken",), ('{"asin": "x"}',)], "value string").write.text(path)
    assert [tuple(r) for r in files.read_json_interactions(spark, path, "reviewerID", "asin", "overall").collect()] == [("a", "b", 4.0)]


def test_useless_columns(spark):
    df = spark.createDataFrame([(1.0, float(k), 2.0 * k + 1, float((k * 37) % 11)) for k in range(50)], "c double, x double, y double, z double")
    assert stats.useless_columns(df, ["c", "x", "y", "z"]) == ["c", "x"]


def test_fill_and_early_stop(spark):
    base = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9), (2, 1, 0.5)], "user_id long, item_id long, score double")
    pred = spark.createDataFrame([(1, 1, 0.3)], "user_id long, item_id long, score double")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in ensemble.fill(pred, base).collect()}
    assert got[1, 1] > 2 and got[1, 2] < 2
    assert {r["user_id"] for r in ensemble.fill(pred, base, True).collect()} == {1, 2}
    epochs = spark.createDataFrame([("m", k, v) for k, v in enumerate([1.0, 2.0, 2.001, 1.9, 2.0, 9.0])], "model string, epoch long, value double")
    assert ensemble.early_stop(epochs).first()[1:] == (1, 4)


def test_swap_deltas_match_lambdas_sign(spark):
    out = {r["doc_id"]: r["lambda"] for r in ltr.lambdas(queries(spark, [[0, 1, 2]])).collect()}
    assert out[2] > 0 > out[0]


def test_places_and_folds(spark):
    from aislecraft.operators import ingest, splits

    rows = spark.createDataFrame([(k * 7 % 101,) for k in range(101)] + [(None,), (3,)], "user_id long")
    got = sorted(map(tuple, ingest.dense_ids(rows, "user_id").collect()), key=lambda r: r[1])
    assert got == [(None, 0), *((k, k + 1) for k in range(101))]
    folds = [r["fold"] for r in splits.group_kfold(rows, 5, 3).collect()]
    assert len(folds) == 102 and max(map(folds.count, range(5))) - min(map(folds.count, range(5))) <= 1
    assert ingest.dense_ids(rows.limit(0), "user_id").count() == 0


def test_negatives_are_whole_for_users_who_have_seen_nearly_all(spark):
    from aislecraft.operators import negatives

    items = spark.createDataFrame([(k,) for k in range(400)], "item_id long")
    seen = spark.createDataFrame([(1, k) for k in range(390)] + [(2, 5)], "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    got = negatives.fixed_negatives(users, seen, items, 20, 42).collect()
    of = {u: sorted(r["item_id"] for r in got if r["user_id"] == u) for u in (1, 2, 3)}
    assert of[1] == list(range(390, 400)) and len(set(of[2])) == len(set(of[3])) == 20 and 5 not in of[2]
    assert sorted(r["rn"] for r in got if r["user_id"] == 1) == list(range(1, 11))


def test_tversky_has_two_directions(spark):
    from aislecraft.operators import similarity

    rows = spark.createDataFrame([(r, c, 1.0) for c, rs in ((1, range(4)), (2, range(2)), (3, (9,))) for r in rs], "row long, col long, value double")
    w = {(r["dst"], r["src"]): r["weight"] for r in similarity.similar(rows, "tversky", 5, alpha=0.7, beta=0.4).collect()}
    assert w[1, 2] == pytest.approx(2 / (2 + 2 * 0.7 + 0 + 1e-6)) and w[2, 1] == pytest.approx(2 / (2 + 0 + 2 * 0.4 + 1e-6)) and len(w) == 2


def test_p_values():
    """Table values: t quantiles of 5 % by degrees of freedom, and the exact signed-rank distribution."""
    for df, t in ((1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423), (1000, 1.9623), (1_000_000, 1.95997)):
        assert significance.t_p(t, df) == pytest.approx(0.05, abs=2e-5) and significance.t_p(-t, df) == significance.t_p(t, df)
    assert significance.t_p(0.0, 7) == pytest.approx(1)
    assert significance.wilcoxon_p(5, 15, 0, 2.0, False) == pytest.approx(2 / 32)
    assert significance.wilcoxon_p(8, 33, 3, 2.1, False) == pytest.approx(2 * 5 / 256)
    assert significance.wilcoxon_p(8, 33, 3, 1.959964, True) == pytest.approx(0.05, abs=1e-6)


def brute_signed_ranks(d):
    n, ranks = len(d), {x: k + 1 for k, x in enumerate(sorted(map(abs, d)))}
    w = sum(ranks[abs(x)] for x in d if x > 0)
    sums = [sum(k + 1 for k in range(n) if signs >> k & 1) for signs in range(2**n)]
    low = min(w, n * (n + 1) // 2 - w)
    return min(1.0, 2 * sum(x <= low for x in sums) / 2**n)


def test_the_gate_chooses_the_test(spark):
    rng = np.random.default_rng(5)
    normal = rng.normal(0, 1, 200)
    rows = [("base", k, float(x)) for k, x in enumerate(normal)] + [("shifted", k, float(x + 0.4 + rng.normal(0, 0.5))) for k, x in enumerate(normal)] + [("skewed", k, float(x)) for k, x in enumerate(rng.exponential(1, 200) ** 2)]
    rows += [("few", k, float(normal[k] + d)) for k, d in enumerate([0.1, -0.2, 0.35, 0.5, 0.7, 0.9, 1.3])] + [("few", 9, float("nan")), ("few", 10, None)] + [("same", k, float(x)) for k, x in enumerate(normal)]
    got = {r["other"]: r for r in significance.compare(spark.createDataFrame(rows, "algo string, user_id long, value double"), "base", ["shifted", "skewed", "few", "same", "none of these"]).collect()}
    d = np.array([r[2] for r in rows if r[0] == "base"]) - np.array([r[2] for r in rows if r[0] == "shifted"])
    assert got["shifted"]["test"] == "paired t" and got["shifted"]["statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(200)))
    assert got["shifted"]["significant"] and got["shifted"]["superior"] == "shifted" and got["shifted"]["threshold"] == pytest.approx(0.01)
    assert got["skewed"]["test"] == "wilcoxon" and got["few"]["n"] == 7
    assert got["same"]["test"] == got["none of these"]["test"] == "none" and got["same"]["p"] == 1 and got["none of these"]["n"] == 0
    few = significance.wilcoxon(spark.createDataFrame([(0.0, x) for x in (0.1, -0.2, 0.35, 0.5, 0.7, 0.9, 1.3)], "a double, b double")).first()
    assert significance.wilcoxon_p(few["n"], few["w_plus"], few["w_minus"], few["z"], False) == pytest.approx(brute_signed_ranks([-0.1, 0.2, -0.35, -0.5, -0.7, -0.9, -1.3]))


def test_equal_values_are_not_normal(spark):
    assert not significance.is_normal(spark.createDataFrame([(1.0,)] * 9, "value double"), "value")
    assert not significance.is_normal(spark.createDataFrame([], "value double"), "value")


def ranking_rows(spark, n_queries=30, per_query=12, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(q, d, float(x > 0.7), float(x + rng.normal(0, 0.1)), float(rng.random())) for q in range(n_queries) for d, x in enumerate(rng.random(per_query))]
    return spark.createDataFrame(rows, "qid long, doc_id long, rel double, good double, noise double")


def test_folds_of_the_ranker(spark):
    rows = ranking_rows(spark)
    unseen = ranking_rows(spark, 6, 12, 10).withColumn("qid", F.col("qid") + 1000)
    held, told = ltr.cross_validated(rows, ["good", "noise"], 3, 1, unseen, rounds=3, patience=1)
    got = held.collect()
    assert sorted((r["qid"], r["doc_id"]) for r in got) == sorted((r["qid"], r["doc_id"]) for r in rows.collect())
    assert len({(r["qid"], r["fold"]) for r in got}) == 30 and {r["fold"] for r in got} == {0, 1, 2}
    value = ltr.mean_metric(ltr.ndcg(held)).first()["value"]
    chance = ltr.mean_metric(ltr.ndcg(rows.withColumn("score", F.lit(0.0)))).first()["value"]
    assert value > 0.8 > chance
    named = unseen.select("qid", "doc_id", "rel").join(told, ["qid", "doc_id"])
    assert told.count() == 72 and ltr.mean_metric(ltr.ndcg(named)).first()["value"] > 0.8


def test_early_stopping_keeps_the_best_round(spark, monkeypatch):
    """Of rounds whose NDCG is scripted, the scores are those of the best one, and no round follows `patience` worse ones."""
    script, calls = iter([0.5, 0.7, 0.6, 0.6, 0.9]), []
    values = lambda df: spark.createDataFrame([(calls.append(1) or next(script),)], "value double")
    monkeypatch.setattr(ltr, "mean_metric", values)
    rows = ranking_rows(spark, 8).withColumn("part", F.when(F.col("qid") < 6, "train").otherwise("valid"))
    stopped = ltr.boosted(rows, ["good", "noise"], rounds=5, patience=2)
    assert len(calls) == 4
    two = ltr.boosted(rows, ["good", "noise"], rounds=2)
    assert sorted(map(tuple, stopped.collect())) == sorted(map(tuple, two.collect()))


def test_a_kept_frame_is_made_once(spark):
    path = fresh_path(spark, "frame")
    first = files.kept_frame(spark, path, lambda: spark.range(5))
    assert sorted(r["id"] for r in first.collect()) == [0, 1, 2, 3, 4]
    assert files.kept_frame(spark, path, lambda: spark.range(9)).count() == 5
