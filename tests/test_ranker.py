"""Learning to rank: large queries over many ranges, trees as a table, importance of a trained ranker, and diversity of lists."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecraft.operators import ltr, metrics


def one_large_query(spark, n=400, seed=3, grades=4):
    rng = np.random.default_rng(seed)
    rows = [("big" if k % 10 else "small", k, float(rng.integers(0, 40)), float(rng.integers(0, grades))) for k in range(n)] + [("one", 1, 2.0, 1.0)]
    return rows, spark.createDataFrame(rows, "qid string, doc_id long, score double, rel double")


def in_order(rows, qid):
    return [r[3] for r in sorted((r for r in rows if r[0] == qid), key=lambda r: (-r[2], r[3], r[1]))]


def test_large_queries_equal_all_pairs(spark):
    """A query that lies in several ranges has the same AUC and Kendall's tau as by all its pairs."""
    rows, df = one_large_query(spark)
    auc, tau = ({r["qid"]: r["value"] for r in f(df).collect()} for f in (ltr.auc, ltr.kendall))
    for qid in ("big", "small", "one"):
        rel = in_order(rows, qid)
        pairs = list(itertools.combinations(rel, 2))
        want = sum(np.sign(a - b) for a, b in pairs) / len(pairs) if pairs else 0
        assert tau[qid] == pytest.approx(want)
        marks = [r > 0.5 for r in rel]
        good, bad = sum(marks), len(marks) - sum(marks)
        above = sum(1 for a, b in itertools.combinations(marks, 2) if a and not b)
        assert auc[qid] == pytest.approx(above / (good * bad) if good * bad else 0)


@pytest.mark.parametrize("grades", [2, 4, 300])
def test_ideal_order_from_grades(spark, grades):
    """NDCG, ERR and AP of the first k equal those of whole sorted lists, with few grades and with many."""
    rows, df = one_large_query(spark, 300, 5, grades)
    gain = lambda x: 2 ** (x / grades) - 1
    df = df.withColumn("rel", F.col("rel") / grades)
    got = {r["qid"]: r["value"] for r in ltr.ndcg(df, 7).collect()}
    ap = {r["qid"]: r["value"] for r in ltr.ap(df, 7).collect()}
    for qid in ("big", "small", "one"):
        rel = in_order(rows, qid)
        dcg = lambda x: sum(gain(r) / np.log2(k + 2) for k, r in enumerate(x[:7]))
        assert got[qid] == pytest.approx(dcg(rel) / dcg(sorted(rel, reverse=True)))
        marks = [r / grades > 0.5 for r in rel]
        top = sum(sum(marks[: k + 1]) / (k + 1) for k in range(min(7, len(marks))) if marks[k])
        assert ap[qid] == pytest.approx(top / sum(marks) if any(marks) else 0)


def ranking_rows(spark, n_queries=24, per_query=12, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(q, d, float(x > 0.7), float(x + rng.normal(0, 0.1)), float(rng.random())) for q in range(n_queries) for d, x in enumerate(rng.random(per_query))]
    return spark.createDataFrame(rows, "qid long, doc_id long, rel double, good double, noise double")


def test_trees_give_the_scores_of_the_fit(spark):
    """Every part's scores, nulls and numbers that are none included, come from the table of trees alone, written and read again."""
    from aislecraft.sources.storage import stored

    rows = ranking_rows(spark).withColumn("good", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") == 4, float("nan")).otherwise(F.col("good")))
    rows = rows.withColumn("part", F.when(F.col("qid") < 16, "train").when(F.col("qid") < 20, "valid").otherwise("unseen"))
    done, trees = ltr.fitted(rows, ["good", "noise"], rounds=4, patience=2)
    trees = stored(trees, "trees")
    assert trees.select("tree").distinct().count() >= 1 and trees.where("feature is null and value is null").count() == 0
    told = {(r["qid"], r["doc_id"]): r["s"] for r in rows.select("qid", "doc_id", ltr.tree_score(trees).alias("s")).collect()}
    fit = {(r["qid"], r["doc_id"]): r["score"] for r in done.collect()}
    assert told.keys() == fit.keys() and all(told[k] == pytest.approx(fit[k], abs=1e-12) for k in fit) and len(set(fit.values())) > 3
    plan = rows.select(ltr.tree_score(trees))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_importance_of_the_trained_ranker(spark):
    rows = ranking_rows(spark)
    held, told, models = ltr.folded(rows, ["good", "noise"], 2, 1, ranking_rows(spark, 4, 12, 11), rounds=2)
    assert models.select("fold").distinct().count() == 2 and told.count() == 48
    for f in (0, 1):
        own = rows.join(held.where(F.col("fold") == f).select("qid", "doc_id", "score"), ["qid", "doc_id"])
        assert own.where(F.abs(F.col("score") - ltr.tree_score(models.where(F.col("fold") == f))) > 1e-12).count() == 0
    drops = {(r["fold"], r["feature"]): r["drop"] for r in ltr.fold_importance(rows, ["good", "noise"], held, models).collect()}
    assert len(drops) == 4 and all(drops[f, "good"] > 0.1 > abs(drops[f, "noise"]) for f in (0, 1))


def test_diversity_of_lists_equals_that_by_all_pairs(spark):
    rng = np.random.default_rng(2)
    sets = {i: sorted({f"f{v}" for v in rng.integers(0, 8, 4)}) for i in range(12)}
    lists = [(u, int(i), k + 1) for u in range(9) for k, i in enumerate(rng.permutation(14)[: 3 + u % 3])]
    df = spark.createDataFrame(lists, "user_id long, item_id long, rank int")
    features = spark.createDataFrame(list(sets.items()), "item_id long, features array<string>")
    weights = [(a, b, len(set(sets[a]) & set(sets[b])) / 5) for a in sets for b in sets if a != b]
    every = metrics.intra_list(df, spark.createDataFrame(weights, "src long, dst long, weight double")).first()["value"]
    assert metrics.intra_list_of(df, features, 5).first()["value"] == pytest.approx(every)
