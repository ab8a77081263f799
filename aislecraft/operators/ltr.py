"""Learning to rank on tables (qid, doc_id, score, rel): metrics of queries, lambda gradients, boosted trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.operators.ingest import prefix_sums
from aislecraft.operators.ranking import ltr_rank
from aislecraft.operators.splits import group_kfold
from aislecraft.sources.storage import discard, stored


def _gain(rel: Column, kind: str = "exp2") -> Column:
    return F.pow(F.lit(2.0), rel) - 1 if kind == "exp2" else rel


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The first k documents of each query. Spark keeps k of a query in every task before it shuffles, so that a query of any size is a few rows."""
    return ltr_rank(rows).where(F.col("rank") <= k)


def _ideal(rows: DataFrame, k: int, kind: str = "exp2") -> DataFrame:
    """qid, ideal: the DCG of the best order, from how many documents of each grade a query has; only its k highest grades count."""
    grades = rows.groupBy("qid", "rel").agg(F.count(F.lit(1)).alias("_n"))
    highest = grades.withColumn("_g", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel")))).where(F.col("_g") <= k)
    end = F.sum("_n").over(Window.partitionBy("qid").orderBy("_g"))  # at most k rows
    placed = highest.withColumn("_end", F.least(end, F.lit(k))).withColumn("_start", F.least(end - F.col("_n"), F.lit(k)))
    places = F.when(F.col("_start") < F.col("_end"), F.sequence(F.col("_start") + 1, F.col("_end"))).otherwise(F.array().cast("array<bigint>"))
    discounts = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return placed.groupBy("qid").agg(F.sum(_gain(F.col("rel"), kind) * discounts).alias("ideal"))


def dcg(rows: DataFrame, k: int = 10, kind: str = "exp2") -> DataFrame:
    return _top(rows, k).groupBy("qid").agg(F.sum(_gain(F.col("rel"), kind) * _discount(F.col("rank"))).alias("value"))


def ndcg(rows: DataFrame, k: int = 10, kind: str = "exp2") -> DataFrame:
    both = dcg(rows, k, kind).join(_ideal(rows, k, kind), "qid")
    return both.select("qid", F.when(F.col("ideal") > 0, F.col("value") / F.col("ideal")).otherwise(0.0).alias("value"))


def err(rows: DataFrame, highest: float, k: int = 10) -> DataFrame:
    """Expected reciprocal rank: the chance that each place is the one that satisfies."""
    p = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.lit(2.0**highest)
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # of k rows
    residual = F.exp(F.coalesce(F.sum(F.log(1 - p)).over(before), F.lit(0.0)))
    ranked = _top(rows, k).withColumn("_r", residual).withColumn("_p", p)
    return ranked.groupBy("qid").agg(F.sum(F.col("_r") * F.col("_p") / F.col("rank")).alias("value"))


def ap(rows: DataFrame, k: int = 10, cutoff: float = 0.5) -> DataFrame:
    rel = (F.col("rel") > cutoff).cast("int")
    cum = _top(rows, k).withColumn("_rel", rel).withColumn("_cum", F.sum("_rel").over(Window.partitionBy("qid").orderBy("rank")))  # k rows
    top = cum.groupBy("qid").agg(F.sum(F.col("_rel") * F.col("_cum") / F.col("rank")).alias("s"))
    n = rows.groupBy("qid").agg(F.sum(rel).alias("n"))
    return n.join(top, "qid").select("qid", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("value"))


#: The order of documents within and across queries.
_ORDER = [F.asc_nulls_first, F.desc, F.asc, F.asc]


def _in_order() -> list[Column]:
    return [f(c) for f, c in zip(_ORDER, ("qid", "score", "rel", "doc_id"))]


def auc(rows: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """From prefix sums over all documents in order, so that many tasks share a large query."""
    marked = rows.select("qid", "doc_id", "score", "rel", (F.col("rel") > cutoff).cast("long").alias("_rel")).withColumn("_not", 1 - F.col("_rel"))
    before = prefix_sums(marked, "_not", *_in_order())  # `start`: irrelevant documents before, those of earlier queries too
    s = before.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("_rel").alias("p"), F.sum(F.col("_rel") * F.col("start")).alias("all"), F.min("start").alias("earlier"))
    pairs, above = F.col("p") * (F.col("n") - F.col("p")), F.col("all") - F.col("p") * F.col("earlier")
    return s.select("qid", F.when(pairs > 0, 1 - above / pairs).otherwise(0.0).alias("value"))


def kendall(rows: DataFrame) -> DataFrame:
    """Pairs in order minus pairs out of order over all pairs, ties skipped.

    Documents in order are dealt to ranges. Pairs of two ranges are counted from how many of each grade they hold; pairs of one
    range by grade, so that no pair of documents is formed, and no range is larger than a task's share.
    """
    ranges = stored(rows.select("qid", "doc_id", "score", "rel").repartitionByRange(*_in_order()).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", "qid").orderBy(*_in_order()[1:])
    ranked = ranges.select("qid", "_range", "rel", F.row_number().over(inside).alias("rank"))
    grades = ranked.groupBy("qid", "_range", F.col("rel").alias("grade")).agg(F.count(F.lit(1)).alias("of_grade"))
    each = ranked.join(grades, ["qid", "_range"])
    so_far = F.sum(F.when(F.col("rel") == F.col("grade"), 1).otherwise(0)).over(Window.partitionBy("_range", "qid", "grade").orderBy("rank"))
    sign = F.when(F.col("grade") < F.col("rel"), F.col("later")).when(F.col("grade") > F.col("rel"), -F.col("later")).otherwise(0)
    within = each.withColumn("later", F.col("of_grade") - so_far).groupBy("qid").agg(F.sum(sign).alias("s"))
    after = grades.select("qid", F.col("_range").alias("_next"), F.col("grade").alias("_grade"), F.col("of_grade").alias("_n"))
    across = grades.join(after, "qid").where("_range < _next").groupBy("qid").agg(F.sum(F.signum(F.col("grade") - F.col("_grade")) * F.col("of_grade") * F.col("_n")).cast("long").alias("s"))
    sums = within.unionByName(across).groupBy("qid").agg(F.sum("s").alias("s"))
    total = sums.join(grades.groupBy("qid").agg(F.sum("of_grade").alias("n")), "qid")
    return total.select("qid", F.when(F.col("n") > 1, F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("value"))


def random_dcg(rows: DataFrame, k: int = 10) -> DataFrame:
    """Expected DCG of a random order, and NDCG."""
    discounts = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    s = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum(_gain(F.col("rel"))).alias("g")).join(_ideal(rows, k), "qid")
    expected = F.col("g") / F.col("n") * discounts
    return s.select("qid", expected.alias("dcg"), F.when(F.col("ideal") > 0, expected / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def mean_metric(values: DataFrame) -> DataFrame:
    return values.agg(F.avg("value").alias("value"))


def lambdas(rows: DataFrame, k: int = 10) -> DataFrame:
    """qid, doc_id, lambda, delta of NDCG@k: a document of the first k places against each one below it."""
    top = _top(rows, k).select("qid", "doc_id", "rank", "rel", "score")
    placed = rows.select("qid", "doc_id", "rel", "score").join(top.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(k + 1)))
    take = lambda df, p: df.withColumn("g", _gain(F.col("rel"))).withColumn("d", F.when(F.col("rank") <= k, _discount(F.col("rank"))).otherwise(0.0)).select("qid", *[F.col(c).alias(f"{p}_{c}") for c in ("doc_id", "rank", "rel", "score", "g", "d")])
    pairs = take(placed, "b").join(take(top, "a"), "qid").where("a_rank < b_rank and a_rel <> b_rel").join(_ideal(rows, k), "qid").where("ideal > 0")
    change = F.abs((F.col("b_g") - F.col("a_g")) * (F.col("a_d") - F.col("b_d")) / F.col("ideal"))
    worse = F.col("a_rel") < F.col("b_rel")
    logistic = 1 / (1 + F.exp(F.when(worse, F.col("b_score") - F.col("a_score")).otherwise(F.col("a_score") - F.col("b_score"))))
    signed = F.when(worse, -logistic * change).otherwise(logistic * change)
    rows2 = pairs.select("qid", "a_doc_id", "b_doc_id", signed.alias("l"), ((1 - logistic) * logistic * change).alias("w"))
    each = rows2.select("qid", F.explode(F.array(F.struct(F.col("a_doc_id").alias("doc_id"), F.col("l").alias("l"), "w"), F.struct(F.col("b_doc_id").alias("doc_id"), (-F.col("l")).alias("l"), "w"))).alias("x"))
    sums = each.groupBy("qid", "x.doc_id").agg(F.sum("x.l").alias("lambda"), F.sum("x.w").alias("delta"))
    return rows.select("qid", "doc_id").join(sums, ["qid", "doc_id"], "left").fillna(0.0, ["lambda", "delta"])


def labels(candidates: DataFrame, positives: DataFrame, filler: DataFrame | None = None) -> DataFrame:
    """Candidates with label 1 for positives; a filler score grades the others as int(10 * score)."""
    out = candidates.join(positives.select("user_id", "item_id", F.lit(1).alias("label")), ["user_id", "item_id"], "left")
    if filler is None:
        return out.select("user_id", "item_id", F.coalesce("label", F.lit(0)).alias("label"))
    graded = out.join(filler.select("user_id", "item_id", F.col("score").alias("_f")), ["user_id", "item_id"], "left")
    return graded.select("user_id", "item_id", F.coalesce(F.col("label") * 100, F.floor(F.col("_f") * 10), F.lit(0)).cast("long").alias("label"))


def lambda_mart(rows: DataFrame, features: list[str], rounds: int = 5, depth: int = 3, rate: float = 0.1, k: int = 10) -> DataFrame:
    """qid, doc_id, rel, score after boosting on all rows."""
    return boosted(rows.withColumn("part", F.lit("train")), features, rounds, depth, rate, k).drop("part")


#: A node of a tree: an inner one sends rows whose feature is at most `cut` to `low`, all others (nulls, too) to `high`; a leaf has a value.
TREES = "tree int, node int, feature string, cut double, low int, high int, value double"


#: What stands for nulls and NaN while trees are fitted: beyond every cut, so that they go to `high`.
MISSING = 1e300


def _nodes(root, tree: int, features: list[str], steps: dict[float, float]) -> list[tuple]:
    """The rows of TREES of a fitted tree; leaves are numbered from left to right as in its leaf column."""
    out, leaves, waiting = [], 0, [(root, 0)]
    places = 1
    while waiting:
        node, place = waiting.pop()
        if node.subtreeDepth() == 0:
            out.append((tree, place, None, None, None, None, steps.get(float(leaves), 0.0)))
            leaves += 1
        else:
            out.append((tree, place, features[node.split().featureIndex()], float(node.split().threshold()), places, places + 1, None))
            waiting += [(node.rightChild(), places + 1), (node.leftChild(), places)]
            places += 2
    return out


def tree_score(trees: DataFrame) -> Column:
    """The score of a row by a table of trees, as one expression over the features: at most rounds x 2^(depth + 1) nodes."""
    by_tree: dict[int, dict[int, tuple]] = {}
    for r in trees.select("tree", "node", "feature", "cut", "low", "high", "value").collect():
        by_tree.setdefault(r["tree"], {})[r["node"]] = r

    def at(nodes: dict[int, tuple], place: int) -> Column:
        r = nodes[place]
        if r["feature"] is None:
            return F.lit(r["value"])
        return F.when(F.col(r["feature"]).cast("double") <= r["cut"], at(nodes, r["low"])).otherwise(at(nodes, r["high"]))

    out = F.lit(0.0)
    for k in sorted(by_tree):
        out = out + at(by_tree[k], 0)
    return out


def boosted(rows: DataFrame, features: list[str], rounds: int = 5, depth: int = 3, rate: float = 0.1, k: int = 10, patience: int | None = None) -> DataFrame:
    """The scores of `fitted`."""
    return fitted(rows, features, rounds, depth, rate, k, patience)[0]


def fitted(rows: DataFrame, features: list[str], rounds: int = 5, depth: int = 3, rate: float = 0.1, k: int = 10, patience: int | None = None) -> tuple[DataFrame, DataFrame]:
    """qid, doc_id, rel, part, score, and the trees (TREES) whose sum gives these scores: trees fit the lambda gradients of the rows whose `part` is train, leaves take sum(lambda) / sum(delta), and all rows get their steps.

    With `patience` the rounds end once the mean NDCG@k of part valid hasn't grown for so many of them, and scores and trees
    are those of its best round. A query (qid) lies in one part only. Steps are rounded, so that they don't depend on the
    order in which partial sums meet.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    whole = rows.select("qid", "doc_id", "rel", "part", *(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)).alias(f"_f_{f}") for f in features))
    data = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="features").transform(whole).select("qid", "doc_id", "rel", "part", "features")
    current = stored(data.withColumn("score", F.lit(0.0)), "boost")
    best, best_value, stalled, nodes, kept = current, float("-inf"), 0, [], 0
    for tree_number in range(rounds):
        seen = current.where("part = 'train'")
        joined = stored(seen.join(lambdas(seen.select("qid", "doc_id", "score", "rel"), k), ["qid", "doc_id"]), "boost")
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="lambda", maxDepth=depth, leafCol="leaf", seed=1).fit(joined)
        step = F.round(rate * F.sum("lambda") / F.greatest(F.sum("delta"), F.lit(1e-9)), 9)
        steps = {r["leaf"]: r["step"] for r in tree.transform(joined).groupBy("leaf").agg(step.alias("step")).collect()}  # at most 2^depth
        nodes.append(_nodes(tree._call_java("rootNode"), tree_number, features, steps))
        leaf = F.create_map(*(F.lit(x) for pair in steps.items() for x in pair))
        moved = tree.transform(current).withColumn("score", F.col("score") + F.coalesce(F.try_element_at(leaf, F.col("leaf")), F.lit(0.0)))
        after = stored(moved.select("qid", "doc_id", "rel", "part", "features", "score"), "boost")
        discard(joined, *([current] if current is not best else []))
        current = after
        if patience is None:
            best, kept = current, tree_number + 1
            continue
        value = mean_metric(ndcg(current.where("part = 'valid'"), k)).first()["value"] or 0.0
        if value > best_value:
            best, best_value, stalled, kept = current, value, 0, tree_number + 1
        else:
            stalled += 1
            if stalled >= patience:
                break
    trees = rows.sparkSession.createDataFrame([row for one in nodes[:kept] for row in one], TREES)
    return best.select("qid", "doc_id", "rel", "part", "score"), trees


def cross_validated(rows: DataFrame, features: list[str], folds: int, seed: object, unseen: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame | None]:
    """The out-of-fold scores and the mean scores of `folded`."""
    return folded(rows, features, folds, seed, unseen, **settings)[:2]


def folded(rows: DataFrame, features: list[str], folds: int, seed: object, unseen: DataFrame | None = None, **settings) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Out-of-fold scores (fold, qid, doc_id, rel, score) of `rows`, the mean over the folds' models of the scores (qid, doc_id, score) of `unseen` rows, which have no rel, and the models (fold and TREES).

    Folds group queries, in near-equal numbers; each fold's model learns from the others and stops by its own NDCG.
    `settings` are those of `fitted`.
    """
    names = ["qid", "doc_id", "rel", *features]
    dealt = stored(rows.select(*names).join(group_kfold(rows, folds, seed, "qid"), "qid"), "folds")
    held, models = None, None
    for f in range(folds):
        parts = dealt.select(*names, F.when(F.col("fold") == f, "valid").otherwise("train").alias("part"))
        done, trees = fitted(parts, features, **settings)
        one = done.where("part = 'valid'").select(F.lit(f).cast("long").alias("fold"), "qid", "doc_id", "rel", "score")
        two = trees.select(F.lit(f).cast("long").alias("fold"), "*")
        held, models = (one, two) if held is None else (held.unionByName(one), models.unionByName(two))
    if unseen is None:
        return held, None, models
    scores = [tree_score(models.where(F.col("fold") == f)) for f in range(folds)]
    return held, unseen.select("qid", "doc_id", (sum(scores[1:], scores[0]) / folds).alias("score")), models


def fold_importance(rows: DataFrame, features: list[str], held: DataFrame, models: DataFrame, seed: int = 7, k: int = 10) -> DataFrame:
    """fold, feature, drop: how much the mean NDCG@k that a fold's own trained ranker reaches on the queries it has not learnt from loses when a feature is dealt anew within them."""
    out = None
    for f in [r["fold"] for r in models.select("fold").distinct().orderBy("fold").collect()]:  # a row for each fold
        own = rows.join(held.where(F.col("fold") == f).select("qid").distinct(), "qid", "left_semi")
        one = permutation_importance(own, features, tree_score(models.where(F.col("fold") == f)), seed, k).select(F.lit(f).alias("fold"), "feature", "drop")
        out = one if out is None else out.unionByName(one)
    return out


def permutation_importance(rows: DataFrame, features: list[str], score: Column, seed: int = 7, k: int = 10) -> DataFrame:
    """feature, drop: how much the mean NDCG@k of `score` (an expression over the features) loses when a feature is dealt anew within its fold (qid)."""
    from aislecraft.functions.hashing import hash_int

    base = mean_metric(ndcg(rows.withColumn("score", score), k)).select(F.col("value").alias("base"))
    out = None
    for f in features:
        here = Window.partitionBy("qid").orderBy("doc_id")
        there = Window.partitionBy("qid").orderBy(hash_int(seed, F.lit(f), F.col("qid"), F.col("doc_id")), "doc_id")
        dealt = rows.select("qid", F.row_number().over(there).alias("_n"), F.col(f).alias("_v"))
        shuffled = rows.withColumn("_n", F.row_number().over(here)).drop(f).join(dealt, ["qid", "_n"]).withColumnRenamed("_v", f)
        one = mean_metric(ndcg(shuffled.withColumn("score", score), k)).crossJoin(base).select(F.lit(f).alias("feature"), (F.col("base") - F.col("value")).alias("drop"))  # rows of one
        out = one if out is None else out.unionByName(one)
    return out
