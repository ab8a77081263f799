"""Queries of samples, splits, folds and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from aislecraft.operators import negatives as neg
from aislecraft.operators import similarity, splits, stats
from aislecraft.operators.ingest import dense_ids
from aislecraft.plans.base import query
from aislecraft.plans.evaluate import VIEWS as HELD
from aislecraft.plans.evaluate import hold
from aislecraft.plans.sql import h, h60, u
from aislecraft.sources.views import Views

UI = ("user_id", "item_id")


def _sample(key: str) -> str:
    return f"SELECT user_id, item_id, rating FROM interactions WHERE {key} IN (SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY {h(3, key)}, {key}) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM interactions)) WHERE r <= n - floor(round(n * 0.2, 9)))"


@query("user_sample", _sample("user_id"))
def user_sample(v: Views):
    return splits.sample_ids(v.interactions(), "user_id", 0.8, 3).select("user_id", "item_id", "rating")


@query("item_sample", _sample("item_id"))
def item_sample(v: Views):
    return splits.sample_ids(v.interactions(), "item_id", 0.8, 3).select("user_id", "item_id", "rating")


def _holdout(keys: tuple[str, ...]) -> str:
    x = u(4, *keys)
    return "SELECT user_id, item_id, part FROM hs JOIN (SELECT DISTINCT user_id FROM hs WHERE part = 'train') USING (user_id)", {"hs": f"SELECT * FROM (SELECT *, CASE WHEN {x} < 0.6 THEN 'train' WHEN {x} < 0.8 THEN 'valid' ELSE 'test' END AS part FROM interactions) WHERE part = 'train' OR rating > 2"}


_sql, _v = _holdout(UI)


@query("split_holdout", _sql, **_v)
def split_holdout(v: Views):
    return splits.holdout(v.interactions(), 0.6, 0.2, 4, 2.0).select("user_id", "item_id", "part")


_sql, _v = _holdout(("item_id",))


@query("split_cold_items", _sql, **_v)
def split_cold(v: Views):
    return splits.holdout(v.interactions(), 0.6, 0.2, 4, 2.0, by_item=True).select("user_id", "item_id", "part")


@query("split_leave_k_out", f"SELECT user_id, item_id, CASE WHEN good AND r <= 2 THEN 'test' WHEN good AND r <= 4 THEN 'valid' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id, good ORDER BY {h(5, *UI)}, item_id) AS r, count(*) FILTER (WHERE good) OVER (PARTITION BY user_id) AS n FROM (SELECT *, rating > 2 AS good FROM interactions)) WHERE n >= 4")
def split_lko(v: Views):
    return splits.leave_k_out(v.interactions(), 2, 5, 2.0).select("user_id", "item_id", "part")


@query("split_kfold_warm", f"SELECT user_id, item_id, {h(6, *UI)} % 5 AS fold FROM interactions")
def kfold_warm(v: Views):
    return splits.kfold(v.interactions(), 5, 6, *UI).select("user_id", "item_id", "fold")


@query("split_kfold_cold", f"SELECT user_id, item_id, {h(6, 'item_id')} % 5 AS fold FROM interactions")
def kfold_cold(v: Views):
    return splits.kfold(v.interactions(), 5, 6, "item_id").select("user_id", "item_id", "fold")


def _group(seed: int) -> str:
    return f"SELECT user_id, (row_number() OVER (ORDER BY {h(seed, 'user_id')}, user_id) - 1) % 5 AS fold FROM (SELECT DISTINCT user_id FROM interactions)"


@query("group_kfold", _group(7))
def group_kfold(v: Views):
    return splits.group_kfold(v.interactions(), 5, 7)


@query("group_kfold_double", f"SELECT *, 0::BIGINT AS round FROM ({_group(7)}) UNION ALL SELECT *, 1::BIGINT FROM ({_group(8)})")
def group_kfold_double(v: Views):
    return splits.double_group_kfold(v.interactions(), 5, (7, 8))


def _limited(users: str, seed: object, seen: str = "interactions", dim: str = "item_dim") -> str:
    """Negatives of users (user_id, lim)."""
    return f"SELECT user_id, item_id, rn FROM (SELECT user_id, item_id, lim, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rn FROM (SELECT d.user_id, i.item_id, min(k) AS k, any_value(lim) AS lim FROM (SELECT user_id, lim, k, {h(seed, 'user_id', 'k')} % (SELECT count(*) FROM {dim}) AS idx FROM (SELECT user_id, lim, unnest(range(1, lim * 3 + 51)) AS k FROM ({users}))) d JOIN {dim} i ON i.idx = d.idx GROUP BY 1, 2) c WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)) WHERE rn <= lim"


ALL_USERS = "SELECT DISTINCT user_id, {} AS lim FROM interactions"


@query("negatives_fixed", _limited(ALL_USERS.format(99), 42))
def negatives_fixed(v: Views):
    inter = v.written()
    return neg.fixed_negatives(inter.select("user_id").distinct(), inter, inter.select("item_id").distinct(), 99, 42)


@query("negatives_per_positive", _limited("SELECT user_id, count(*) * 3 AS lim FROM h_test GROUP BY 1", 11), **HELD)
def negatives_per_positive(v: Views):
    inter = v.written()
    users = hold(v).where("part = 'test'").groupBy("user_id").agg((F.count(F.lit(1)) * 3).alias("lim"))
    return neg.limited_negatives(users, inter, inter.select("item_id").distinct(), F.col("lim"), 11)


@query("negatives_balanced", _limited("SELECT user_id, greatest(1, round(((SELECT count(*) FROM item_dim) - count(*)) / count(*)))::BIGINT AS lim FROM interactions GROUP BY 1", 12))
def negatives_balanced(v: Views):
    inter = v.written()
    items = inter.select("item_id").distinct()
    users = stats.counts(inter, "user_id", "n").select("user_id", splits.balanced_limit(items.count(), F.col("n")).alias("lim"))
    return neg.limited_negatives(users, inter, items, F.col("lim"), 12)


def _drawn(users: str, total: str, seed: int) -> str:
    """All draws (at, k) of 20 negatives of each user; nobody here has seen so much that they fall short."""
    return f"SELECT *, {h60(seed, 'user_id', 'k')} % ({total}) AS spot FROM (SELECT *, unnest(range(1, 111)) AS k FROM ({users}))"


def _first(found: str) -> str:
    return f"SELECT user_id, item_id, rn FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS rn FROM (SELECT user_id, item_id, min(k) AS k FROM ({found}) GROUP BY 1, 2) c WHERE NOT EXISTS (SELECT 1 FROM interactions s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)) WHERE rn <= 20"


@query(
    "negatives_popularity",
    _first("SELECT d.user_id, c.item_id, d.k FROM pop_drawn d ASOF JOIN pop_sums c ON d.spot >= c.start"),
    pop_sums="SELECT item_id, sum(n) OVER (ORDER BY item_id) - n AS start, n FROM (SELECT item_id, count(*) AS n FROM interactions GROUP BY 1)",
    pop_drawn=_drawn("SELECT DISTINCT user_id FROM interactions", "SELECT sum(n) FROM pop_sums", 13),
)
def negatives_popularity(v: Views):
    """Drawn by popularity over all items."""
    inter = v.written()
    return neg.popularity_negatives(inter.select("user_id").distinct(), inter, stats.counts(inter, "item_id", "weight"), 20, 13)


@query(
    "negatives_competitor",
    _first("SELECT d.user_id, c.item_id, d.k FROM (SELECT * FROM comp_drawn WHERE spot < total) d ASOF JOIN comp_sums c ON d.anchor = c.anchor AND d.spot >= c.start UNION ALL SELECT user_id, item_id, k FROM comp_drawn JOIN item_dim ON idx = spot - total WHERE spot >= total"),
    comp="SELECT a.item_id AS anchor, b.item_id, count(*) AS n FROM train a JOIN train b ON a.user_id = b.user_id AND a.item_id <> b.item_id WHERE a.item_id IN (SELECT item_id FROM test) GROUP BY 1, 2",
    comp_sums="SELECT anchor, item_id, sum(n) OVER (PARTITION BY anchor ORDER BY item_id) - n AS start FROM comp",
    comp_drawn=_drawn("SELECT user_id, t.item_id AS anchor, coalesce(total, 0) AS total FROM test t LEFT JOIN (SELECT anchor, sum(n) AS total FROM comp GROUP BY 1) c ON c.anchor = t.item_id", "total + (SELECT count(*) FROM item_dim)", 14),
)
def negatives_competitor(v: Views):
    """Drawn over all items by how often an item is found with the user's test item."""
    inter, test = v.written(), v.test()
    anchors = test.select("user_id", F.col("item_id").alias("anchor"))
    matrix = v.train().select(F.col("user_id").alias("row"), F.col("item_id").alias("col"))
    companions = similarity.companions(matrix, anchors.select(F.col("anchor").alias("col"))).select(F.col("i").alias("anchor"), F.col("j").alias("item_id"), "n")
    return neg.competitor_negatives(anchors, inter, companions, inter.select("item_id").distinct(), 20, 14)


@query("negatives_recommender", "SELECT user_id, item_id, min(rank) AS rank FROM (SELECT s.algo, s.user_id, s.item_id, row_number() OVER (PARTITION BY s.algo, s.user_id ORDER BY round(score, 9) DESC, s.item_id) AS rank FROM scores s WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.user_id = s.user_id AND i.item_id = s.item_id)) WHERE rank <= CASE algo WHEN 'toppop' THEN 6 WHEN 'global' THEN 4 ELSE 2 END GROUP BY 1, 2")
def negatives_recommender(v: Views):
    return neg.from_recommenders(v.scores(), v.written(), {"toppop": 6, "global": 4, "mean": 2})


@query("bpr_triples", f"SELECT user_id, pos, item_id AS neg FROM (SELECT user_id, item_id AS pos, {h(15, *UI)} % (SELECT count(*) FROM item_dim) AS idx FROM sparse) JOIN item_dim USING (idx) WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM interactions)")
def bpr_triples(v: Views):
    inter = v.written()
    return neg.bpr_triples(v.sparse(), inter, dense_ids(inter, "item_id"), 15)


@query("zero_pairs", f"SELECT DISTINCT i, j FROM (SELECT d.i, x.item_id AS j FROM (SELECT item_id AS i, {h(16, 'item_id', 'k')} % (SELECT count(*) FROM item_dim) AS idx FROM item_dim, unnest(range(1, 21)) AS r(k)) d JOIN item_dim x ON x.idx = d.idx) WHERE i <> j AND (i, j) NOT IN (SELECT (a.item_id, b.item_id) FROM interactions a JOIN interactions b ON a.user_id = b.user_id)")
def zero_pairs(v: Views):
    matrix = v.written().select(F.col("user_id").alias("row"), F.col("item_id").alias("col"))
    return neg.zero_pairs(matrix, dense_ids(v.interactions(), "item_id"), 20, 16)


@query("negatives_multi", " UNION ALL ".join(f"SELECT {s}::BIGINT AS negset, user_id, item_id, rn FROM ({_limited(ALL_USERS.format(20), s)})" for s in (21, 22, 23)))
def negatives_multi(v: Views):
    inter = v.written()
    return neg.several_sets(inter.select("user_id").distinct(), inter, inter.select("item_id").distinct(), 20, [21, 22, 23])
