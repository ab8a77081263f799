"""Negatives, dense and factor models, pruned products and pair regressors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecraft.operators import dense, factors, ingest, models, negatives, peritem, similarity
from aislecraft.plans.recommend import mat
from aislecraft.sources.storage import ship
from aislecraft.sources.views import Views

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def cells(spark, x):
    rows = [(int(r), int(c), float(x[r, c])) for r, c in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "row long, col long, value double")


def binary(seed, n, m, share):
    return (np.random.default_rng(seed).random((n, m)) < share) * 1.0


def chi_square(counts, chances):
    """(chi-square, degrees of freedom) of counts against chances."""
    expected = chances / chances.sum() * counts.sum()
    return float(((counts - expected) ** 2 / expected).sum()), len(counts) - 1


def test_draws_follow_the_weights(spark):
    """A hundred thousand draws over weights from 1 to 4,000 are distributed as the weights."""
    weights = [1 + (k * 7919) % 50 for k in range(60)] + [4000, 900, 0]
    located = negatives.by_popularity(spark.createDataFrame(list(enumerate(weights)), "item_id long, weight long"), 5)
    draws = spark.range(100_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("k"))
    found = {r["item_id"]: r["count"] for r in located(draws).groupBy("item_id").count().collect()}
    assert sum(found.values()) == 100_000 and 62 not in found
    chi, free = chi_square(np.array([found.get(k, 0) for k in range(62)]), np.array(weights[:62], float))
    assert chi < free + 4 * (2 * free) ** 0.5


def test_draws_follow_the_companions(spark):
    """An anchor's companions have weight 1 + n, all other items 1; an anchor without companions draws evenly."""
    companions = spark.createDataFrame([(7, 3, 40), (7, 5, 9), (8, 1, 2)], "anchor long, item_id long, n long")
    located, size = negatives.by_companions(companions, spark.createDataFrame([(k,) for k in range(20)], "item_id long"), 6)
    assert size == 20
    draws = spark.range(90_000).select(F.col("id").alias("user_id"), (F.col("id") % 3 + 7).alias("anchor"), F.lit(1).cast("long").alias("k"))
    found = {(r["anchor"], r["item_id"]): r["count"] for r in located(draws).join(draws.select("user_id", "anchor"), "user_id").groupBy("anchor", "item_id").count().collect()}
    for anchor, more in ((7, {3: 40, 5: 9}), (8, {1: 2}), (9, {})):
        chi, free = chi_square(np.array([found.get((anchor, k), 0) for k in range(20)]), np.array([1.0 + more.get(k, 0) for k in range(20)]))
        assert chi < free + 4 * (2 * free) ** 0.5


def test_weighted_negatives_are_whole(spark):
    """Users who have seen nearly all weight still get as many as there are, none of them seen and none twice."""
    weights = spark.createDataFrame([(k, 100_000 if k < 3 else 1) for k in range(30)] + [(99, 0)], "item_id long, weight long")
    seen = spark.createDataFrame([(1, k) for k in (0, 1, 2)] + [(2, k) for k in range(25)], "user_id long, item_id long")
    got = negatives.popularity_negatives(spark.createDataFrame([(1,), (2,), (3,)], "user_id long"), seen, weights, 10, 4).collect()
    of = {u: [r["item_id"] for r in sorted(got, key=lambda r: r["rn"]) if r["user_id"] == u] for u in (1, 2, 3)}
    assert len(set(of[1])) == 10 and not set(of[1]) & {0, 1, 2} and sorted(of[2]) == [25, 26, 27, 28, 29]
    assert len(set(of[3])) == 10 and set(of[3][:3]) == {0, 1, 2} and 99 not in of[3]
    anchors = spark.createDataFrame([(1, 3), (2, 3)], "user_id long, anchor long")
    companions = spark.createDataFrame([(3, 0, 10**6)], "anchor long, item_id long, n long")
    got = negatives.competitor_negatives(anchors, seen, companions, weights, 10, 4).collect()
    assert {u: len({r["item_id"] for r in got if r["user_id"] == u}) for u in (1, 2)} == {1: 10, 2: 6}


def test_zero_pairs_have_no_common_row(spark):
    x = binary(8, 12, 20, 0.25)
    m = cells(spark, x)
    dim = ingest.dense_ids(m.select(F.col("col").alias("item_id")), "item_id")
    got = negatives.zero_pairs(m, dim, 15, 3).collect()
    assert got and all(x[:, r["i"]] @ x[:, r["j"]] == 0 and r["i"] != r["j"] for r in got)


def test_prefix_sums(spark):
    rows = [(k, (k * 31) % 7) for k in range(200)]
    got = sorted(map(tuple, ingest.prefix_sums(spark.createDataFrame(rows, "id long, w long"), "w", F.col("id").asc()).collect()))
    ends = np.cumsum([w for _, w in rows])
    assert [(i, s, e) for i, _, s, e in got] == [(i, int(ends[i]) - w, int(ends[i])) for i, w in rows]


def test_long_rows_are_joined_in_blocks(spark, monkeypatch):
    x = binary(3, 25, 40, 0.4) * np.random.default_rng(3).integers(1, 5, (25, 40))
    m = cells(spark, x)
    want = {(i, j): (float(x[:, i] @ x[:, j]), int(((x[:, i] > 0) & (x[:, j] > 0)).sum())) for i in range(40) for j in range(40) if i != j and ((x[:, i] > 0) & (x[:, j] > 0)).any()}
    take = lambda: {(r["i"], r["j"]): (r["dot"], r["n"]) for r in similarity.cooccurrence(m).collect()}
    assert take() == want
    walk = lambda: {(r["src"], r["dst"]): r["weight"] for r in models.random_walk(m, 0.8, 0.5, 10).collect()}
    before = walk()
    monkeypatch.setattr(similarity, "BLOCK", 3)
    assert take() == want
    after = walk()
    assert after.keys() == before.keys() and all(after[k] == pytest.approx(before[k]) for k in before)
    p = (x / x.sum(axis=1, keepdims=True)) ** 0.8
    n = (x > 0).sum(axis=0)
    i, j = max(before, key=before.get)
    assert before[i, j] == pytest.approx((p[:, j] * (x[:, i] > 0)).sum() / n[i] ** 0.8 / n[j] ** 0.5)
    few = similarity.companions(m, spark.createDataFrame([(3,), (99,)], "col long")).collect()
    assert {(r["i"], r["j"]): r["n"] for r in few} == {k: v[1] for k, v in want.items() if k[0] == 3}


def test_candidates_before_the_sums(spark):
    profiles = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 1.0)], "user_id long, item_id long, rating double")
    weights = spark.createDataFrame([(1, 5, 0.5), (2, 5, 1.0), (1, 6, 0.25)], "src long, dst long, weight double")
    few = spark.createDataFrame([(1, 5), (2, 9)], "user_id long, item_id long")
    assert [tuple(r) for r in models.item_scores(profiles, weights, few).collect()] == [(1, 5, 4.0)]
    assert models.item_scores(profiles, weights).count() == 4


@pytest.mark.parametrize("sizes", [(4_000_000, 250_000, 1_000_000), (9, 1, 3)])
def test_scores_by_ranges_of_users(spark, monkeypatch, sizes):
    """Sums equal those of joins, with few ranges and many, with rows twice, ids without a match, and null values; no product is shuffled."""
    for name, value in zip(("SCORED", "LEAST_SCORED", "AT_ONCE"), sizes):
        monkeypatch.setattr(models, name, value)
    rng = np.random.default_rng(8)
    draw = lambda n, names, high: spark.createDataFrame([(*map(int, rng.integers(0, high, 2)), float(rng.integers(1, 6)) if rng.random() < 0.9 else None) for _ in range(n)], names)
    profiles, weights = draw(150, "user_id long, item_id long, rating double", 20), draw(120, "src long, dst long, weight double", 25)
    few = draw(150, "user_id long, item_id long, rating double", 22).drop("rating")
    values = lambda df: {(r["user_id"], r["item_id"]): r["score"] for r in df.collect()}
    for f in (models.item_scores, models.user_scores):
        found, want = f(profiles, weights, few), values(models.for_candidates(f(profiles, weights), few))
        assert values(found) == want and found.count() == len(want) > 10
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan and "FlatMapGroupsInArrow" in plan
    named = lambda df: df.select(*(F.concat(F.lit("n"), c).alias(c) if c not in ("rating", "weight") else c for c in df.columns))
    found = models.item_scores(named(profiles), named(weights), named(few))
    assert values(found) == {(f"n{u}", f"n{i}"): s for (u, i), s in values(models.for_candidates(models.item_scores(profiles, weights), few)).items()}
    assert models.item_scores(profiles, weights, few.limit(0)).count() == 0


def dense_ease(x, l2):
    p = np.linalg.inv(x.T @ x + l2 * np.eye(x.shape[1]))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    return b


@pytest.mark.parametrize("side", [7, 64])
def test_ease_equals_numpy(spark, side):
    x = binary(1, 60, 30, 0.3)
    b = np.zeros((30, 30))
    for r in dense.ease(cells(spark, x), 5.0, None, side).collect():
        b[r["src"], r["dst"]] = r["weight"]
    assert np.allclose(b, dense_ease(x, 5.0), atol=1e-12)


def test_ease_on_the_registered_table(spark):
    """The largest weights of every item of sf0.001, in blocks, equal numpy's."""
    m = mat(Views(spark, SMALL))
    rows = m.collect()
    ids = sorted({r["col"] for r in rows})
    users = {u: k for k, u in enumerate(sorted({r["row"] for r in rows}))}
    x = np.zeros((len(users), len(ids)))
    for r in rows:
        x[users[r["row"]], ids.index(r["col"])] = r["value"]
    want = dense_ease(x, 100.0)
    got = dense.ease(m, 100.0, 20, 96).collect()
    assert len(got) == 20 * len(ids)
    place = {c: k for k, c in enumerate(ids)}
    for dst in ids[::17]:
        mine = {place[r["src"]]: r["weight"] for r in got if r["dst"] == dst}
        column = want[:, place[dst]]
        assert all(column[k] == pytest.approx(w, abs=1e-10) for k, w in mine.items())
        assert min(mine.values()) >= np.sort(np.delete(column, place[dst]))[-20] - 1e-10
    assert dense.ease(m.limit(0), 1.0).count() == 0


def test_inverse_by_halves():
    x = np.random.default_rng(4).normal(size=(400, 301))
    a = x.T @ x + np.eye(301)
    assert np.allclose(dense._inverted(a) @ a, np.eye(301), atol=1e-8)


def test_pairs_of_items_as_regressors(spark):
    """Equal to the dense regression in which a pair has no weight for its own items."""
    x = binary(1, 60, 30, 0.3)
    m = cells(spark, x)
    extended, named = peritem.with_pairs(m, peritem.item_pairs(m, 0.6))
    pairs = sorted((r["i"], r["j"], r["col"]) for r in named.collect())
    assert pairs
    a = np.hstack((x, np.stack([x[:, i] * x[:, j] for i, j, _ in pairs], axis=1)))
    columns = [2 * k for k in range(30)] + [c for *_, c in pairs]
    weights = peritem.higher_order(extended, named, 5.0, 7.0, 1000)
    found = {(r["src"], r["dst"]): r["weight"] for r in weights.collect()}
    b = np.zeros((len(columns), 30))
    for j in range(30):
        of = [k for k in range(len(columns)) if k != j and not (k >= 30 and j in pairs[k - 30][:2]) and a[:, k] @ x[:, j] > 0]
        own = a[:, of]
        b[of, j] = np.linalg.solve(own.T @ own + np.diag([5.0 if k < 30 else 7.0 for k in of]), own.T @ x[:, j])
    assert all(found.get((columns[k], 2 * j), 0.0) == pytest.approx(b[k, j], abs=1e-12) for k in range(len(columns)) for j in range(30))
    scores = {(r["user_id"], r["item_id"]): r["score"] for r in peritem.higher_order_scores(extended, weights).collect()}
    want = a @ b
    assert all(scores[u, i] == pytest.approx(want[u, i]) for u, i in scores) and len(scores) > 1000


def test_svd_equals_numpy(spark):
    """With all directions in the range finder; signs as the operator sets them; users and items with ids of their own."""
    x = binary(5, 50, 18, 0.3)
    inter = cells(spark, x).select((F.col("row") + 1000).alias("user_id"), (F.col("col") * 3).alias("item_id"), "value")
    users, items = factors.pure_svd(inter.union(inter.limit(5)), 8)
    u = np.array([r["vec"] for r in sorted(users.collect(), key=lambda r: r["id"])])
    i = np.array([r["vec"] for r in sorted(items.collect(), key=lambda r: r["id"])])
    left, s, right = np.linalg.svd(x[x.any(axis=1)], full_matrices=False)
    sign = np.where(right[:8].sum(axis=1) < 0, -1, 1)
    assert np.allclose(u, left[:, :8] * sign, atol=1e-8) and np.allclose(i, right[:8].T * s[:8] * sign, atol=1e-8)


def test_svd_of_a_larger_matrix(spark):
    """Beyond the range finder's directions singular values are those of numpy, and a matrix of low rank is met exactly."""
    x = binary(6, 200, 90, 0.1)
    _, items = factors.pure_svd(cells(spark, x).select(F.col("row").alias("user_id"), F.col("col").alias("item_id")), 6)
    got = np.linalg.norm(np.array([r["vec"] for r in items.collect()]), axis=0)
    assert np.allclose(got, np.linalg.svd(x)[1][:6], rtol=1e-2)
    low = np.zeros((9, 7))
    low[:4, :3], low[5:, 4:] = 1, 1
    users, items = factors.pure_svd(cells(spark, low).select(F.col("row").alias("user_id"), F.col("col").alias("item_id")), 5)
    u, i = ({r["id"]: np.array(r["vec"]) for r in df.collect()} for df in (users, items))
    assert len(u[0]) == 2 and all(u[a] @ i[b] == pytest.approx(low[a, b], abs=1e-9) for a in u for b in i)
    assert factors.pure_svd(spark.createDataFrame([], "user_id long, item_id long"), 4)[0].count() == 0


def test_triangle(spark):
    x = np.random.default_rng(2).normal(size=(500, 5))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vec array<double>").repartition(7)
    r = factors.triangle(rows)
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(r, np.triu(r))


def test_largest_products_equal_brute_force(spark):
    """Vectors of very different lengths, some of them equal and some zero: the same as all products, most blocks unopened."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) * rng.exponential(size=(300, 1)) ** 2
    x[10:20] = x[5]
    x[30] = 0
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    f = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {}
    for r in similarity.largest_products(f, f, 5, 16).collect():
        got.setdefault(r["query"], []).append((-round(r["product"], 9) + 0.0, r["id"]))
    s = x @ x.T
    for q in range(300):
        want = sorted((-round(float(s[q, j]), 9) + 0.0, j) for j in range(300) if j != q)[:5]
        assert [j for _, j in sorted(got[q])] == [j for _, j in want] and np.allclose([p for p, _ in sorted(got[q])], [p for p, _ in want])
    assert similarity.largest_products(f, f.limit(0), 5).count() == 0
    assert similarity.largest_products(f, f.limit(3), 5).where("query = 200").count() == 3
    lengths = np.sort(np.linalg.norm(x, axis=1))[::-1]
    least = np.array([-got[q][-1][0] for q in range(300)])
    opened = (np.linalg.norm(x, axis=1)[:, None] * lengths[::16] >= np.sort(s, axis=1)[:, -6][:, None]).sum()
    assert opened < 0.6 * 300 * 19 and (least > -np.inf).all()


def test_pair_sums_of_blocks_and_slices(spark, monkeypatch):
    """Sums, halves, others' values and best neighbours equal numpy's, however columns are dealt into blocks, frequent ones into slices and long rows into pieces; no pair is shuffled but those of sliced columns."""
    x = np.random.default_rng(4).integers(0, 4, (40, 12)) * 1.0
    x[:, 5] = 3.0  # in every row
    m = cells(spark, x)
    want = {(i, j): (float(x[:, i] @ x[:, j]), int(((x[:, i] > 0) & (x[:, j] > 0)).sum())) for i in range(12) for j in range(12) if i != j}
    squares = (x**2).sum(axis=0)
    for work, block, at_once in ((4_000_000, 1024, 1_000_000), (300, 5, 70)):
        for name, value in (("WORK", work), ("BLOCK", block), ("AT_ONCE", at_once)):
            monkeypatch.setattr(similarity, name, value)
        found = similarity.pair_sums(m).collect()
        assert {(r["i"], r["j"]): (r["dot"], r["n"]) for r in found} == want and len(found) == len(want)
        assert all(r["si"] == squares[r["i"]] and r["sj"] == squares[r["j"]] for r in found)
        assert {(r["i"], r["j"]): r["n"] for r in similarity.pair_sums(m, 20, halves=True).collect()} == {p: n for p, (_, n) in want.items() if p[0] < p[1] and n >= 20}
        there = {(r["i"], r["j"]): r["dot"] for r in similarity.pair_sums(m, others_only=True).collect()}
        assert there == {(i, j): float(x[x[:, i] > 0, j].sum()) for i, j in want if want[i, j][1]}
        near = {(r["dst"], r["rank"]): r["src"] for r in similarity.similar(m, "dot", 3).collect()}
        assert near == {(i, k + 1): j for i in range(12) for k, j in enumerate(sorted((j for j in range(12) if j != i), key=lambda j: (-want[i, j][0], j))[:3])}
    monkeypatch.setattr(similarity, "WORK", 4_000_000)
    plan = similarity.pair_sums(m)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(i#" not in plan and "FlatMapGroupsInArrow" in plan


def test_pair_sums_in_rounds(spark, monkeypatch):
    """Best neighbours and frequent pairs are those of one round, however many rounds the units of scattered ids are dealt into; no shuffle is left of a round. String ids, too."""
    x = np.random.default_rng(14).integers(0, 4, (50, 40)) * 1.0
    m = cells(spark, x)
    dot = lambda dot, n, si, sj: dot
    ask = lambda t: [sorted(map(tuple, f.collect())) for f in (similarity.pair_sums(t, best=(3, dot)), similarity.pair_sums(t, 28), similarity.pair_sums(t, 28, halves=True))]
    want = ask(m)
    assert len(want[0]) == 120 and want[1] and len(want[1]) == 2 * len(want[2])
    monkeypatch.setattr(similarity, "WORK", 4000)
    monkeypatch.setattr(similarity, "ROUND", 3000)
    monkeypatch.setattr(similarity, "MATRICES", 1)
    monkeypatch.setattr(similarity, "DEALT", 500)
    assert ask(m) == want
    plan = similarity.pair_sums(m, best=(3, dot))._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan
    named = m.withColumn("col", F.concat(F.lit("c"), F.lpad(F.col("col").cast("string"), 2, "0")))
    assert ask(named) == [[(f"c{i:02}", f"c{j:02}", *rest) for i, j, *rest in rows] for rows in want]


def test_item_pairs_of_rare_and_frequent(spark):
    """With a threshold below one all pairs are frequent; above it only those counted more often."""
    x = binary(5, 30, 8, 0.4)
    n = {(i, j): int((x[:, i] * x[:, j]).sum()) for i in range(8) for j in range(i + 1, 8)}
    for threshold in (0.01, 0.5, 0.8):
        found = [tuple(r) for r in peritem.item_pairs(cells(spark, x), threshold).collect()]
        assert sorted(found) == sorted((r, i, j) for r in range(30) for (i, j), c in n.items() if x[r, i] and x[r, j] and c > threshold * max(n.values()))


def test_negatives_of_arrays_and_rows_are_the_same(spark, monkeypatch):
    """Users drawn for in one row have the negatives of those with a row for each draw; full, busy and new users too, and nothing is exploded before the draws are chosen."""
    rows = spark.createDataFrame([(u, i) for u in range(6) for i in range(40) if u == 0 or (u == 1 and i < 37) or (i * 7 + u) % 5 == 0], "user_id long, item_id long")
    users, items = spark.createDataFrame([(u,) for u in range(7)], "user_id long"), spark.createDataFrame([(i,) for i in range(40)], "item_id long")
    take = lambda: sorted(map(tuple, negatives.fixed_negatives(users, rows, items, 9, 5).collect()))
    found = take()
    assert {u: sum(r[0] == u for r in found) for u in range(7)} == {0: 0, 1: 2, 2: 9, 3: 9, 4: 9, 5: 9, 6: 9}
    chosen = []
    monkeypatch.setattr(negatives, "sampled", lambda users, *rest, f=negatives.sampled: chosen.extend(r["user_id"] for r in users.collect()) or f(users, *rest))
    assert take() == found and sorted(chosen) == [0, 1]
    monkeypatch.setattr(negatives, "HELD", 8)
    chosen.clear()
    assert take() == found and sorted(chosen) == list(range(7))


def test_regressions_in_blocks_and_by_joins(spark, monkeypatch):
    """Ridge and elastic net on neighbourhoods equal numpy's, in one block, in many, and where columns are longer than a block; no pair of items and no Gram entry is shuffled in blocks."""
    rng = np.random.default_rng(7)
    x = binary(7, 50, 16, 0.3) * rng.integers(1, 5, (50, 16))
    x[:, 3] = rng.integers(1, 5, 50)  # in every row
    m, g = cells(spark, x), x.T @ x
    near = {j: sorted((i for i in range(16) if i != j and ((x[:, i] > 0) & (x[:, j] > 0)).any()), key=lambda i: (-g[i, j], i))[:6] for j in range(16)}
    for entries, numbers in ((8_000_000, 4_000_000), (150, 40), (90, 4_000_000), (1, 7)):
        monkeypatch.setattr(peritem, "ENTRIES", entries)
        monkeypatch.setattr(peritem, "NUMBERS", numbers)
        ridge = {(r["src"], r["dst"]): r["weight"] for r in peritem.ridge(m, 5.0, 6).collect()}
        slim = {(r["src"], r["dst"]): r["weight"] for r in peritem.slim(m, 2.0, 0.3, 6, 4).collect()}
        assert len(slim) == len({(s, d) for s, d in slim if slim[s, d] > 0})
        for j, of in near.items():
            own = sorted(of)
            w = np.linalg.solve(g[np.ix_(own, own)] + 5.0 * np.eye(len(own)), g[own, j])
            assert all(ridge[i, j] == pytest.approx(v, abs=1e-10) for i, v in zip(own, w))
            w = np.zeros(len(own))
            for _ in range(50):
                before = w.copy()
                for i, c in enumerate(own):
                    w[i] = max(0.0, g[c, j] - g[c, own] @ w + g[c, c] * w[i] - 0.6) / (g[c, c] + 1.4)
                if np.abs(w - before).max() < 1e-7:
                    break
            best = sorted((i for i in range(len(own)) if w[i] != 0), key=lambda i: (-round(w[i], 9), own[i]))[:4]
            assert {s: v for (s, d), v in slim.items() if d == j} == pytest.approx({own[i]: w[i] for i in best}, abs=1e-9)
    monkeypatch.setattr(peritem, "ENTRIES", 8_000_000)
    plan = peritem.slim(m, 2.0, 0.3, 6, 4)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(dst" not in plan


def test_gram_matrices_of_pairs_and_of_cells(monkeypatch):
    """Sums over pairs of entries and products of whole rows give the same systems, however many rows at once."""
    import pyarrow as pa

    x = binary(21, 60, 12, 0.2) * np.random.default_rng(21).integers(1, 5, (60, 12))
    columns = pa.table({"col": list(range(12)), "rows": [np.flatnonzero(c).tolist() for c in x.T], "values": [c[c > 0].tolist() for c in x.T]})
    asked = pa.table({"dst": [3, 7], "srcs": [[3, 0, 1, 5, 9], [7, *range(7), 11]]})
    for numbers in (4_000_000, 40):
        monkeypatch.setattr(peritem, "NUMBERS", numbers)
        for sparse in (0, 10**9):
            monkeypatch.setattr(peritem, "SPARSE", sparse)
            for dst, ids, g, y in peritem._systems(asked, columns):
                assert np.allclose(g, x[:, ids].T @ x[:, ids]) and np.allclose(y, x[:, ids].T @ x[:, dst])


@pytest.mark.parametrize("kind", ["euclidean", "cosine", "dot", "tversky"])
def test_neighbours_of_equal_columns(spark, monkeypatch, kind):
    """Groups of equal columns give the same neighbours, ties included, as all columns; sums are formed of one of each group only."""
    x = binary(11, 9, 14, 0.4)[:, np.random.default_rng(11).integers(0, 14, 60)]
    m, formed = cells(spark, x), []
    want = {(r["dst"], r["rank"]): (r["src"], r["weight"]) for r in similarity.similar(m, kind, 5).collect()}
    plain = similarity.pair_sums
    monkeypatch.setattr(similarity, "pair_sums", lambda matrix, *a, **b: formed.append(matrix.select("col").distinct().count()) or plain(matrix, *a, **b))
    got = {(r["dst"], r["rank"]): (r["src"], r["weight"]) for r in similarity.similar_groups(m, kind, 5).collect()}
    assert formed == [len({tuple(c) for c in x.T if c.any()})] and formed[0] < 15
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1e-9) for p in want)


def test_equal_columns_of_weighted_features(spark, monkeypatch):
    """Sums of feature weights are formed of one of each group of equal items; a small matrix is dealt into blocks of any work."""
    x = binary(12, 7, 9, 0.5)[:, np.random.default_rng(12).integers(0, 9, 50)]
    x[0] = 1.0
    f = cells(spark, x).select(F.col("row").alias("feature"), F.col("col").alias("item_id"))
    w, formed, plain = [0.5 + k for k in range(7)], [], similarity.pair_sums
    monkeypatch.setattr(similarity, "pair_sums", lambda matrix, *a, **b: formed.append(matrix.select("col").distinct().count()) or plain(matrix, *a, **b))
    got = {(r["dst"], r["rank"]): (r["src"], round(r["weight"], 9)) for r in similarity.feature_weighted(f, spark.createDataFrame(list(enumerate(w)), "feature long, w double"), 6).collect()}
    sums = np.round((x * np.array(w)[:, None]).T @ x, 9)
    want = {(i, k + 1): (j, sums[i, j]) for i in range(50) for k, j in enumerate(sorted((j for j in range(50) if j != i and sums[i, j]), key=lambda j: (-sums[i, j], j))[:6])}
    assert got == want and formed == [len({tuple(c) for c in x.T})] and formed[0] < 10


@pytest.mark.parametrize("halves, others_only", [(False, False), (True, False), (False, True)])
def test_sums_of_long_rows_are_the_same(monkeypatch, halves, others_only):
    """Row by row in place, or from all pairs; rows that have a column twice count it twice in both."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(20, 7, replace=False).tolist()) for _ in range(9)]
    for twice in (False, True):
        rows = [sorted([*s, s[2]]) if twice else s for s in sets]
        units = pa.table({f"{side}_{c}": [s if c == "col" else [float(i * 3 % 5 + (c == "value") * k * (1 - others_only)) for i in s] for k, s in enumerate(rows)] for side in ("own", "other") for c in ("col", "value", "s")})
        found = []
        for long in (1, 10**6):
            monkeypatch.setattr(similarity, "LONG", long)
            found.append([similarity._block_sums(units, "bigint", 2, halves, others_only, best, 50).to_pydict() for best in (None, (3, lambda dot, n, si, sj: dot / (sj + 1)))])
        assert found[0] == found[1] and len(found[0][0]["i"]) > 50


def test_sums_counted_and_sorted_are_the_same(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = [sorted(rng.choice(20, 6, replace=False).tolist()) for _ in range(9)]
    units = pa.table({f"{side}_{c}": [s if c == "col" else [float(i + k) for i in s] for k, s in enumerate(sets)] for side in ("own", "other") for c in ("col", "value", "s")})
    found = []
    for dense in (0, 10**6):
        monkeypatch.setattr(similarity, "DENSE", dense)
        found.append(similarity._block_sums(units, "bigint", 1, False, False, None, 50).to_pydict())
    assert found[0] == found[1] and len(found[0]["i"]) > 50


def test_units_are_packed_and_larger_where_there_are_many_blocks(spark, monkeypatch):
    """Packed units are what they were, in a fraction of their size; only packed ones are shuffled to blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [sorted(rng.choice(20_000, 40, replace=False).tolist()) for _ in range(3000)]
    lists = {f"{side}_{c}": [r if c == "col" else [float(i % 5 + 1) for i in r] for r in rows] for side in ("own", "other") for c in ("col", "value", "s")}
    units = pa.table({"block": pa.array(np.arange(3000) % 4), "slice": pa.array(np.zeros(3000, np.int32)), **lists})
    packed = pa.Table.from_batches(list(similarity._packed(iter(units.to_batches(500)))))
    assert packed.num_rows == 4 and sum(len(x) for x in packed["units"].to_pylist()) < units.nbytes / 4
    assert similarity._unpacked(packed).to_pydict() == {c: x for c, x in units.sort_by("block").to_pydict().items() if c not in ("block", "slice")}
    monkeypatch.setattr(similarity, "PACKED", 1)
    assert pa.Table.from_batches(list(similarity._packed(iter(units.to_batches(500))))).num_rows == 24
    plan = similarity.pair_sums(cells(spark, binary(1, 9, 5, 0.5)))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_shuffle_files_of_a_stored_table_go_at_once(spark):
    """Its rows don't need them, nor does a setting of the session stay changed."""
    import glob
    import os

    from aislecraft.sources import storage

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folder for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}
    assert list(folder)
    before, setting = files(), spark.conf.get(storage.CLEANUP, "false")
    table = storage.stored(spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert not files() - before and table.count() == 7
    assert spark.conf.get(storage.CLEANUP, "false") == setting
