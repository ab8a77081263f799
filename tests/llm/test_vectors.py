"""The operators on embeddings against brute force, on awkward rows and in small blocks."""

import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aislecraft.llm import hard_negatives, near_vectors, oracles, whitening
from aislecraft.llm import queries as queries_of_llm

SCHEMA = "vec_id long, embedding array<double>, label int, x string, node long, row long, cell int, n long, home int, turn int"
SMALL = "/root/testdata/sf0.001"


def make(spark, rows):
    """Vectors with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, e, label, "x", 1, 2, 3, 4, 5, 6) for i, e, label in rows], SCHEMA)


def clustered(seed, n, width=8, groups=6, noise=0.25):
    """Vectors around centres, copies among them, with cosines on both sides of 0.9."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width))
    out = [[float(v) for v in centres[r.integers(groups)] + r.normal(size=width) * noise * r.random()] for _ in range(n)]
    return [out[r.integers(k)] if k and r.random() < 0.2 else x for k, x in enumerate(out)]


AWKWARD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [None] + [1.0] * 7, 2), (904, [float("nan")] + [1.0] * 7, 2), (905, [float("inf")] * 8, 2), (906, [1.0, 2.0], 3), (907, [2.0, 4.0], 3),
    (None, [1.0] * 8, 1), (908, [1.0] * 8, None), (909, [1e-200] * 8, 2), (910, [2e-200] * 8, 4), (911, [-0.0] * 7 + [1.0], 2), (912, [0.0] * 7 + [1.0], 2), (912, [0.0] * 7 + [1.0], 2), (912, [1.0] + [0.0] * 7, 2),
]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(5 * k, x, r.randrange(3)) for k, x in enumerate(clustered(1, 160))] + AWKWARD


def whole(e, width=8):
    ok = e is not None and len(e) == width and all(v is not None and np.isfinite(v) and abs(v * 256) < 2**63 for v in e)
    return [int(np.floor(v * 256)) for v in e] if ok else None


def check_whitening(rows, got, width=8):
    good = [(i, x) for i, e, _ in rows if (x := whole(e, width))]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    v = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n)) for j in range(width)] for i in range(width)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    want = {}
    for i, x in good:
        y = [n * a - s for a, s in zip(x, sums)]
        want.setdefault((-1 if i is None else i), []).append((sum(a * a for a in y), np.array([float(Fraction(a, n)) for a in y])))
    seen = {}
    for r in got:
        key = (-1 if r["vec_id"] is None else r["vec_id"], r["component"])
        seen[key] = seen.get(key, 0) + 1
        k = r["component"] - 1
        close = [c for d, c in want[key[0]] if d == r["deviation"] and abs(abs(c @ axes[:, k] / values[k] ** 0.5) - abs(r["whitened"])) < 1e-8]
        assert close and r["n"] == n and abs(r["explained"] - values[k] / np.trace(v)) < 1e-12 and r["identity_error"] < 1e-9
    assert seen == {(i, k): len(each) for i, each in want.items() for k in range(1, min(4, width) + 1)}
    return v


def test_whitening_equals_brute_force(spark, rows):
    check_whitening(rows, whitening.whiten(make(spark, rows)).collect())


def test_moments_are_exact_whatever_the_size(spark):
    """Sums beyond a long, and means far from zero, lose nothing."""
    r = random.Random(4)
    vectors = [(k, [r.random() * 2**40, 2**44 + r.random(), r.random() * 1e-2, -(2.0**50) + k], 0) for k in range(40)]
    x = [whole(e, 4) for _, e, _ in vectors]
    df, width = whitening.whole_rows(make(spark, vectors))
    m = whitening.moments(df.select("x"), width)
    sums = [sum(c) for c in zip(*x)]
    assert (m.n, m.sums) == (40, sums)
    assert m.scatter == [[40 * sum(a[i] * a[j] for a in x) - sums[i] * sums[j] for j in range(4)] for i in range(4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(make(spark, vectors)).collect()}
    want = {k: sum((40 * a - s) ** 2 for a, s in zip(v, sums)) for k, v in enumerate(x)}
    assert got == {k: v if v < 2**63 else None for k, v in want.items()} and None in got.values()


def test_whitening_without_variance(spark):
    one = whitening.whiten(make(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["n"] == 1 and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    line = whitening.whiten(make(spark, [(k, [float(k), 2.0 * k, 1.0], 0) for k in range(5)])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1} and {r["component"] for r in line} == {1, 2, 3}
    assert whitening.whiten(make(spark, [])).collect() == [] and whitening.whiten(make(spark, AWKWARD[:2])).collect() == []


def mined(rows, every):
    good = sorted({(i, label, tuple(x)) for i, e, label in rows if i is not None and label is not None and (x := whole(e))})
    out = []
    for i, label, x in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, same) for j, same, y in good)
        for s, p, _ in [(s, j, of) for s, j, of in scored if of == label and j != i][:5]:
            negatives = [(t, j) for t, j, of in scored if of != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(negatives, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, rows):
    got = hard_negatives.mine(make(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r)[:6] for r in got) == mined(rows, 10)


def test_hard_negatives_in_small_blocks(spark, rows, monkeypatch):
    for name, value in (("ROWS", 23), ("ANCHORS", 9), ("CHUNK", 4), ("FIRST", 3), ("SEGMENTS", (8, 3, 2))):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine(make(spark, rows), F.col("vec_id") % 4 == 0).collect()
    assert sorted(tuple(r)[:6] for r in got) == mined(rows, 4)
    assert hard_negatives.mine(make(spark, []), F.col("vec_id") % 4 == 0).collect() == []
    alone = [(4, [1.0] * 8, 1), (8, [1.0] * 8, 2)]
    assert hard_negatives.mine(make(spark, alone), F.col("vec_id") % 4 == 0).collect() == []


def test_segments_bound_scores():
    """Exact scores lie within the bounds of every level, and shorter segments bound them closer."""
    r = np.random.default_rng(5)
    x = r.integers(-200, 200, (60, 22))
    means, devs = hard_negatives.summaries(x)
    exact, spread, at = x @ x.T, [], 0
    for length in hard_negatives.SEGMENTS:
        n = len(hard_negatives.cuts(22, length)) - 1
        low, high = hard_negatives.bounds(means[:, at : at + n], devs[:, at : at + n], means[:, at : at + n], devs[:, at : at + n])
        assert (low <= exact).all() and (exact <= high).all()
        spread.append((high - low).mean())
        at += n
    assert spread == sorted(spread, reverse=True) and at == means.shape[1]


def test_segments_spare_exact_scores(spark, monkeypatch):
    """Of clustered rows more than half are never scored exactly."""
    vectors = [(k, x, k % 3) for k, x in enumerate(clustered(7, 600, 32, 20, 0.4))]
    df, _ = hard_negatives.summarised(make(spark, vectors))
    block, opened = hard_negatives.Block(df.toPandas()), []
    monkeypatch.setattr(hard_negatives, "FIRST", 8)
    plain = hard_negatives.scores
    monkeypatch.setattr(hard_negatives, "scores", lambda q, x, most: opened.append(len(x)) or plain(q, x, most))
    valid = lambda part: block.labels[part, None] != block.labels
    all_ = np.full((len(block.ids), 1), np.inf)
    assert sum(1 for _ in hard_negatives.searched(block, block, 5, valid, -all_, all_)) == len(block.ids)
    assert sum(opened) < 0.4 * sum(int((block.labels != of).sum()) for of in block.labels)


def test_scores_beyond_longs(spark):
    big = [(0, [2.0**54] * 2, 1), (1, [2.0**54] * 2, 1), (2, [-(2.0**54)] * 2, 1), (3, [2.0**20, 1.0], 2)]
    got = hard_negatives.mine(make(spark, big), F.col("vec_id") == 0).collect()
    assert [tuple(r)[:6] for r in got] == []  # the window of a score at the end of a long holds no negative here
    top = hard_negatives.scores(np.array([2**62, 2**62]), np.array([[2**62, 1], [-(2**62), 0], [0, 1]]), 2**126)
    assert top.tolist() == [2**63 - 1, -(2**63), 2**62]


def grouped(rows, threshold=0.9):
    units = []
    for i, e, _ in rows:
        ok = i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e) and any(v != 0 for v in e)
        y = np.array(e, float) / np.abs(e).max() if ok else None
        units.append(y / np.linalg.norm(y) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, queue = {i}, [i]
        while queue:
            for j in near[queue.pop()]:
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        least = None if rows[i][0] is None else min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), least, least is None or rows[i][0] == least))
    return sorted(out, key=str)


def test_near_vectors_equal_brute_force(spark, rows):
    got = near_vectors.groups(make(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == grouped(rows)
    assert near_vectors.groups(make(spark, [])).collect() == []
    assert near_vectors.groups(make(spark, AWKWARD[:3])).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors_in_small_cells_and_blocks(spark, monkeypatch, seed):
    """Pairs that straddle cells or blocks are counted once; floats stay floats."""
    monkeypatch.setattr(near_vectors, "CELLS", (12, 12))
    monkeypatch.setattr(near_vectors, "BLOCK", 5)
    rows = [(k, [float(np.float32(v)) for v in x], 0) for k, x in enumerate(clustered(seed, 150, 4, 5, 0.9))]
    df = make(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert sorted(map(tuple, near_vectors.groups(df).collect()), key=str) == grouped(rows)


def test_near_vectors_in_rounds_of_cells(spark, monkeypatch):
    """However few vectors a round sends to its tasks, the links are those of one round; each round is stored."""
    r = np.random.default_rng(8)
    base = r.normal(size=(20, 5))
    rows = [(k, (base[k % 20] + 0.25 * r.normal(size=5)).tolist()) for k in range(300)]
    take = lambda: sorted(tuple(x)[:3] for x in near_vectors.groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    monkeypatch.setattr(near_vectors, "CELLS", (12, 12))
    want, kept, plain = take(), [], near_vectors.stored
    monkeypatch.setattr(near_vectors, "SENT", 1)
    monkeypatch.setattr(near_vectors, "TIMES", 1)
    monkeypatch.setattr(near_vectors, "stored", lambda df, name: kept.append(name) or plain(df, name))
    assert take() == want and kept.count("links") > 3 and any(n for _, n, _ in want)


def test_every_near_pair_meets_in_one_cell():
    """Of two vectors at the threshold one visits the other's cell, wherever the centres are; with a smaller reach there are fewer visits."""
    r = np.random.default_rng(9)
    x = near_vectors.unit(r.normal(size=(400, 6)))
    c = near_vectors.centres(x, 20)
    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    visits = {reach: near_vectors.visited(x @ c.T, apart, reach * 0.05**0.5) for reach in (1.0, 0.3)}
    home, to = visits[1.0]
    for i, j in np.argwhere(x @ x.T >= 0.9):
        assert home[i] == home[j] or home[j] in to[i] or home[i] in to[j]
    assert sum(map(len, visits[0.3][1])) < sum(map(len, to)) < 400 * 19


def test_forest_spans():
    r = np.random.default_rng(2)
    for _ in range(50):
        m = r.random((r.integers(0, 9), r.integers(0, 9))) < 0.2
        a, b = near_vectors.forest(m)
        assert m[a, b].all() and len(a) < max(1, sum(m.shape))
        own, want = list(range(sum(m.shape))), list(range(sum(m.shape)))
        for label, edges in ((own, zip(a, b)), (want, np.argwhere(m))):
            for i, j in edges:
                old, new = label[i], label[m.shape[0] + j]
                label[:] = [new if v == old else v for v in label]
        same = lambda labels: [[x == y for y in labels] for x in labels]
        assert same(own) == same(want)


@pytest.mark.parametrize("name", ["op12_segment_negatives", "op13_spherical_cells"])
def test_vector_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    want = con.sql(oracles.ORACLES[name])
    got = queries_of_llm.queries()[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_whitening_query(spark):
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, queries_of_llm.queries()["op11_polarisation_whitening"](spark, SMALL).collect(), 64)
