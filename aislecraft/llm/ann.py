"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts with as few
cut edges as local moves find. A small classifier learns from the vectors which
part they, and their neighbours, are in. It assigns every vector of the table to
its most probable part, and routes a query to its most probable ones, where all
vectors are reranked by exact cosine in double precision. The parts follow the
number of vectors: a part that is larger than LEAF has parts of its own, learnt
in the same way, part by part, from a bounded sample of it. How many parts a
query is routed to is measured: as few as find WANTED of the true neighbours of
sample vectors that the classifier has not learnt from.

A leaf's vectors are dealt to tasks in blocks and its queries in turns, by its
own two numbers, so that a leaf or a vector that holds a third of all rows is
many tasks, and one with few queries is not copied.

Cases: vectors that are null, zero, of another length than most of the index, or
that hold null or non-finite components take no part, neither as query nor as
candidate; very small and very large components are scaled before squares are
taken; ties go to the smaller vec_id; rows of the index that repeat a vec_id
count as candidates each; queries that repeat a vec_id are one query each for
every different vector, told apart by query_row, and a query never finds its own
id; fewer candidates than asked for are all returned; an empty table gives no
rows; columns other than vec_id and embedding play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.llm.common import small_enough, stored

#: Vectors that the partitions of a level are learnt from, at most; of these, as many as one in HELD_OUT measure the probes.
SAMPLE, HELD_OUT = 6000, 10
#: Vectors of a leaf, at most, about; leaves that even few vectors have; parts of one level, at most; neighbours in the graph.
LEAF, LEAST_LEAVES, MOST_PARTS, NEIGHBOURS = 2048, 16, 64, 10
#: Share of the true neighbours that the probes have to find in the sample.
WANTED = 0.96
#: How far a part of the sample may outgrow the mean.
SLACK = 1.1
HIDDEN, STEPS, BATCH, RATE = 64, 600, 256, 0.01
#: Vectors and queries that one task holds at a time.
BLOCK, HELD = 8192, 2048
#: Bytes of the leaves' sizes up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
K = 5


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row of unit vectors the places of its k nearest others."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """A part for each row, none much larger than the mean: halving along principal directions, then moves that save cut edges."""
    n, rng = len(x), np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    while part.max() + 1 < parts:
        new = np.empty_like(part)
        for p in range(part.max() + 1):
            at = np.flatnonzero(part == p)
            c = x[at] - x[at].mean(axis=0)
            d = np.linalg.svd(c.T @ c)[0][:, 0]
            order = at[np.argsort(c @ d, kind="stable")]
            new[order[: len(order) // 2]], new[order[len(order) // 2 :]] = 2 * p, 2 * p + 1
        part = new
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    linked = [np.concatenate((near[i], np.array(back[i], np.int64))) for i in range(n)]
    size, most = np.bincount(part, minlength=parts), SLACK * n / parts
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[linked[i]], minlength=parts)
            best = int(np.where(size < most, votes, -1).argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i], moved = best, moved + 1
        if moved < n // 200:
            break
    return part


class Router:
    """One hidden layer from a unit vector to probabilities of parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 2):
        rng = np.random.default_rng(seed)
        d, k = x.shape[1], target.shape[1]
        self.p = {"a": rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, HIDDEN**-0.5, (HIDDEN, k)), "d": np.zeros(k)}
        state = {n: [np.zeros_like(v), np.zeros_like(v)] for n, v in self.p.items()}
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(x), BATCH)
            h = np.maximum(x[at] @ self.p["a"] + self.p["b"], 0)
            e = (self._soft(h) - target[at]) / BATCH
            back = (e @ self.p["c"].T) * (h > 0)
            for n, g in {"c": h.T @ e, "d": e.sum(axis=0), "a": x[at].T @ back, "b": back.sum(axis=0)}.items():
                m, v = state[n]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.p[n] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def _soft(self, h: np.ndarray) -> np.ndarray:
        y = h @ self.p["c"] + self.p["d"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(x @ self.p["a"] + self.p["b"], 0))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither vanish nor overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of the vectors that can take part."""
    x = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    )


def learnt(rows: np.ndarray, parts: int) -> Router | None:
    """A router to `parts` parts (fewer where the rows are few; none where that leaves one)."""
    while parts > 1 and parts * 4 > len(rows):
        parts //= 2
    if parts < 2:
        return None
    x = unit(rows)
    near = neighbour_graph(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    for k in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[near[:, k]]), 1.0)
    return Router(x, target / target.sum(axis=1, keepdims=True))


def parts_for(n: int, leaf: int, most: int) -> int:
    """A power of two of parts for n vectors of a level, about `leaf` in each, `most` at most."""
    return min(most, 1 << max(0, -(-n // leaf) - 1).bit_length())


def leaf_for(n: int) -> int:
    """Vectors of a leaf: a sixteenth of all, until leaves are as large as a task's share."""
    return max(1, min(LEAF, -(-n // LEAST_LEAVES)))


class Tree:
    """Routers of two levels: `top` to the parts, `below` (part -> router) to the leaves of those that are divided. A leaf is (part, leaf of it)."""

    def __init__(self, top: Router | None, below: dict[int, Router], most: int):
        self.top, self.below, self.most, self.probes = top, below, most, 1

    def leaves(self, x: np.ndarray, most: int) -> list[np.ndarray]:
        """For each row of unit vectors its `most` most probable leaves, most probable first."""
        p = self.top.probabilities(x) if self.top else np.ones((len(x), 1))
        ids, shares = [], []
        for k in range(p.shape[1]):
            q = self.below[k].probabilities(x) if k in self.below else np.ones((len(x), 1))
            ids += [k * self.most + j for j in range(q.shape[1])]
            shares.append(p[:, k : k + 1] * q)
        return list(np.array(ids, np.int32)[np.argsort(-np.concatenate(shares, axis=1), axis=1, kind="stable")[:, :most]])


def measured(tree: Tree, x: np.ndarray, asked: np.ndarray, k: int) -> int:
    """The fewest leaves with which WANTED of the k nearest of `x` are found for the rows `asked` of unit vectors."""
    s = asked @ x.T
    near = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, :k] if len(x) > k else np.tile(np.arange(len(x)), (len(asked), 1))
    own = np.array([leaf[0] for leaf in tree.leaves(x, 1)])
    places = [{int(v): j for j, v in enumerate(leaves)} for leaves in tree.leaves(asked, 1 << 30)]
    found = np.sort(np.array([place[int(own[j])] for place, row in zip(places, near) for j in row]))
    return int(found[min(len(found) - 1, int(np.ceil(WANTED * len(found))) - 1)]) + 1 if len(found) else 1


def fit(good: DataFrame, n: int, k: int = K, sample: int = SAMPLE, leaf: int | None = None, most: int = MOST_PARTS) -> Tree | None:
    """A tree of routers learnt from `n` vectors: of each level a bounded number, those whose hashed ids come first."""
    rows = np.array([r["x"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()])
    if not len(rows):
        return None
    held, leaf = max(1, len(rows) // HELD_OUT), leaf or leaf_for(n)
    tree = Tree(learnt(rows[held:], parts_for(n, leaf, most)), {}, most)
    if n > leaf * most and tree.top:  # parts with leaves of their own
        spread = good.sparkSession.sparkContext.broadcast(tree)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    pdf["part"] = np.array([found[0] // most for found in spread.value.leaves(unit(np.stack(pdf["x"].to_list())), 1)], np.int32)
                    yield pdf[["vec_id", "x", "part"]]

        def below(pdf: pd.DataFrame) -> pd.DataFrame:
            router = learnt(np.stack(pdf["x"].to_list()), parts_for(int(pdf["n"].iloc[0]), leaf, most))
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "router": [pickle.dumps(router)]})

        dealt = good.mapInPandas(assign, "vec_id long, x array<double>, part int")
        sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
        # a rate keeps about `sample` of a part, whatever its size
        place = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = dealt.join(F.broadcast(sizes), "part").where(place < sample / F.col("n"))
        tree.below = {r["part"]: router for r in drawn.groupBy("part").applyInPandas(below, "part int, router binary").collect() if (router := pickle.loads(r["router"]))}  # at most MOST_PARTS rows of bounded size
    tree.probes = measured(tree, unit(rows[held:]), unit(rows[:held]), k)
    return tree


def routed(good: DataFrame, tree: Tree, probes: int) -> DataFrame:
    """vec_id, x and its `probes` most probable leaves, most probable first."""
    spread = good.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["leaves"] = spread.value.leaves(unit(np.stack(pdf["x"].to_list())), probes)
                yield pdf[["vec_id", "x", "leaves"]]

    return good.mapInPandas(run, "vec_id long, x array<double>, leaves array<int>")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int | None = None, sample: int = SAMPLE, leaf: int | None = None, most: int = MOST_PARTS) -> DataFrame:
    """query_id, rank, vec_id, score and query_row (which tells queries of one id apart): for each of `queries` (vec_id, embedding) the k nearest of `vectors` that are found."""
    good = usable(vectors)
    widths = good.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()  # one row
    empty = good.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_row long")
    if widths is None:
        return empty
    good = good.where(F.size("x") == widths["width"])
    asked = usable(queries).where(F.size("x") == widths["width"]).distinct()
    tree = fit(good, widths["count"], k, sample, leaf, most)
    index = stored(routed(good, tree, 1).select("vec_id", "x", F.col("leaves")[0].alias("leaf")), "index")
    wanted = stored(routed(asked, tree, probes or tree.probes).select("vec_id", "x", F.xxhash64("vec_id", "x").alias("row"), F.explode("leaves").alias("leaf")), "asked")
    # blocks of a leaf's vectors and turns of its queries: a row for each leaf
    shares = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(wanted.groupBy("leaf").agg(F.count(F.lit(1)).alias("q")), "leaf")
    shares = stored(shares.select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / HELD).cast("int").alias("turns")), "shares")
    hint = F.broadcast if small_enough(shares, BROADCAST_BYTES, F.lit(32)) else (lambda df: df)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())  # rows that repeat a vector are dealt out, too
    index = index.withColumn("salt", salt).join(hint(shares), "leaf").select("vec_id", "x", "leaf", F.pmod("salt", F.col("blocks")).cast("int").alias("block"), every("turns").alias("turn"))
    wanted = wanted.join(hint(shares), "leaf").select("vec_id", "x", "row", "leaf", F.pmod("row", F.col("turns")).cast("int").alias("turn"), every("blocks").alias("block"))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float), "query_row": np.array([], np.int64)})
        if not len(left) or not len(right):
            return none
        left = left.sort_values("vec_id", kind="stable")
        ids, x, out = left["vec_id"].to_numpy(), unit(np.stack(left["x"].to_list())), []
        for a in range(0, len(right), 256):
            part = right.iloc[a : a + 256]
            q, qid, rows = unit(np.stack(part["x"].to_list())), part["vec_id"].to_numpy(), part["row"].to_numpy()
            s = q @ x.T
            s[qid[:, None] == ids[None, :]] = -np.inf
            for j, row in enumerate(s):
                floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                near = np.flatnonzero((row >= floor - 1e-12) & (row > -np.inf))
                exact = np.clip((x[near] * q[j]).sum(axis=1), -1, 1)
                order = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(order), qid[j]), ids[near][order], exact[order], np.full(len(order), rows[j])))
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*out)))))

    keys = ["leaf", "block", "turn"]
    found = index.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double, query_row long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
