"""Recommenders: score tables (user_id, item_id, score) of candidates or of what a similarity reaches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_uniform
from aislecraft.operators import stats
from aislecraft.operators.ingest import prefix_sums
from aislecraft.operators.ranking import top_k
from aislecraft.operators.similarity import _packed, _unpacked, pair_sums
from aislecraft.sources.storage import stored

#: Candidates and profile entries of users scored together: at most, unless one user has more, and at least where there would be fewer than some ranges of users for each core. And products formed at once.
SCORED, LEAST_SCORED, RANGES_OF_CORE, AT_ONCE = 4_000_000, 250_000, 2, 1_000_000


def top_pop(train: DataFrame, candidates: DataFrame) -> DataFrame:
    pop = stats.counts(train, "item_id", "n")
    return candidates.join(pop, "item_id").select("user_id", "item_id", F.log10(F.col("n") + 1).alias("score"))


def global_effects(train: DataFrame, candidates: DataFrame) -> DataFrame:
    mu, items, users = stats.global_effects(train)
    joined = candidates.join(items, "item_id", "left").join(users, "user_id", "left").crossJoin(F.broadcast(mu))  # one row
    return joined.select("user_id", "item_id", (F.col("mu") + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0))).alias("score"))


def mean_rating(train: DataFrame, candidates: DataFrame) -> DataFrame:
    return candidates.join(stats.mean_rating(train, "item_id", "score"), "item_id").select("user_id", "item_id", "score")


def random_scores(candidates: DataFrame, seed: int = 1) -> DataFrame:
    return candidates.select("user_id", "item_id", hash_uniform(seed, F.col("user_id"), F.col("item_id")).alias("score"))


def predefined(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, k)


def item_scores(profiles: DataFrame, similarity: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Sum over a user's items of rating times weight of (src item, dst item); with `candidates` only of their users and items, no other product becomes a row."""
    entries = profiles.select("user_id", F.col("item_id").alias("key"), F.col("rating").cast("double").alias("a"))
    return _summed(entries, similarity.select(F.col("src").alias("key"), F.col("dst").alias("item_id"), F.col("weight").cast("double").alias("b")), candidates)


def user_scores(profiles: DataFrame, similarity: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Sum over a user's neighbours (dst user; src neighbour) of weight times rating; `candidates` as above."""
    entries = similarity.select(F.col("dst").alias("user_id"), F.col("src").alias("key"), F.col("weight").cast("double").alias("a"))
    return _summed(entries, profiles.select(F.col("user_id").alias("key"), "item_id", F.col("rating").cast("double").alias("b")), candidates)


def _summed(entries: DataFrame, lists: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """user_id, item_id, score: sums over entries (user_id, key, a) and lists (key, item_id, b) of equal key of a times b.

    With candidates users are dealt into ranges; a range gets its users'
    entries and candidates and, once, the lists of the keys that they have, all
    packed, and forms the products where they are.
    """
    if candidates is None:
        return entries.join(lists, "key").groupBy("user_id", "item_id").agg(F.sum(F.col("a") * F.col("b")).alias("score"))
    entries, lists = (stored(x.where("key is not null"), name) for x, name in ((entries.where("user_id is not null"), "entries"), (lists.where("item_id is not null"), "lists")))
    candidates = candidates.select("user_id", "item_id").where("user_id is not null and item_id is not null")
    users = candidates.select("user_id").unionByName(entries.select("user_id")).groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = prefix_sums(users, "_n", F.col("user_id").asc())
    share = (placed.agg(F.max("end")).first()[0] or 0) // (RANGES_OF_CORE * entries.sparkSession.sparkContext.defaultParallelism)
    size = min(max(share, LEAST_SCORED), SCORED)
    firsts = placed.groupBy(F.expr(f"start div {size}L").alias("_r")).agg(F.min("user_id").alias("first")).orderBy("_r").collect()  # a row for each range
    kinds, bounds = dict(entries.dtypes) | dict(lists.dtypes), np.array([r["first"] for r in firsts])
    met = entries.select("user_id", "key").mapInArrow(_dealt(bounds, 0), f"key {kinds['key']}, block long, slice int").select("block", "key").distinct()
    parts = [x.mapInArrow(_dealt(bounds, kind, ("user_id",)), PACKED_PARTS) for kind, x in enumerate((entries, candidates))]
    parts.append(met.join(lists, "key").select("block", F.lit(2).alias("slice"), "key", "item_id", "b").mapInArrow(lambda batches: _packed(batches, "key"), PACKED_PARTS))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("block").applyInArrow(lambda table: _scores(table, AT_ONCE), f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double")


PACKED_PARTS = "block long, slice int, units binary"


def _dealt(bounds: np.ndarray, kind: int, order: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the range of their user and a number for their kind; with an order packed, otherwise without the user."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(bounds, batch["user_id"].to_numpy(zero_copy_only=False), "right") - 1
            rows = batch if order else batch.select([c for c in batch.schema.names if c != "user_id"])
            yield rows.append_column("block", pa.array(block, pa.int64())).append_column("slice", pa.array(np.full(len(block), kind, np.int32)))

    return lambda batches: _packed(ranges(batches), *order) if order else ranges(batches)


def _scores(table: pa.Table, at_once: int) -> pa.Table:
    """The scores of a range of users, from its entries, candidates and lists (slice 0, 1, 2); of so many products at once, more only of one entry."""
    entries, wanted, lists = (_unpacked(part) if (part := table.filter(pc.equal(table["slice"], kind))).num_rows else None for kind in range(3))
    if entries is None or wanted is None or lists is None:
        like = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])
        user = next((x.schema.field("user_id").type for x in (entries, wanted) if x is not None), pa.int64())
        item = next((x.schema.field("item_id").type for x in (lists, wanted) if x is not None), pa.int64())
        return like.set(0, pa.field("user_id", user)).set(1, pa.field("item_id", item)).empty_table()
    ids = lambda x, c: x[c].to_numpy()
    users, user_at = np.unique(ids(wanted, "user_id"), return_inverse=True)
    items, item_at = np.unique(ids(wanted, "item_id"), return_inverse=True)
    width, sought = len(items), np.unique(user_at * len(items) + item_at)

    def among(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(of, values), len(of) - 1)
        return at, of[at] == values

    lists = lists.filter(pa.array(among(ids(lists, "item_id"), items)[1])).sort_by("key")
    keys, begin, many = np.unique(ids(lists, "key"), return_index=True, return_counts=True)
    score, found, valued = np.zeros(len(sought)), np.zeros(len(sought), bool), np.zeros(len(sought), bool)
    if len(keys):
        user, known = among(ids(entries, "user_id"), users)
        key, has = among(ids(entries, "key"), keys)
        order = np.flatnonzero(known & has)
        order = order[np.argsort(user[order], kind="stable")]  # so that what is sought lies together
        user, key = user[order], key[order]
        a, b = entries["a"].fill_null(0.0).to_numpy()[order], lists["b"].fill_null(0.0).to_numpy()
        a_null, b_null = entries["a"].is_null().to_numpy()[order], lists["b"].is_null().to_numpy()
        item = among(ids(lists, "item_id"), items)[0]
        upto, first = np.cumsum(many[key]), 0
        while first < len(order):
            last = max(int(np.searchsorted(upto, (upto[first - 1] if first else 0) + at_once, "right")), first + 1)
            n = many[key[first:last]]
            entry = np.repeat(np.arange(first, last), n)
            at = np.repeat(begin[key[first:last]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place, hit = among(user[entry] * width + item[at], sought)
            place, entry, at = place[hit], entry[hit], at[hit]
            np.add.at(score, place, a[entry] * b[at])
            found[place] = True
            valued[place[~(a_null[entry] | b_null[at])]] = True
            first = last
    of_user, of_item = np.divmod(sought[found], width)
    return pa.table({"user_id": pa.array(users[of_user], entries.schema.field("user_id").type), "item_id": pa.array(items[of_item], lists.schema.field("item_id").type), "score": pa.array(score[found], pa.float64(), mask=~valued[found])})


def for_candidates(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    return scores.join(candidates.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def random_walk(matrix: DataFrame, alpha: float, beta: float, k: int) -> DataFrame:
    """src, dst, weight: the k likeliest items two steps from each item over common users, step probabilities to the power alpha, over popularity to the power beta."""
    size = matrix.groupBy("row").agg(F.sum("value").alias("_s"))
    n = stats.counts(matrix, "col", "_n")
    chances = matrix.join(size, "row").select("row", "col", F.pow(F.col("value") / F.col("_s"), alpha).alias("value"))
    steps = pair_sums(chances, others_only=True, norms=n.select("col", F.col("_n").alias("s")), best=(k, lambda dot, _, si, sj: dot / si**alpha / sj**beta))
    weight = F.col("dot") / F.pow("si", F.lit(alpha)) / F.pow("sj", F.lit(beta))
    return top_k(steps.select(F.col("i").alias("src"), F.col("j").alias("dst"), weight.alias("weight")), k, "src", "dst", "weight")
