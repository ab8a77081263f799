"""Negative sampling by hash draws: the user x item product is never formed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_int, hash_long, hash_uniform
from aislecraft.operators.ingest import dense_ids, prefix_sums
from aislecraft.sources.storage import stored


#: Draws of a round, by the number wanted: a share of it and some more. A second round is only for users whose first falls short.
ROUNDS = ((1.2, 20), (3.0, 50))

#: Draws and seen items of a user that arrays of one row hold; a user of more has a row for each draw. And draws of a task.
HELD, DRAWS = 10_000, 2_000_000


def unseen(drawn: DataFrame, seen: DataFrame) -> DataFrame:
    return drawn.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def sampled(users: DataFrame, seen: DataFrame, locate: Callable[[DataFrame], DataFrame], others: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """user_id, item_id, rn: as many unseen items of each user as its _limit, in the order in which an endless stream of draws meets them.

    users: user_id, _limit and what `locate` needs. locate: gives each draw
    (user_id, k and the users' columns) its item_id; draws of equal items count
    once, so that with weighted draws the items are those of weighted sampling
    without replacement. others: all items (user_id, item_id, _key) of the few
    users whose rounds fell short, because they have seen most of the weight;
    the smallest keys make up what is lacking.
    """
    limits = users.select("user_id", F.col("_limit").cast("long").alias("_limit"))
    found, pending, begin = None, users, F.lit(1).cast("long")
    for share, more in ROUNDS:
        last = F.ceil(F.col("_limit") * share).cast("long") + more
        drawn = locate(pending.select("*", F.explode(F.sequence(begin, last)).alias("k")))
        fresh = unseen(drawn.groupBy("user_id", "item_id").agg(F.min("k").alias("k")), seen)
        if found is None:
            found = stored(fresh, "drawn")
        else:
            found = stored(found.unionByName(fresh).groupBy("user_id", "item_id").agg(F.min("k").alias("k")), "drawn")
        had = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("_had"))
        short = limits.join(had, "user_id", "left").select("user_id", F.coalesce("_had", F.lit(0)).alias("_had")).where("_had < _limit")
        pending, begin = stored(users.join(short, "user_id").drop("_had"), "short"), last + 1
        if pending.isEmpty():
            break
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("k"))
    out = found.withColumn("rn", rn).join(limits, "user_id").where("rn <= _limit").select("user_id", "item_id", "rn")
    if pending.isEmpty():
        return out
    had = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("_had"))
    rest = unseen(unseen(others(pending), seen), found).join(had, "user_id", "left")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("_key", "item_id")) + F.coalesce("_had", F.lit(0))
    return out.unionByName(rest.withColumn("rn", rn).join(limits, "user_id").where("rn <= _limit").select("user_id", "item_id", "rn"))


def fixed_negatives(users: DataFrame, seen: DataFrame, items: DataFrame, n: int, seed: object) -> DataFrame:
    """user_id, item_id, rn: n unseen items of each user, fewer only where a user has seen all others."""
    return limited_negatives(users, seen, items, F.lit(n), seed)


def limited_negatives(users: DataFrame, seen: DataFrame, items: DataFrame, limit: Column, seed: object) -> DataFrame:
    """As many as `limit`, a column of `users`, every unseen item being as likely.

    The draws of a user are an array, from which those seen and those drawn
    before are taken out, so that only what is returned becomes rows. The
    stream of draws and its order are those of `sampled`, which serves the
    users whose arrays would be long or fall short.
    """
    dim = stored(dense_ids(items, "item_id"), "items")
    size = dim.count()
    users = users.withColumn("_limit", limit)

    def locate(drawn: DataFrame) -> DataFrame:
        return drawn.withColumn("idx", hash_int(seed, F.col("user_id"), F.col("k")) % size).join(dim, "idx")

    def others(short: DataFrame) -> DataFrame:
        every = short.select("user_id").crossJoin(dim.select("item_id"))  # of those few users only
        return every.withColumn("_key", hash_int(seed, F.lit("rest"), F.col("user_id"), F.col("item_id")))

    first, last = (F.ceil(F.col("_limit") * share).cast("long") + more for share, more in ROUNDS)
    busy = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HELD).select("user_id")
    long = stored(users.where(last > HELD).select("user_id").union(busy).distinct(), "long")
    known = seen.join(long, "user_id", "left_anti").join(dim, "item_id").groupBy("user_id").agg(F.collect_list("idx").alias("_seen"))
    each = users.join(long, "user_id", "left_anti").join(known, "user_id", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<long>")))
    tasks = max(seen.sparkSession.sparkContext.defaultParallelism, (users.where(last <= HELD).agg(F.sum(first)).first()[0] or 0) // DRAWS + 1)
    fresh = lambda n: F.slice(F.array_except(F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: hash_int(seed, F.col("user_id"), k) % size), "_seen"), F.lit(1), F.col("_limit").cast("int"))
    drawn = each.repartition(int(tasks), "user_id").withColumn("_found", fresh(first))
    drawn = drawn.withColumn("_found", F.when(F.size("_found") < F.col("_limit"), fresh(last)).otherwise(F.col("_found"))).drop("_seen")
    drawn = stored(drawn, "drawn")
    out = drawn.where(F.size("_found") >= F.col("_limit")).select("user_id", F.posexplode("_found").alias("rn", "idx")).join(dim, "idx").select("user_id", "item_id", (F.col("rn") + 1).alias("rn"))
    rest = users.join(long, "user_id", "left_semi").unionByName(drawn.where(F.size("_found") < F.col("_limit")).drop("_found"))
    rest = stored(rest, "rest")
    return out if rest.isEmpty() else out.unionByName(sampled(rest, seen, locate, others))


def _ranges(sums: DataFrame, width: str, *keys: str) -> DataFrame:
    """Rows [start, end) of prefix sums for each bucket of `width` that they reach into: no more than rows and buckets together."""
    return sums.select("*", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}"))).alias("bucket")).select(*keys, "bucket", "item_id", "start", "end")


def _exponential(seed: object, weight: Column) -> Column:
    """Keys whose order is that of weighted sampling without replacement."""
    return -F.log(hash_uniform(seed, F.lit("rest"), F.col("user_id"), F.col("item_id")) + 2.0**-33) / weight


def by_popularity(weights: DataFrame, seed: object) -> Callable[[DataFrame], DataFrame]:
    """A `locate` of `sampled`: items drawn by their whole-numbered weight (item_id, weight) from one table of prefix sums."""
    sums = stored(prefix_sums(weights.where("weight > 0").select("item_id", F.col("weight").cast("long").alias("weight")), "weight", F.col("item_id").asc()), "sums")
    n, total = sums.agg(F.count(F.lit(1)), F.max("end")).first()
    width = -(-(total or 1) // max(n, 1))
    ranges = _ranges(sums, str(width))

    def locate(drawn: DataFrame) -> DataFrame:
        at = drawn.withColumn("at", hash_long(seed, F.col("user_id"), F.col("k")) % (total or 1))
        return at.withColumn("bucket", F.expr(f"at div {width}")).join(ranges, "bucket").where("at >= start and at < end")

    return locate


def popularity_negatives(users: DataFrame, seen: DataFrame, weights: DataFrame, n: int, seed: object) -> DataFrame:
    """user_id, item_id, rn: n unseen items of each user, drawn by weight (item_id, weight) over the whole catalogue without replacement; items without weight are never drawn."""

    def others(short: DataFrame) -> DataFrame:
        every = short.select("user_id").crossJoin(weights.where("weight > 0"))  # of those few users only
        return every.select("user_id", "item_id", _exponential(seed, F.col("weight")).alias("_key"))

    return sampled(users.withColumn("_limit", F.lit(n)), seen, by_popularity(weights, seed), others)


def by_companions(companions: DataFrame, items: DataFrame, seed: object) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """A `locate` of `sampled` for users with an `anchor` item: item j is drawn with weight 1 + n of (anchor, item_id, n), over all `items`; and their number.

    A draw below the anchor's sum of n falls into its own prefix sums, any other is as likely for every item.
    """
    order = Window.partitionBy("anchor").orderBy("item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most all items of an anchor
    sums = companions.where("n > 0").withColumn("end", F.sum(F.col("n").cast("long")).over(order)).withColumn("start", F.col("end") - F.col("n"))
    sums = stored(sums.select("anchor", "item_id", "start", "end"), "sums")
    totals = stored(sums.groupBy("anchor").agg(F.max("end").alias("total"), F.count(F.lit(1)).alias("_n")).withColumn("width", F.ceil(F.col("total") / F.col("_n"))).drop("_n"), "totals")
    ranges = _ranges(sums.join(totals, "anchor"), "width", "anchor")
    dim = stored(dense_ids(items, "item_id"), "items")
    size = dim.count()

    def locate(drawn: DataFrame) -> DataFrame:
        known = drawn.join(totals, "anchor", "left").withColumn("total", F.coalesce("total", F.lit(0)))
        at = known.withColumn("at", hash_long(seed, F.col("user_id"), F.col("k")) % (F.col("total") + size))
        near = at.where("at < total").withColumn("bucket", F.expr("at div width")).join(ranges, ["anchor", "bucket"]).where("at >= start and at < end")
        far = at.where("at >= total").withColumn("idx", F.col("at") - F.col("total")).join(dim, "idx")
        return near.select("user_id", "item_id", "k").unionByName(far.select("user_id", "item_id", "k"))

    return locate, size


def competitor_negatives(users: DataFrame, seen: DataFrame, companions: DataFrame, items: DataFrame, n: int, seed: object) -> DataFrame:
    """user_id, item_id, rn: n unseen items of each user (user_id, anchor), drawn without replacement over the whole catalogue by 1 + how often they are found with the user's anchor item."""

    def others(short: DataFrame) -> DataFrame:
        every = short.select("user_id", "anchor").crossJoin(items.select("item_id").distinct())  # of those few users only
        weighted = every.join(companions.select("anchor", "item_id", "n"), ["anchor", "item_id"], "left")
        return weighted.select("user_id", "item_id", _exponential(seed, F.coalesce("n", F.lit(0)) + 1).alias("_key"))

    locate, _ = by_companions(companions, items, seed)
    return sampled(users.withColumn("_limit", F.lit(n)), seen, locate, others)


def from_recommenders(scores: DataFrame, seen: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """user_id, item_id, rank: of each recommender's unseen items the best of its quota, each item once."""
    order = Window.partitionBy("algo", "user_id").orderBy(F.desc(F.round("score", 9)), "item_id")
    quota = F.lit(0)
    for algo, n in quotas.items():
        quota = F.when(F.col("algo") == algo, n).otherwise(quota)
    ranked = unseen(scores, seen).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)
    return ranked.groupBy("user_id", "item_id").agg(F.min("rank").alias("rank"))


def bpr_triples(positives: DataFrame, seen: DataFrame, dim: DataFrame, seed: object) -> DataFrame:
    """user_id, pos, neg: one hash draw for each positive row; draws that the user has seen go."""
    size = dim.agg(F.count(F.lit(1)).alias("_n"))
    drawn = positives.crossJoin(F.broadcast(size)).select("user_id", F.col("item_id").alias("pos"), (hash_int(seed, F.col("user_id"), F.col("item_id")) % F.col("_n")).alias("idx"))  # one row
    return unseen(drawn.join(dim, "idx").select("user_id", "pos", "item_id"), seen).select("user_id", "pos", F.col("item_id").alias("neg"))


def zero_pairs(matrix: DataFrame, dim: DataFrame, draws_each: int, seed: object) -> DataFrame:
    """i, j: drawn pairs of different columns of `matrix` (row, col) that have no row in common; only the drawn pairs are looked up."""
    size = dim.agg(F.count(F.lit(1)).alias("_n"))
    k = F.explode(F.sequence(F.lit(1), F.lit(draws_each))).alias("k")
    drawn = dim.select(F.col("item_id").alias("i"), k).crossJoin(F.broadcast(size))  # one row
    found = drawn.select("i", (hash_int(seed, F.col("i"), F.col("k")) % F.col("_n")).alias("idx")).join(dim, "idx").select("i", F.col("item_id").alias("j")).where("i <> j").distinct()
    found = stored(found, "pairs")
    rows = matrix.select("row", F.col("col").alias("i"))
    common = found.join(rows, "i").join(rows.withColumnRenamed("i", "j"), ["row", "j"], "left_semi").select("i", "j")
    return found.join(common, ["i", "j"], "left_anti")


def several_sets(users: DataFrame, seen: DataFrame, items: DataFrame, n: int, seeds: list) -> DataFrame:
    """negset, user_id, item_id, rn: an independent set for each seed."""
    out = None
    for s in seeds:
        one = fixed_negatives(users, seen, items, n, s).select(F.lit(s).cast("long").alias("negset"), "user_id", "item_id", "rn")
        out = one if out is None else out.unionByName(one)
    return out
