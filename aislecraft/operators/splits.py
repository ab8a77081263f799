"""Samples, splits and folds by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_int, hash_uniform
from aislecraft.operators.ingest import places


def sample_ids(rows: DataFrame, column: str, quota: float, seed: object) -> DataFrame:
    """Rows of a share of the ids: int(n * (1 - quota)) ids with the largest hashes go. One count reaches the driver."""
    ids = rows.select(column).distinct()
    n = ids.count()
    keep = ids.orderBy(hash_int(seed, F.col(column)), column).limit(n - int(round(n * (1 - quota), 9)))
    return rows.join(keep, column, "left_semi").select(*rows.columns)


def _warm(rows: DataFrame, allow_cold: bool) -> DataFrame:
    if allow_cold:
        return rows
    return rows.join(rows.where("part = 'train'").select("user_id").distinct(), "user_id", "left_semi")


def holdout(inter: DataFrame, train: float, valid: float, seed: object, threshold: float = 0.0, allow_cold: bool = False, by_item: bool = False) -> DataFrame:
    """`part` by probability, of rows or of whole items; outside train only ratings above the threshold stay, and users without train rows go."""
    keys = [F.col("item_id")] if by_item else [F.col("user_id"), F.col("item_id")]
    u = hash_uniform(seed, *keys)
    part = F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test")
    rows = inter.withColumn("part", part).where((F.col("part") == "train") | (F.col("rating") > threshold))
    return _warm(rows, allow_cold).select(*inter.columns, "part")


def leave_k_out(inter: DataFrame, k: int, seed: object, threshold: float = 0.0, with_valid: bool = True) -> DataFrame:
    """k test rows (and k validation rows) of each user among ratings above the threshold; users with too few of them go."""
    need = 2 * k if with_valid else k
    good = F.col("rating") > threshold
    order = Window.partitionBy("user_id", "_good").orderBy(hash_int(seed, F.col("user_id"), F.col("item_id")), "item_id")
    marked = inter.withColumn("_good", good).withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.when(good, 1)).over(Window.partitionBy("user_id")))
    part = F.when(F.col("_good") & (F.col("_r") <= k), "test").when(F.col("_good") & (F.col("_r") <= need), "valid").otherwise("train")
    return marked.where(F.col("_n") >= need).withColumn("part", part).select(*inter.columns, "part")


def kfold(rows: DataFrame, k: int, seed: object, *keys: str) -> DataFrame:
    """`fold` by the hash of the keys; a fold's train rows are those of the others."""
    return rows.withColumn("fold", hash_int(seed, *[F.col(c) for c in keys]) % k)


def group_kfold(rows: DataFrame, k: int, seed: object, column: str = "user_id") -> DataFrame:
    """column, fold: folds of near-equal size, by the place in the order of the hashes."""
    ordered = rows.select(column).distinct().withColumn("_h", hash_int(seed, F.col(column)))
    return places(ordered, F.col("_h"), F.col(column)).select(column, (F.col("place") % k).alias("fold"))


def double_group_kfold(rows: DataFrame, k: int, seeds: tuple[object, object]) -> DataFrame:
    a, b = (group_kfold(rows, k, s).withColumn("round", F.lit(n).cast("long")) for n, s in enumerate(seeds))
    return a.unionByName(b)


def balanced_limit(n_items: int, n: Column) -> Column:
    return F.greatest(F.lit(1), F.round((F.lit(n_items) - n) / n)).cast("long")
