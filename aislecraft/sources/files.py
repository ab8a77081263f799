"""Delimited, JSON and score files: readers and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS = "user_id string, item_id string, rating double"


def read_interactions(spark: SparkSession, path: str | list[str], sep: str = "\t", header: bool = True, schema: str = RATINGS, columns: list[str] | None = None) -> DataFrame:
    """Delimited ratings; the separator may have several characters, and files may be gzipped."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=header)
    return df.select(*columns) if columns else df


def train_with_threshold(ratings: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Ratings from `threshold` on."""
    return ratings.where(F.col("rating") >= threshold)


def known_ids(ratings: DataFrame) -> DataFrame:
    """axis, id of all users and items, below-threshold rows included."""
    pick = lambda c, axis: ratings.select(F.lit(axis).alias("axis"), F.col(c).alias("id"))
    return pick("user_id", "user").union(pick("item_id", "item")).distinct()


def with_constant_rating(ratings: DataFrame, rating: float = 4.0) -> DataFrame:
    return ratings.withColumn("rating", F.lit(rating))


def first_per_user(rows: DataFrame, order: Column) -> DataFrame:
    """The first row of each user by an explicit order."""
    names = [c for c in rows.columns if c != "user_id"]
    first = F.min_by(F.struct(*names), order)
    return rows.groupBy("user_id").agg(first.alias("_f")).select("user_id", *[F.col(f"_f.{c}").alias(c) for c in names])


def run_lists(rows: DataFrame, column: str = "items") -> DataFrame:
    """Candidates of comma-joined lists: user_id, item_id."""
    return rows.select("user_id", F.explode(F.split(column, ",")).alias("item_id")).withColumn("item_id", F.trim("item_id")).where("item_id <> ''")


def read_json_interactions(spark: SparkSession, path: str, user: str, item: str, rating: str) -> DataFrame:
    """JSON lines; lines that are no JSON, or lack one of the three, are left out."""
    schema = f"{user} string, {item} string, {rating} double"
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return df.select(F.col(user).alias("user_id"), F.col(item).alias("item_id"), F.col(rating).alias("rating")).na.drop()


def write_scores(scores: DataFrame, path: str, user_prefix: str = "", compress: bool = True) -> None:
    """userId, itemId, score with twelve decimals, tab-separated with header."""
    out = scores.select(F.concat(F.lit(user_prefix), F.col("user_id").cast("string")).alias("userId"), F.col("item_id").cast("string").alias("itemId"), F.format_string("%.12f", F.col("score").cast("double")).alias("score"))
    out.write.csv(path, sep="\t", header=True, compression="gzip" if compress else "none")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id string, item_id string, score double").csv(path, sep="\t", header=True)


def unknown_ids(scores: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose id isn't among `known`: must be empty."""
    return scores.join(known.select(column).distinct(), column, "left_anti")


def write_matrix(rows: DataFrame, path: str) -> None:
    """Coordinate export: row, col, data."""
    rows.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("data")).write.csv(path, header=True)


def save_parts(rows: DataFrame, path: str, by: list[str]) -> None:
    """A table partitioned by its split columns; an existing one stays."""
    rows.write.mode("ignore").partitionBy(*by).parquet(path)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end at `path`."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def kept_frame(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The feature frame at `path`, as gzip Parquet; made and written only where it isn't there whole."""
    if not is_whole(spark, path):
        make().write.mode("overwrite").parquet(path, compression="gzip")
    return spark.read.parquet(path)


def longest_cached(spark: SparkSession, root: str, steps: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The table of the longest prefix of `steps` that is stored under `root`, and the steps that are left."""
    for n in range(len(steps), 0, -1):
        if is_whole(spark, f"{root}/{'/'.join(steps[:n])}"):
            return spark.read.parquet(f"{root}/{'/'.join(steps[:n])}"), steps[n:]
    return None, list(steps)


def submission(scores: DataFrame, markets: list[str], splits: list[str]) -> DataFrame:
    """The score rows of the target markets' splits, as one table."""
    return scores.where(F.col("market").isin(markets) & F.col("split").isin(splits))
