"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislecraft.plans.sql import with_views
from aislecraft.sources.storage import ship
from aislecraft.sources.views import Views

#: Compressed bytes of a shuffle that go to one task: ids take some twenty times as much memory where they are sorted or summed.
ADVISORY = "16m"

#: Parts that a shuffle is written in at least; adaptive execution joins small ones up to ADVISORY, but can't divide a part that is larger.
LEAST_PARTS = 480

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str) -> Callable:
    """Register a function of Views under `name`, with the SQL that DuckDB answers alike; doubles are rounded to six places in both."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISORY)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
            ship(spark)
            return rounded(f(Views(spark, sf_dir)))

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql, **views)
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places without negative zeros; integers as long."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in df.columns])
