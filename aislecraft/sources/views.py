"""Canonical views of the source tables: interactions of users with items in markets, their features, events and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aislecraft.functions.hashing import hash_int
from aislecraft.functions.text import prefixed
from aislecraft.sources.storage import stored

SEED = 42
SOURCES, TARGETS = ["AFRICA", "AMERICA", "ASIA"], ["EUROPE", "MIDDLE EAST"]


class Views:
    """The views of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._split: DataFrame | None = None
        self._written: DataFrame | None = None
        self._scores: DataFrame | None = None
        self._candidates: dict[int, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def raw(self) -> DataFrame:
        """market, user_id, item_id, rating, ord; the customer dimension is joined once and broadcast only if Spark finds it small."""
        people = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", F.col("r_name").alias("market"))
        )
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            "market",
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        )

    def interactions(self) -> DataFrame:
        """market, user_id, item_id, rating: unique on user and item."""
        if self._split is not None:
            return self._split.drop("part")
        if self._written is not None:
            return self._written
        return self.raw().groupBy("market", "user_id", "item_id").agg(F.avg("rating").alias("rating"))

    def written(self) -> DataFrame:
        """Interactions, written once for a query that reads them several times."""
        if self._split is None and self._written is None:
            self._written = stored(self.interactions(), "interactions")
        return self.interactions()

    def sparse(self) -> DataFrame:
        """Interactions of the highest rating: small profiles."""
        return self.interactions().where("rating >= 5")

    def item_features(self) -> DataFrame:
        part = self.table("part")
        words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("word_"), w))
        own = F.array(prefixed("brand", F.col("p_brand")), prefixed("type", F.col("p_type")), prefixed("size", F.col("p_size")))
        return part.select(F.col("p_partkey").alias("item_id"), F.explode(F.array_distinct(F.concat(own, words))).alias("feature"))

    def user_features(self) -> DataFrame:
        own = F.array(prefixed("seg", F.col("c_mktsegment")), prefixed("nation", F.col("c_nationkey")))
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.explode(own).alias("feature"))

    def checkins(self) -> DataFrame:
        return self.table("events").select("user_id", F.get_json_object("props", "$.k").alias("venue"), "ts", "event_type", "value", "event_id")

    def split(self) -> DataFrame:
        """Interactions with `part`: for each user the one of the smallest hash is test, the others train. Written once for a query, which reads it several times."""
        if self._split is not None:
            return self._split
        order = Window.partitionBy("user_id").orderBy(hash_int(SEED, F.lit("loo"), F.col("user_id"), F.col("item_id")), "item_id")
        self._split = stored(self.interactions().withColumn("part", F.when(F.row_number().over(order) == 1, "test").otherwise("train")), "split")
        return self._split

    def train(self) -> DataFrame:
        return self.split().where("part = 'train'").drop("part")

    def test(self) -> DataFrame:
        return self.split().where("part = 'test'").drop("part")

    def candidates(self, n: int = 99) -> DataFrame:
        """user_id, item_id: the test item and n unseen ones of each user. Written once for a query."""
        from aislecraft.operators.negatives import fixed_negatives

        if n in self._candidates:
            return self._candidates[n]
        test = self.test()
        inter = self.interactions()
        users = inter.select("user_id").distinct()
        found = fixed_negatives(users, inter, inter.select("item_id").distinct(), n, SEED).select("user_id", "item_id").union(test.select("user_id", "item_id"))
        self._candidates[n] = stored(found, "candidates")
        return self._candidates[n]

    def scores(self) -> DataFrame:
        """algo, user_id, item_id, score of the candidates by three simple models. Written once for a query."""
        from aislecraft.operators import models

        if self._scores is not None:
            return self._scores
        train, cand = self.train(), self.candidates()
        both = models.top_pop(train, cand).withColumn("algo", F.lit("toppop")).unionByName(models.global_effects(train, cand).withColumn("algo", F.lit("global")))
        both = both.unionByName(models.mean_rating(train, cand).withColumn("algo", F.lit("mean"))).select("algo", "user_id", "item_id", "score")
        self._scores = stored(both, "scores")
        return self._scores

    def factors(self) -> DataFrame:
        """id, vec: of a user or an item of that id."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))

    def ltr(self) -> DataFrame:
        """qid, doc_id, score, rel."""
        joined = self.table("labels").join(self.table("documents"), "doc_id")
        return joined.select(F.col("source").alias("qid"), "doc_id", (F.col("n_chars") / 1000.0).alias("score"), (F.col("quality") + F.col("toxic")).cast("double").alias("rel"))
