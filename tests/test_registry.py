import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from aislecraft.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(f"{r[k] + 0.0:.5f}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def answers(spark, request):
    """The selected queries' columns and rows, four queries at a time."""

    def ask(name):
        df = registry.queries()[name](spark, SMALL)
        return df.columns, [tuple(r) for r in df.collect()]

    names = [x.callspec.params["name"] for x in request.session.items if getattr(x, "originalname", "") == "test_query_equals_sql"]
    pool = ThreadPoolExecutor(4)
    yield {name: pool.submit(ask, name) for name in names}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(duck, answers, name):
    columns, rows = answers[name].result()
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(columns) == sorted(want.columns)
    assert plain(rows, columns) == plain(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    rows = registry.entry(spark, SMALL).collect()
    assert len(rows) == 5 and all(0 <= r["ndcg"] <= 1 for r in rows)


def test_no_cross_products_but_with_one_row(spark):
    """Plans of the headline queries have no Cartesian product."""
    for name in ("sim_cosine", "score_item_knn", "eval_ndcg", "topk_candidates"):
        plan = registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_results_do_not_depend_on_partitions(spark):
    take = lambda: sorted(map(tuple, registry.queries()["negatives_fixed"](spark, SMALL).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = take()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert take() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_read_small_shares_of_shuffles(spark):
    registry.queries()["dedup_last"](spark, SMALL)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("16m", "16777216b", "16777216")


def test_a_task_takes_no_more_for_few_partitions(spark):
    """However few shuffle partitions a session has, a large shuffle is read in parts of the advisory size."""
    from pyspark.sql import functions as F

    from aislecraft.plans import base

    base.QUERIES["interactions_scan"](spark, "/root/testdata/sf0.001")
    sums = spark.range(8_000_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert sums.groupBy(F.spark_partition_id()).count().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ratios_of_all_metrics(spark):
    """All five metrics have a ratio; that of novelty is the mean over lists of ten over the mean over profiles, of users without one, too."""
    from aislecraft.operators import metrics

    found = {r["metric"]: r["value"] for r in registry.queries()["eval_ratio"](spark, SMALL).collect()}
    assert found.keys() == {"shannon", "herfindahl", "gini", "novelty", "avg_popularity"} and all(x > 0 for x in found.values())
    profiles = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "user_id long, item_id long")
    pop = spark.createDataFrame([(5, 1), (6, 1)], "item_id long, n long")
    assert metrics.novelty(profiles, pop).first()[0] == 0.5 and metrics.average_popularity(profiles, pop).first()[0] == 0.5
