import random

from pyspark.sql import functions as F

from tidepanel.operators import crosssection as xs
from tidepanel.plans import ordering
from tidepanel.plans.extent import Extent

SCHEMA = "trade_date int, code string, x double, is_member boolean, is_tradable boolean"


def panel(spark, n=4000):
    rng = random.Random(2)
    pick = lambda: rng.choice([0.0, 0.0, 0.0, None, rng.random(), rng.random()])
    rows = [(d, f"{i:06d}", pick(), rng.random() < 0.9, True) for d in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def ranks(df, extent, fn):
    return {(r.trade_date, r.code): r.x for r in fn(df, ["x"], extent).select("trade_date", "code", "x").collect()}


def test_half_of_a_date_on_one_value_ranks_alike(spark):
    df = panel(spark)
    for fn in (xs.pit_rank, xs.average_rank):
        assert ranks(df, Extent(2, 4000, task_rows=100, bucket_rows=500), fn) == ranks(df, Extent(2, 4000), fn)


def test_rows_of_a_hot_value_and_of_none_are_dealt_over_tasks(spark):
    df = panel(spark).select("trade_date", "x")
    sizes = df.where("x is not null").groupBy("trade_date", "x").agg(F.count("*").alias(ordering.ROWS))
    levels = sizes.withColumn("n", F.col(ordering.ROWS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = ordering.join_levels(df, levels, sizes, ["trade_date", "x"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        tasks = joined.withColumn("task", F.spark_partition_id()).groupBy("x", "task").count().collect()
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert f"{ordering.SALT}" in plan and "BroadcastHashJoin" in plan
    for value in (0.0, None):
        counts = [r["count"] for r in tasks if r.x == value]
        assert len(counts) >= 8 and max(counts) < sum(counts) / 3
    wrong = joined.where((F.col("n").isNull()) != F.col("x").isNull()).count()
    assert wrong == 0 and joined.count() == df.count()
