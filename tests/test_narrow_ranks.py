"""Ranks and features of large panels: one shuffle a date, narrow sorts, used columns only."""

from datetime import date, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidepanel.catalog import base, rank_queries
from tidepanel.operators import crosssection as xs
from tidepanel.operators import features as ft
from tidepanel.operators.panel import contest_label
from tidepanel.plans.extent import DIRECT_WINDOW_ROWS, Extent, gathered_dates

DAY = date(2024, 1, 2)
SCHEMA = "trade_date date, code string, x double, y double, z double"
BARS = "code string, trade_date date, open double, close double, high double, low double, volume double, amount double, amplitude double, turnover double, is_member boolean, is_tradable boolean, in_signal_range boolean"


def plan_of(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize("columns", [["x"], ["x", "y", "z"]])
def test_ranks_of_a_date_need_one_shuffle(spark, columns):
    df = spark.createDataFrame([(DAY, "a", 1.0, 2.0, 3.0)], SCHEMA)
    plan = plan_of(spark, xs.average_rank(df, columns, Extent(1, 1)))
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Join" not in plan


def test_keys_that_repeat_or_lack_rank_as_before(spark):
    rows = [(DAY, "a", 1.0, 1.0, None), (DAY, "a", 2.0, 0.0, 5.0), (DAY, None, 3.0, 2.0, 6.0), (DAY, "b", 4.0, 3.0, 7.0), (None, "c", 1.0, 1.0, 1.0)]
    got = xs.average_rank(spark.createDataFrame(rows, SCHEMA), ["x", "y", "z"], Extent(2, 4)).collect()
    told = sorted(((r.code or "", r.x, r.y, r.z) for r in got), key=str)
    third = pytest.approx(1 / 3)
    assert told == [("", None, None, None), ("a", 0.5, 0.5, third), ("a", 0.5, 0.5, third), ("b", 1.0, 1.0, 1.0), ("c", None, None, None)]


def test_many_rows_are_dealt_over_enough_tasks(spark):
    df = spark.createDataFrame([(DAY, "a", 1.0, 2.0, 3.0)], SCHEMA)
    assert gathered_dates(df, Extent(357, 1000)) is df
    assert gathered_dates(df, Extent(357, 360_000)).rdd.getNumPartitions() == 77


def test_buckets_of_the_split_plan_do_not_grow_with_the_panel():
    small, large = (rank_queries.split_extent(SimpleNamespace(extent=Extent(357, n))) for n in (1000, 360_000))
    assert small.buckets() == 6 and large.bucket_rows <= DIRECT_WINDOW_ROWS


def panel(spark, codes=30, days=90):
    rows = []
    for i in range(codes):
        for d in range(days):
            c = 10 + (i * 7 + d * 3) % 11 + 0.01 * i
            rows.append((f"{i:06d}", DAY + timedelta(days=d), c, c + 0.5, c + 1, c - 1, 100.0 + (i * d) % 13, 50.0 + (i + d) % 17, 1.0 + (d + i) % 5, 2.0 + (d * i) % 7, (i + d // 9) % 3 > 0, (i + d) % 4 > 0, d > 20))
    return spark.createDataFrame(rows, BARS)


def test_range_is_sorted_before_the_features_widen_the_rows(spark):
    plan = plan_of(spark, ft.baseline24(panel(spark, 2, 5)))
    assert 0 <= plan.index("collect_list(close") < plan.index("_block")


def test_scores_rank_their_factors_only_and_match_the_full_ranks(spark, monkeypatch):
    labels = []
    plain = base.stage
    monkeypatch.setattr(base, "stage", lambda df, label: (labels.append(label), plain(df, label))[1])
    t = base.Tables(spark, "/nowhere")
    market = panel(spark).select("trade_date").distinct().select("trade_date", *[F.lit(0.5).alias(c) for c in ft.MARKET4])
    t.__dict__.update(panel=panel(spark), market=market, extent=Extent(90, 30))
    full = xs.pit_rank(ft.baseline24(contest_label(t.panel, "contest_label")), ft.BASE24, t.extent)
    low = sum((F.col(c) for c in ft.LOW_VOLATILITY), F.lit(0.0)) / len(ft.LOW_VOLATILITY)
    kept = full.where("is_member AND is_tradable AND in_signal_range AND contest_label IS NOT NULL")
    want = {(r.trade_date, r.code): r.s for r in kept.select("trade_date", "code", (0.5 * F.col("ROC60") - low).alias("s")).collect()}
    assert labels == [] and t.features is not None and t.ranked is not None and labels == []
    got = {(r.trade_date, r.code): r.score for r in t.scores.collect()}
    assert got == pytest.approx(want, abs=1e-8) and len(got) > 500
    assert labels == ["factors", "ranked", "scores"]
