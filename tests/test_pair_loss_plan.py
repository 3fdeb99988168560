"""Pair losses of large panels: dates dealt over enough tasks, levels as a group needs them."""

from datetime import date
from math import exp, log1p

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import losses as ls
from tidepanel.plans import extent
from tidepanel.plans.extent import Extent, gathered_dates

SCHEMA = "trade_date date, code string, score double, relevance double, pair_weight double, is_head boolean"
LARGE = Extent(357, 60_000)


def scored(spark):
    """Two dates; ties in relevance and score, a row that comes twice, a date of one name."""
    rows = []
    for i in range(21):
        head = i % 7 == 6
        rows.append((date(2024, 1, 2), f"c{i % 20:02}", (i * 8 % 11) / 3.0, float(i % 7), 2.0 if head else 1.0, head))
    rows.append((date(2024, 1, 9), "c00", 1.0, 1.0, 2.0, True))
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    pairs = [(a, b) for a in rows for b in rows if a.relevance > b.relevance]
    loss = [log1p(exp(b.score - a.score)) for a, b in pairs]
    heads = [x for x, (a, b) in zip(loss, pairs) if a.is_head and not b.is_head]
    heavy = sum(x * (a.pair_weight + b.pair_weight) for x, (a, b) in zip(loss, pairs))
    mean = lambda total, n: total / n if n else 0.0
    return len(pairs), mean(heavy, len(pairs)), mean(sum(loss), len(pairs)), mean(sum(heads), len(heads))


def test_dealt_rows_give_the_losses_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(extent, "TASK_BYTES", 1 << 16)  # 7 tasks for these few rows
    rows = scored(spark)
    wanted = {d: brute(rows.where(F.col("trade_date") == d).collect()) for d in (date(2024, 1, 2), date(2024, 1, 9))}
    got = {r.trade_date: (r.n_pairs, r.pairwise_loss, r.global_loss, r.head_loss) for r in ls.pairwise_losses(rows, Extent(40, 21)).collect()}
    assert set(got) == set(wanted)
    for day, told in wanted.items():
        assert got[day] == pytest.approx(told, rel=1e-9)


def test_rows_of_large_panels_are_dealt_by_their_levels(spark):
    rows = scored(spark)
    # 16 levels of 357 x 60,000 rows of 6 fields need 246 tasks, which adaptive execution leaves apart.
    assert gathered_dates(rows, LARGE, 16).rdd.getNumPartitions() == 246
    plan = ls.pairwise_losses(rows, LARGE)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [trade_date" in plan
    # One tree serves the losses and the crossings of all pairs; two more those of groups.
    assert plan.count("Generate explode") == 3
    assert gathered_dates(rows, Extent(2, 21), 5) is rows


def test_a_group_has_the_levels_of_its_size(spark):
    few = Extent(2, 21)
    sides = ls._halved(ls._sized(scored(spark), ["trade_date"], few), ["trade_date"], few)
    # 21 names have five levels, the date of one name has no pair.
    told = sides.groupBy("trade_date").agg(F.max("_level").alias("most")).collect()
    assert [tuple(r) for r in told] == [(date(2024, 1, 2), 4)]
