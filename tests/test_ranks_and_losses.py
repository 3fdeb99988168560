import math
from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import crosssection as xs
from tidepanel.operators import evaluation as ev
from tidepanel.operators import losses as ls
from tidepanel.operators import rerank as rr
from tidepanel.plans.extent import Extent
from tidepanel.schemas import DataContractError

DAY = date(2024, 1, 2)


def cross_section(n=240, seed=3, dates=2):
    """A third of the values of every date are one and the same number."""
    rng = np.random.default_rng(seed)
    frames = []
    for i in range(dates):
        x = rng.normal(size=n).round(2)
        x[: n // 3] = 0.25
        frames.append(
            pd.DataFrame(
                {
                    "trade_date": date(2024, 1, 2 + i),
                    "code": [f"{j:06d}" for j in range(n)],
                    "x": x,
                    "y": rng.normal(size=n),
                    "z": rng.integers(0, 9, size=n).astype(float),
                    "is_member": rng.random(n) < 0.7,
                    "is_tradable": rng.random(n) < 0.9,
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def both_ways(df):
    direct = Extent.measure(df)
    return direct, replace(direct, task_rows=1, bucket_rows=50)


def test_pit_rank_of_a_non_member(spark):
    df = spark.createDataFrame(
        [(DAY, "a", 10.0, True, True), (DAY, "b", 20.0, True, True), (DAY, "c", 1000.0, False, False)],
        "trade_date date, code string, x double, is_member boolean, is_tradable boolean",
    )
    got = xs.pit_rank(df, ["x"], Extent(1, 3)).orderBy("code").collect()
    assert [r.x for r in got] == [0.5, 1.0, 1.0]


@pytest.mark.parametrize("columns", [["x"], ["x", "y", "z"]])
def test_pit_rank_against_counting_both_ways(spark, columns):
    pdf = cross_section()
    df = spark.createDataFrame(pdf)
    wanted = {}
    for day, g in pdf.groupby("trade_date"):
        ref = g[g.is_member & g.is_tradable]
        for _, r in g.iterrows():
            wanted[(day, r.code)] = [(ref[c] <= r[c]).mean() for c in columns]
    for extent in both_ways(df):
        got = xs.pit_rank(df, columns, extent).collect()
        assert len(got) == len(pdf)
        for r in got:
            assert [r[c] for c in columns] == pytest.approx(wanted[(r.trade_date, r.code)])


def test_average_rank_both_ways_and_directions(spark):
    pdf = cross_section()
    df = spark.createDataFrame(pdf)
    up = pdf.groupby("trade_date").x.rank(pct=True)
    down = pdf.groupby("trade_date").z.rank(pct=True, ascending=False)
    wanted = {k: (a, b) for k, a, b in zip(zip(pdf.trade_date, pdf.code), up, down)}
    for extent in both_ways(df):
        for r in xs.average_rank(df, ["x", "y", "z"], extent, descending=["z"]).collect():
            assert (r.x, r.z) == pytest.approx(wanted[(r.trade_date, r.code)])


def test_missing_values_take_no_part(spark):
    df = spark.createDataFrame(
        [(DAY, "a", 1.0), (DAY, "b", None), (DAY, "c", 3.0)], "trade_date date, code string, x double"
    )
    for extent in both_ways(df):
        got = {r.code: r.x for r in xs.average_rank(df, ["x"], extent).collect()}
        assert got == {"a": 0.5, "b": None, "c": 1.0}


def test_positions_both_ways(spark):
    pdf = cross_section()
    df = spark.createDataFrame(pdf).withColumn("score", F.col("x"))
    a, b = (
        {(r.trade_date, r.code): r.raw_rank for r in xs.score_order(df, e).collect()}
        for e in both_ways(df)
    )
    assert a == b and sorted(v for (d, _), v in a.items() if d == DAY) == list(range(1, 241))


def test_relevance_ties_and_refusal(spark):
    df = spark.createDataFrame(
        [(DAY, "a", 0.10), (DAY, "b", 0.10), (DAY, "c", 0.05)], "trade_date date, code string, label double"
    )
    got = {r.code: r.relevance for r in xs.relevance(df, Extent(1, 3)).collect()}
    assert got == {"a": 2.5, "b": 2.5, "c": 1.0}
    with pytest.raises(DataContractError):
        xs.relevance(df.withColumn("label", F.lit(float("nan"))), Extent(1, 3), check=True)


def scores(spark, score, label, dates=1):
    rows = [
        (date(2024, 1, 2 + d), f"{i:06d}", float(s), float(y))
        for d in range(dates)
        for i, (s, y) in enumerate(zip(score, label))
    ]
    return spark.createDataFrame(rows, "trade_date date, code string, score double, label double")


def test_selection_of_five(spark):
    df = scores(spark, [5, 4, 3, 2, 1], [0.10, 0.05, 0.0, -0.05, -0.10])
    row = ev.top_k_returns(df).first()
    assert row.top5_return == pytest.approx(0) and row.top5_excess_return == pytest.approx(0)
    with pytest.raises(DataContractError):
        xs.top_k_portfolio(scores(spark, [1, 2], [0, 0]))


def test_rank_ic_of_a_constant(spark):
    df = scores(spark, [1.0] * 12, range(12))
    assert ev.daily_rank_ic(df, Extent(1, 12)).first().rank_ic == 0.0
    assert ev.daily_rank_ic(df, Extent(1, 12), constant_as_zero=False).count() == 0


def test_head_quality_against_sorting(spark):
    rng = np.random.default_rng(1)
    s, y = rng.normal(size=30), rng.normal(size=30)
    row = ev.head_quality(scores(spark, s, y), Extent(1, 30)).first()
    gain = np.empty(30)
    gain[np.argsort(y)] = np.linspace(0, 1, 30)
    discount = 1 / np.log2(np.arange(2, 7))
    top = np.argsort(s)[-5:][::-1]
    assert row.ndcg_at_5 == pytest.approx((gain[top] * discount).sum() / (np.sort(gain)[-5:][::-1] * discount).sum())
    assert row.top5_true_percentile == pytest.approx(gain[top].mean())


def brute(s, r, w, head):
    total = weighted = headed = 0.0
    n = heads = 0
    for i in range(len(s)):
        for j in range(len(s)):
            if r[i] > r[j]:
                loss = np.logaddexp(0, s[j] - s[i])
                total, weighted, n = total + loss, weighted + loss * (w[i] + w[j]), n + 1
                if head[i] and not head[j]:
                    headed, heads = headed + loss, heads + 1
    return weighted / n, total / n, headed / heads


@pytest.mark.parametrize("spread", [0.3, 50.0])
def test_pairwise_losses_against_all_pairs(spark, spread):
    rng = np.random.default_rng(5)
    s, y = rng.normal(size=60) * spread, rng.integers(0, 20, size=60) / 10
    df = scores(spark, s, y)
    for extent in both_ways(df):
        rows = ls.top_weights(xs.relevance(df, extent), extent)
        got = ls.pairwise_losses(rows, extent).first()
        pdf = rows.toPandas()
        wanted = brute(pdf.score.values, pdf.relevance.values, pdf.pair_weight.values, pdf.is_head.values)
        assert (got.pairwise_loss, got.global_loss, got.head_loss) == pytest.approx(wanted, rel=1e-9)


def test_one_outlier_among_close_scores(spark):
    s, y = np.append(np.linspace(-0.1, 0.1, 40), 1e6), np.arange(41) % 7 / 10
    df = scores(spark, s, y)
    for extent in both_ways(df):
        rows = ls.top_weights(xs.relevance(df, extent), extent)
        got, pdf = ls.pairwise_losses(rows, extent).first(), rows.toPandas()
        wanted = brute(pdf.score.values, pdf.relevance.values, pdf.pair_weight.values, pdf.is_head.values)
        assert (got.pairwise_loss, got.global_loss, got.head_loss) == pytest.approx(wanted, rel=1e-9)


def test_pairwise_loss_without_pairs(spark):
    df = scores(spark, [1, 2, 3], [0, 0, 0])
    rows = ls.top_weights(xs.relevance(df, Extent(1, 3)), Extent(1, 3))
    got = ls.pairwise_losses(rows, Extent(1, 3)).first()
    assert (got.n_pairs, got.pairwise_loss, got.head_loss) == (0, 0.0, 0.0)


def test_targets_sum_to_one_and_ties_are_uniform(spark):
    df = scores(spark, [1, 2, 3, 4], [1, 1, 1, 1], dates=2)
    rel = xs.relevance(df, Extent(2, 4))
    for kind in ls.TARGETS:
        got = ls.target_distribution(rel, Extent(2, 4), kind).collect()
        assert all(r.target_prob == pytest.approx(0.25) for r in got)


def test_penalties(spark):
    down = scores(spark, [4, 3, 2, 1], [1, 2, 3, 4])
    rel = xs.relevance(down, Extent(1, 4))
    assert ls.stability_penalty(rel).first().stability_penalty == pytest.approx(1.0)
    up = xs.relevance(scores(spark, [1, 2, 3, 4], [1, 2, 3, 4]), Extent(1, 4))
    assert ls.stability_penalty(up).first().stability_penalty == 0.0
    flat = up.withColumn("shortcut_index", F.lit(1.0))
    assert ls.shortcut_penalty(flat).first().shortcut_penalty == 0.0


def factor_rows(spark, n=20):
    rng = np.random.default_rng(2)
    rows = [
        (DAY, f"{i:06d}", float(rng.normal()), *map(float, rng.normal(size=len(rr.FACTORS))))
        for i in range(n)
    ]
    cols = ", ".join(f"{c} double" for c in rr.FACTORS)
    return spark.createDataFrame(rows, f"trade_date date, code string, score double, {cols}")


def test_rerank_rolls_back_when_inactive(spark):
    df, e = factor_rows(spark), Extent(1, 20)
    off = rr.blend_rerank(df, F.lit(False), 0.5, e).collect()
    assert all(r.original_rank == r.final_rank for r in off)
    on = rr.blend_rerank(df, F.lit(True), 1.0, e).orderBy("final_rank").collect()
    assert [r.family_rank_pct for r in on] == sorted((r.family_rank_pct for r in on), reverse=True)
    manifest = rr.selection_manifest(rr.blend_rerank(df, F.lit(False), 0.5, e)).first()
    assert manifest.rollback_active and manifest.top5_overlap == 5 and len(manifest.audit_sha256) == 64


def test_pool_rerank_moves_only_the_pool(spark):
    got = rr.pool_rerank(factor_rows(spark), F.lit(True), Extent(1, 20)).collect()
    assert all((r.original_rank <= 15) == (r.final_rank <= 15) for r in got)
    assert all(r.original_rank == r.final_rank for r in got if r.original_rank > 15)
    with pytest.raises(DataContractError):
        rr.pool_rerank(factor_rows(spark, 10), F.lit(True), Extent(1, 10))


def test_early_stop(spark):
    metric = [1.0, 3.0, 2.0, 3.0, 2.0, 9.0]
    log = spark.createDataFrame([("r", i + 1, m) for i, m in enumerate(metric)], "run string, epoch int, metric double")
    got = ev.early_stop(log, patience=3).first()
    assert (got.best_epoch, got.best_metric, got.last_epoch, got.stopped_early) == (2, 3.0, 5, True)


def test_stability_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "config string, score double")
    got = {r.config: r.stability_score for r in ev.stability_score(df).collect()}
    assert got == {"a": 1.5, "b": -math.inf}
    assert ev.best_config(ev.stability_score(df)).first().config == "a"
