"""Warm-up fill, staging, and the gate in front of a data set."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import features as ft
from tidepanel.operators import market as mk
from tidepanel.operators import panel as pn
from tidepanel.operators import quality
from tidepanel.operators import rerank as rr
from tidepanel.operators.calendar import trading_calendar
from tidepanel.plans.staging import _local_folder
from tidepanel.schemas import DataContractError
from tidepanel.sources.readers import checksum_manifest
from tidepanel.streaming import upsert
from tidepanel.streaming.commit_log import CommitLog

DAY = date(2020, 1, 6)


def test_market_warm_up_counts_as_zero_in_the_fit(spark):
    n = 70
    moves = [0.01 * (i % 5 - 2) for i in range(n)]
    rows = [(DAY + timedelta(i), "000001", 100.0 * m, True, True) for i, m in enumerate(moves)]
    panel = spark.createDataFrame(rows, "trade_date date, code string, pct_chg double, is_member boolean, is_tradable boolean")
    filled = ft.fill_market(mk.add_market4(panel))
    assert filled.where(F.col("market_drawdown_60").isNull()).count() == 0
    center, scale = mk.fit_market_stress(filled, F.lit(True))
    growth = 1 + np.array(moves)
    want = [np.prod(growth[i - 19 : i + 1]) - 1 if i >= 19 else 0.0 for i in range(n)]
    assert center["market_return_20"] == pytest.approx(np.mean(want))
    assert scale["market_return_20"] == pytest.approx(np.std(want))
    wealth = np.cumprod(growth)
    low = [wealth[i] / wealth[i - 59 : i + 1].max() - 1 if i >= 59 else 0.0 for i in range(n)]
    assert center["market_drawdown_60"] == pytest.approx(np.mean(low))


def test_code_without_a_bar_on_the_calendar_is_listed(spark):
    days = [date(2020, 1, 6), date(2020, 1, 7), date(2020, 1, 8)]
    calendar = trading_calendar(spark.createDataFrame([(d,) for d in days], "trade_date date"))
    bars = [("000001", d, 1.0) for d in days] + [("000002", date(2020, 1, 5), 2.0), ("000003", date(2020, 2, 1), 3.0)]
    df = spark.createDataFrame(bars, "code string, trade_date date, close double").withColumns(
        {c: F.col("close") for c in ("open", "high", "low", "vol", "amount", "turnover_rate", "adj_factor")}
    )
    got = pn.densify(df, calendar).where("code <> '000001'").orderBy("trade_date").collect()
    assert [(r.code, r.trade_date, r.close, r.vol, r.is_suspended) for r in got] == [("000002", d, None, 0.0, True) for d in days]


def test_staging_needs_a_shared_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(DataContractError):
            _local_folder(master, "app")
    assert _local_folder("local[4]", "app") == _local_folder("local[*]", "app")


def test_gate_refuses_what_was_not_validated(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two" * 5000)
    sums = checksum_manifest(spark, str(tmp_path), "*.txt")
    pieces = checksum_manifest(spark, str(tmp_path), "*.txt", whole_bytes=0)
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, pieces.collect()))
    recorded = spark.createDataFrame([tuple(r) for r in sums.collect()], sums.schema)
    panel = spark.range(3)
    manifest = lambda s: spark.createDataFrame([(s,)], "status string")
    assert quality.gate_on_validated(panel, manifest("validated"), sums, recorded).count() == 3
    with pytest.raises(DataContractError):
        quality.gate_on_validated(panel, manifest("failed"), sums, recorded)
    (tmp_path / "a.txt").write_text("changed")
    with pytest.raises(DataContractError):
        quality.gate_on_validated(panel, manifest("validated"), checksum_manifest(spark, str(tmp_path), "*.txt"), recorded)


def test_a_batch_writes_only_its_rows_and_folding_keeps_the_newest(spark, tmp_path):
    target, keys = str(tmp_path / "t"), ("code",)
    merge = upsert.merge_batch(target, keys, fold_every=3)
    rows = [[("a", 1), ("b", 1)], [("b", 2)], [("c", 3)], [("a", 4)]]
    for i, batch in enumerate(rows):
        merge(spark.createDataFrame(batch, "code string, x long"), i)
        if i == 1:
            assert spark.read.parquet(f"{target}/{CommitLog(spark, target).last().deltas[-1]}").count() == 1
    last = CommitLog(spark, target).last()
    assert last.batch == 3 and last.base is not None and len(last.deltas) == 1
    merge(spark.createDataFrame(rows[3], "code string, x long"), 3)  # the last batch again
    got = {r.code: r.x for r in upsert.read_target(spark, target, keys).collect()}
    assert got == {"a": 4, "b": 2, "c": 3}


def test_history_rank_without_lists(spark):
    rng = np.random.default_rng(1)
    v = [None if x < 0.1 else round(float(x), 1) for x in rng.random(100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "p int, v double")
    got = {r.p: r.n for r in rr.not_above_so_far(df, "p", "v", "n").collect()}
    assert got == {i: sum(y is not None and y <= x for y in v[: i + 1]) for i, x in enumerate(v) if x is not None}
