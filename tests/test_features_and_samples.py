from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import features as ft
from tidepanel.operators import gate as gt
from tidepanel.operators import market as mk
from tidepanel.operators import notices as nt
from tidepanel.operators import regime as rg
from tidepanel.operators import scoring as so
from tidepanel.operators import sequences as sq
from tidepanel.operators import splits as sp
from tidepanel.plans.extent import Extent
from tidepanel.schemas import NOTICE_SCHEMA, DataContractError
from tidepanel.sources import ingest as ig
from tidepanel.sources import readers as rd


def ohlcv(n=120):
    i = np.arange(n)
    c = 10 + 0.02 * i + 0.2 * np.sin(i / 7)
    return pd.DataFrame(
        {
            "code": "000001",
            "trade_date": pd.bdate_range("2025-01-01", periods=n).date,
            "open": 0.998 * c, "close": c, "high": 1.01 * c, "low": 0.99 * c,
            "volume": 1e6 + 1000.0 * i, "amount": 1e7 + i, "amplitude": 2.0,
            "turnover": 1.0, "pct_chg": 0.1,
        }
    )


def wilder(pdf):
    h, l, c = pdf.high.values, pdf.low.values, pdf.close.values
    tr = [np.nan] + [max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) for i in range(1, len(c))]
    out = [np.nan] * len(c)
    out[14] = np.mean(tr[1:15])
    for i in range(15, len(c)):
        out[i] = (13 * out[i - 1] + tr[i]) / 14
    return out


def test_features_against_pandas_and_the_future(spark, monkeypatch):
    monkeypatch.setattr(ft, "ATR_BLOCK", 16)
    pdf = ohlcv()
    changed = pdf.copy()
    changed.loc[100:, ["close", "high", "low", "volume"]] *= 3
    two = pd.concat([pdf, changed.assign(code="000002")])
    got = ft.baseline24(spark.createDataFrame(two), zero_fill=False).toPandas()
    a = got[got.code == "000001"].sort_values("trade_date").reset_index(drop=True)
    b = got[got.code == "000002"].sort_values("trade_date").reset_index(drop=True)
    c, v = pdf.close, pdf.volume
    w = (c / c.shift(1) - 1).abs() * v
    wanted = {
        "STD20": c.rolling(20).std(ddof=0) / c,
        "RANK60": c.rolling(60).rank(pct=True),
        "ROC5": c.shift(5) / c,
        "volatility_10": (c / c.shift(1) - 1).rolling(10).std(),
        "WVMA20": w.rolling(20).std() / w.rolling(20).mean(),
        "volume_ratio": v.rolling(5).mean() / v.rolling(20).mean(),
        "atr_14": pd.Series(wilder(pdf)),
    }
    for name, series in wanted.items():
        np.testing.assert_allclose(a[name].astype(float), series, rtol=1e-8, atol=1e-10, err_msg=name)
    names = list(ft.BASE24)
    pd.testing.assert_frame_equal(a.loc[:99, names], b.loc[:99, names])
    filled = ft.baseline24(spark.createDataFrame(pdf)).select(*names).toPandas()
    assert np.isfinite(filled.to_numpy(dtype=float)).all()


def test_feature_sets():
    assert len(ft.select_features("baseline24_market4", exclude=("instrument",))) == 28
    with pytest.raises(DataContractError):
        ft.select_features("baseline24", exclude=("nope",))


def test_market_state_ignores_the_untradable(spark):
    rows = []
    for i, d in enumerate(pd.bdate_range("2024-01-01", periods=70).date):
        rows += [(d, "1", 1.0, True, True), (d, "2", 2.0, True, True), (d, "3", 1000.0, True, False)]
    df = spark.createDataFrame(rows, "trade_date date, code string, pct_chg double, is_member boolean, is_tradable boolean")
    got = mk.market4(df).orderBy("trade_date").collect()
    assert got[18].market_return_20 is None and got[58].market_drawdown_60 is None
    assert got[19].market_return_20 == pytest.approx(1.015**20 - 1)
    assert got[59].market_drawdown_60 == pytest.approx(0) and got[19].market_breadth_20 == 1.0


def test_component_features(spark):
    # Readings chosen so that volatility is 3 and -1, drawdown -2 and 2 after scaling.
    cols = ", ".join(f"{c} double" for c in (*mk.MARKET4, "ROC20", "STD20"))
    df = spark.createDataFrame([(0.0, 3.0, 2.0, 0.0, 0.25, 0.75)], cols)
    center = dict(zip(mk.MARKET4, (0.0, 1.0, 0.0, 0.0)))
    scale = dict(zip(mk.MARKET4, (1.0, 2.0, 2.0, 1.0)))
    row = mk.component2(df, center, scale).first()
    assert row.volatility_stress_x_ROC20 == pytest.approx(0.25)
    assert row.drawdown_stress_x_STD20 == pytest.approx(-0.75)
    with pytest.raises(DataContractError):
        mk.component2(df, center, {**scale, "market_return_20": 0.0})


def day_table(spark, n, end=None):
    days = pd.bdate_range(end=end, periods=n) if end else pd.bdate_range("2024-01-01", periods=n)
    return spark.createDataFrame([(d.date(),) for d in days], "trade_date date")


def test_splits(spark):
    split = {r.segment: r for r in sp.purged_split(day_table(spark, 520), 439, 39, 24, 5).collect()}
    assert [split[s].n_days for s in ("train", "gap1", "validation", "gap2", "test")] == [439, 5, 39, 5, 24]
    with pytest.raises(DataContractError):
        sp.purged_split(day_table(spark, 20), 10, 5, 5, 5)
    one = {r.segment: r for r in sp.single_signal_split(day_table(spark, 30)).collect()}
    assert (one["train"].n_days, one["embargo_context"].n_days, one["test"].n_days) == (20, 5, 5)
    assert one["signal"].start_date == one["embargo_context"].end_date
    assert sp.ratio_day_counts(110) == (70, 15, 15)


@pytest.mark.parametrize("n", [0, 1, 4, 9, 59])
def test_weekday_steps(spark, n):
    days = [date(2024, 3, 1) + timedelta(days=i) for i in range(10)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(sp.business_days_before(F.col("d"), n)).collect()]
    assert got == [(pd.Timestamp(d) - pd.tseries.offsets.BDay(n)).date() for d in days]


def test_sequences_end_on_candidates_and_pad(spark):
    rows = []
    for i, d in enumerate(pd.bdate_range("2024-01-01", periods=4).date):
        rows.append((d, "a", float(i), 0.1 * i, True, True))
        rows.append((d, "b", float(i), 0.2 * i, i >= 2, True))
    df = spark.createDataFrame(
        rows, "trade_date date, code string, x double, label double, is_member boolean, is_tradable boolean"
    )
    samples = sq.by_date(sq.sliding_sequences(df, ["x"], 2), Extent(4, 2), min_stocks=1)
    got = {(r.trade_date.day, r.code): r.seq for r in samples.collect()}
    assert set(got) == {(2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b")}
    assert got[(3, "b")] == [[1.0], [2.0]]
    padded = sq.pad_and_mask(samples, 2, 1, Extent(4, 2)).orderBy("trade_date", "slot").collect()
    assert [r.mask for r in padded] == [1, 0, 1, 1, 1, 1] and padded[1].seq == [[0.0], [0.0]]
    with pytest.raises(DataContractError):
        sq.inference_sequences(df, ["x"], 2, date(2030, 1, 1))


def test_stratified_sample(spark):
    states = ["weak"] * 10 + ["normal"] * 60 + ["strong"] * 30
    days = pd.bdate_range("2024-01-01", periods=100).date
    df = spark.createDataFrame(list(zip(days, states)), "trade_date date, market_state string")
    drawn, audit = rg.stratified_sample(df, 0.30, seed=1)
    row = audit.first()
    assert (row.sample_count, row.weak_draws) == (100, 30) and row.repeat_draws >= 20
    assert drawn.collect() == rg.stratified_sample(df, 0.30, seed=1)[0].collect()
    assert drawn.where("market_state = 'weak'").select("trade_date").distinct().count() == 10
    with pytest.raises(DataContractError):
        rg.stratified_sample(df.where("market_state <> 'weak'"), 0.3, 1)


def test_gate(spark):
    ones = dict.fromkeys(mk.MARKET4, 1.0)
    rule = gt.GateRule(dict.fromkeys(mk.MARKET4, 0.0), ones, 1.0, 2.0, (1.0,) * 4, (2.0,) * 4)
    cols = "trade_date date, " + ", ".join(f"{c} double" for c in mk.MARKET4)
    calm, one, two = (0.0,) * 4, (-3.0, 0.0, 0.0, 0.0), (-3.0, 3.0, 0.0, 0.0)
    df = spark.createDataFrame([(date(2024, 1, i + 1), *r) for i, r in enumerate((calm, one, two))], cols)
    gates = [r.gate for r in gt.gate_two_of_four(df, rule).orderBy("trade_date").collect()]
    assert gates[:2] == [0.0, 0.0] and 0.3 <= gates[2] <= 0.6
    low = [r.gate for r in gt.gate_two_of_four(df, rule, F.lit(-50.0)).orderBy("trade_date").collect()]
    assert low[2] >= 0.3
    assert {r.gate for r in gt.gate_override(df, 0.25).collect()} == {0.25}


def test_scoring(spark):
    days = pd.bdate_range("2024-01-01", periods=7).date
    bars = spark.createDataFrame(
        [("000001", d, 10.0 + i) for i, d in enumerate(days)], "code string, trade_date date, open double"
    )
    picks = spark.createDataFrame([("1", 0.5), ("2", 0.5)], "stock_id string, weight double")
    assert so.score_submission(picks, bars).first()[0] == pytest.approx(0.5 * 4 / 12)
    heavy = picks.withColumn("weight", F.lit(0.9))
    assert so.score_submission(heavy, bars).first()[0] == -999.0


def test_notices(spark):
    day = date(2025, 6, 16)  # a Monday
    text = {
        "plain": "自2025年6月16日起生效",
        "split": "自<b>202 5 年 6 月 16 日</b>起实施",
        "close": "于2025年6月13日收市后生效",
        "off": "生效日期为2025年6月14日",
        "none": "另行公告",
        "delist": "自退市日起生效，涉及600837",
    }
    table = (
        "<table><tr><td>调出</td><td>名</td><td>调入</td><td>名</td></tr>"
        "<tr><td>600001</td><td>x</td><td>000002</td><td>y</td></tr></table>"
    )
    rows = [(k, None, "300", day, v + (table if k == "plain" else "")) for k, v in text.items()]
    notices = spark.createDataFrame(rows, NOTICE_SCHEMA)
    cal_days = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2025-06-02", periods=20)], "trade_date date")
    from tidepanel.operators.calendar import trading_calendar

    calendar = trading_calendar(cal_days)
    got = {r.announcement_id: r.effective_date for r in nt.effective_dates(notices, calendar).collect()}
    assert got == {"plain": day, "split": day, "close": day, "off": day, "none": None, "delist": None}
    over = spark.createDataFrame(
        [("600837", date(2025, 6, 18), "600837.SH", "601058.SH", "s")], nt.OVERRIDE_SCHEMA
    )
    found, unread = nt.announcement_events(notices, calendar, date(2025, 6, 1), date(2025, 7, 1), over)
    pairs = {(r.announcement_id, r.con_code, r.action) for r in found.collect()}
    assert pairs == {
        ("plain", "600001.SH", "remove"), ("plain", "000002.SZ", "add"),
        ("delist", "600837.SH", "remove"), ("delist", "601058.SH", "add"),
    }
    assert {(r.announcement_id, r.error) for r in unread.collect()} == {
        ("none", "no effective date"), ("split", "no codes"), ("close", "no codes"), ("off", "no codes"),
    }


def test_read_panel_with_a_byte_order_mark(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("股票代码,日期,开盘,is_member\n1,2026/2/7,1.5,True\n2,20260208,x,\n", encoding="utf-8-sig")
    a, b = rd.read_panel(spark, str(path)).orderBy("code").collect()
    assert (a.code, a.trade_date, a.open, a.is_member) == ("000001", date(2026, 2, 7), 1.5, True)
    assert (b.trade_date, b.open, b.is_member) == (date(2026, 2, 8), None, False)


def test_fetch_gaps(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    have = spark.createDataFrame(
        [("a", date(2024, 1, 1)), ("a", date(2024, 1, 31)), ("b", date(2024, 1, 10))], "code string, trade_date date"
    )
    got = {tuple(r) for r in ig.plan_fetch_gaps(universe, have, date(2024, 1, 1), date(2024, 1, 31)).collect()}
    assert got == {
        ("b", date(2024, 1, 1), date(2024, 1, 9), "early"),
        ("b", date(2024, 1, 11), date(2024, 1, 31), "late"),
        ("c", date(2024, 1, 1), date(2024, 1, 31), "full"),
    }


def test_portfolios_of_any_size_score_alike(spark, monkeypatch):
    bars = spark.createDataFrame(
        [(f"{c:06d}", date(2024, 1, d), float(10 + c + d)) for c in range(40) for d in range(1, 8)], "code string, trade_date date, open double"
    )
    picks = spark.createDataFrame([(f"{c:06d}", 1 / 30) for c in range(30)], "code string, weight double")
    want = so.portfolio_score(picks, bars).first()[0]
    monkeypatch.setattr(so, "BROADCAST_ROWS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = so.portfolio_score(picks, bars)
        assert scored.first()[0] == pytest.approx(want)
        assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
