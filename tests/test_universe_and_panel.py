from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.functions.codes import normalize_ts_code
from tidepanel.operators import calendar as cal
from tidepanel.operators import panel as pn
from tidepanel.operators import universe as un
from tidepanel.schemas import BAR_SCHEMA, EVENT_SCHEMA, SNAPSHOT_SCHEMA, DataContractError

D = [date(2024, 1, 1) + timedelta(days=i) for i in range(5)]  # Monday to Friday
A, B, C, E = "000001.SZ", "000002.SZ", "000003.SZ", "600000.SH"


def days(spark, n):
    out, day = [], date(2024, 1, 1)
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def calendar(spark, n=4):
    rows = [(d,) for d in days(spark, n)]
    return cal.trading_calendar(spark.createDataFrame(rows, "trade_date date"))


def snaps(spark, rows):
    return spark.createDataFrame(rows, SNAPSHOT_SCHEMA)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


SNAP = [(D[0], c, 1.0) for c in (A, B, E)] + [(D[2], c, 2.0) for c in (A, C, E)]
SWAP = [(D[1], B, "remove", "n1"), (D[1], C, "add", "n1")]


def build(spark, snap=SNAP, event=SWAP, expected=3):
    return un.build_membership(
        snaps(spark, snap), events(spark, event), calendar(spark), D[0], D[3], expected
    )


def on(m, code):
    return sorted(r[0] for r in m.daily.where(F.col("ts_code") == code).select("trade_date").collect())


def test_replay_matches_snapshots(spark):
    m = build(spark)
    assert m.audit["status"] == "passed"
    assert on(m, B) == [D[0]] and on(m, C) == D[1:4]
    counts = [r["count"] for r in m.daily.groupBy("trade_date").count().collect()]
    assert counts == [3] * 4 and m.intervals.count() >= 4
    weight = {(r.trade_date, r.ts_code): (r.weight, r.source_date) for r in m.daily.collect()}
    assert weight[(D[1], C)] == (None, D[0]) and weight[(D[3], C)] == (2.0, D[2])
    source = {r.ts_code: r.source_announcement for r in m.intervals.collect()}
    assert source[C] == "n1" and source[A] == f"tushare_snapshot:{D[0]}"


def test_mismatching_snapshot_fails_and_gives_no_weight(spark):
    m = build(spark, event=[])
    assert m.audit["status"] == "failed"
    found = {(r.con_code, r.finding) for r in m.findings.collect()}
    assert found == {(C, "missing_from_rebuild"), (B, "extra_in_rebuild")}
    assert {r.source_date for r in m.daily.collect()} == {D[0]}
    assert {r.status for r in m.intervals.collect()} == {"failed"}


def test_same_day_add_and_remove_ends_removed(spark):
    both = [(D[1], B, "add", "x"), (D[1], B, "remove", "x")]
    assert on(build(spark, snap=SNAP[:3], event=both), B) == [D[0]]


def test_reentry_makes_two_intervals(spark):
    back = [(D[1], B, "remove", "x"), (D[3], B, "add", "y")]
    m = build(spark, snap=SNAP[:3], event=back)
    spans = sorted(
        (r.start_date, r.end_date, r.source_announcement)
        for r in m.intervals.where(F.col("ts_code") == B).collect()
    )
    # The source is that of the last addition overall, for both intervals.
    assert spans == [(D[0], D[0], "y"), (D[3], D[3], "y")]


def test_change_on_a_day_off_takes_effect_next_day(spark):
    rows = [(date(2024, 1, 6), B, "remove", "x")]
    m = un.build_membership(
        snaps(spark, SNAP[:3]), events(spark, rows), calendar(spark, 7), D[0], date(2024, 1, 9), 3
    )
    assert max(on(m, B)) == date(2024, 1, 5)


def test_anchor_is_never_in_the_future_and_has_the_expected_size(spark):
    with pytest.raises(DataContractError):
        build(spark, snap=SNAP[3:])
    with pytest.raises(DataContractError):
        build(spark, expected=4)


def test_unknown_action_is_refused(spark):
    with pytest.raises(DataContractError):
        build(spark, event=[(D[1], B, "drop", "x")])


def test_inferred_events_need_the_announced_size(spark):
    official = [{"effective_date": D[1], "source": "s", "expected_changes": 1}]
    got = un.infer_events(events(spark, []), snaps(spark, SNAP), official).collect()
    assert {(r.con_code, r.action) for r in got} == {(B, "remove"), (C, "add")}
    with pytest.raises(DataContractError):
        un.infer_events(
            events(spark, []), snaps(spark, SNAP), [{**official[0], "expected_changes": 2}]
        )


def test_codes(spark):
    raw = ["600000.0", "1.0", "600000.SH", "sh.600000", None, "900001", "1234567"]
    df = spark.createDataFrame([(r,) for r in raw], "c string")
    got = [r[0] for r in df.select(normalize_ts_code(F.col("c"))).collect()]
    assert got == [
        "600000.SH", "000001.SZ", "600000.SH", "600000.SH", "000000.SZ", "900001.SH", "1234567.SZ",
    ]


ADJ = [
    (A, D[0], 10.0, 10.0, 10.2, 9.8, 1.0, 1.0, 1.0, 1.0),
    (A, D[1], 10.5, 11.0, 11.2, 10.4, 1.0, 1.0, 1.0, 1.0),
    (A, D[2], 5.5, 5.5, 5.6, 5.4, 1.0, 1.0, 1.0, 2.0),
    (A, D[3], 3.0, 3.0, 3.1, 2.9, 1.0, 1.0, 1.0, 4.0),
]


def test_adjustment_does_not_see_later_rows(spark):
    cols = ["trade_date", "open", "close", "high", "low"]
    short, whole = (
        [tuple(r) for r in pn.causal_adjust(spark.createDataFrame(ADJ[:n], BAR_SCHEMA))
         .orderBy("trade_date").select(*cols).collect()]
        for n in (3, 4)
    )
    assert short == whole[:3] and whole[2][2] == 11.0


def test_adjustment_refuses_bad_factors(spark):
    bad = spark.createDataFrame([ADJ[0][:-1] + (0.0,)], BAR_SCHEMA)
    with pytest.raises(DataContractError):
        pn.causal_adjust(bad)


def bars(spark, skip=((0, 1),)):
    rows = []
    for k, code in enumerate((A, B)):
        for i, day in enumerate(days(spark, 7)):
            if (k, i) not in skip:
                p = 10.0 + i
                rows.append((code, day, p, p + 0.5, p + 1, p - 1, 2.0, 3.0, 1.0, 1.0))
    return spark.createDataFrame(rows, BAR_SCHEMA)


def panel(spark, market):
    d = days(spark, 7)
    members = spark.createDataFrame(
        [(day, c) for day in d[:3] for c in ("000001", "000002")], "trade_date date, code string"
    )
    built = pn.build_panel(market, members, calendar(spark, 7), d[0], d[1])
    return {(r.code, r.trade_date): r for r in built.collect()}, d


def test_suspension_and_label(spark):
    rows, d = panel(spark, bars(spark))
    assert len(rows) == 14
    halted = rows[("000001", d[1])]
    assert halted.is_suspended and not halted.is_tradable and halted.is_member
    assert halted.open == halted.high == halted.close == 10.5 and halted.volume == 0.0
    assert rows[("000001", d[0])].label == 0.0 and rows[("000001", d[0])].label_entry_failed
    assert rows[("000002", d[0])].label == pytest.approx((15.5 - 11) / 11)
    assert not rows[("000002", d[0])].label_entry_failed
    assert rows[("000002", d[2])].label is None and not rows[("000002", d[3])].is_member
    assert rows[("000002", d[1])].volume == 200.0 and rows[("000002", d[1])].amount == 3000.0
    assert rows[("000002", d[1])].in_signal_range and not rows[("000002", d[2])].in_signal_range


def test_listing_later_and_bars_off_the_calendar(spark):
    extra = spark.createDataFrame(
        [(B, date(2024, 1, 6), 99.0, 99.0, 99.0, 99.0, 1.0, 1.0, 1.0, 2.0)], BAR_SCHEMA
    )
    rows, d = panel(spark, bars(spark, skip=((0, 0), (0, 1))).unionByName(extra))
    assert ("000001", d[0]) not in rows and ("000001", d[2]) in rows
    # A bar on a Saturday is not part of the panel.
    assert len([k for k in rows if k[0] == "000002"]) == 7
    assert rows[("000002", d[5])].close == 15.5


def test_contest_label(spark):
    opens = [10.0, 11.0, 12.0, 13.0, 14.0, 16.5, 18.0]
    df = spark.createDataFrame(
        [("1", d, o) for d, o in zip(days(spark, 7), opens)], "code string, trade_date date, open double"
    )
    got = [r.label for r in pn.contest_label(df).orderBy("trade_date").collect()]
    assert got[0] == pytest.approx((16.5 - 11) / 11) and got[2:] == [None] * 5


def test_calendar_needs_warmup(spark):
    with pytest.raises(DataContractError):
        cal.research_window(calendar(spark, 20), date(2024, 1, 10), date(2024, 1, 12))
    got = cal.research_window(calendar(spark, 20), date(2024, 1, 10), date(2024, 1, 12), 3, 5)
    assert got == {"warmup_start": date(2024, 1, 5), "market_end": date(2024, 1, 19)}


def test_bars_are_shuffled_by_code_once(spark):
    columns = ["open", "high", "low", "close", "vol", "amount", "turnover_rate", "adj_factor"]
    rows = spark.range(10).selectExpr("'1' AS ts_code", "date_add(date'2024-01-01', int(id)) AS trade_date", *[f"1.0D AS {c}" for c in columns])
    members = spark.createDataFrame([], "trade_date date, con_code string, code string, ts_code string, weight double, is_member boolean")
    day = rows.first().trade_date
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pn.build_panel(rows, members, calendar(spark, 7), day, day, check=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(code" in plan and "hashpartitioning(ts_code" not in plan
