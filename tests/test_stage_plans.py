"""Plans of the steps up to the scores: what is shuffled and computed how often."""

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.catalog.base import weekly_bars
from tidepanel.functions.codes import normalize_ts_code
from tidepanel.operators import calendar as cal
from tidepanel.operators import features as ft
from tidepanel.operators import panel as pn
from tidepanel.operators import universe as un

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(20)]
ROWS = "code string, trade_date date, is_suspended boolean"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_marking_members_keeps_the_panel_dealt_by_code(spark, no_broadcast):
    panel = spark.createDataFrame([(f"{c:06d}", d, False) for c in range(3) for d in DAYS], ROWS)
    dealt = panel.withColumn("n", F.row_number().over(pn.by_code()))
    members = spark.createDataFrame([("000001", DAYS[3])], "code string, trade_date date")
    marked = pn.mark_members(dealt, members)
    after = marked.withColumn("m", F.lag("is_member").over(pn.by_code()))
    assert not re.search(r"hashpartitioning\(code#\d+, trade_date", plan(after))
    assert [(r.code, r.trade_date) for r in marked.where("is_member").collect()] == [("000001", DAYS[3])]


def test_marking_members_with_repeated_and_missing_keys(spark, no_broadcast):
    a, b, c = DAYS[:3]
    rows = [("000001", a, False), ("000001", a, True), ("000001", b, False), ("000001", None, False), ("000002", a, None), (None, a, False)]
    members = spark.createDataFrame(
        [("1", a), ("000001", a), ("000001", None), ("000002", a), ("000002", c), (None, a)], "code string, trade_date date"
    )
    got = pn.mark_members(spark.createDataFrame(rows, ROWS), members)
    assert got.columns == ["code", "trade_date", "is_suspended", "is_member", "is_tradable"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [
            ("000001", a, False, True, True),
            ("000001", a, True, True, False),
            ("000001", b, False, False, False),
            ("000001", None, False, False, False),
            ("000002", a, None, True, None),
            (None, a, False, False, False),
        ],
        key=repr,
    )


def test_membership_cleans_its_inputs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(w):
        seen.add(1)
        return w

    days = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    calendar = cal.trading_calendar(days)
    rows = [(d, c, 1.0) for d in (DAYS[0], DAYS[10]) for c in ("000001.SZ", "600000.SH")]
    snapshots = spark.createDataFrame(rows, "trade_date date, con_code string, weight double")
    events = spark.createDataFrame([], "effective_date date, con_code string, action string, source_announcement string")
    built = un.build_membership(snapshots.withColumn("weight", counted("weight")), events, calendar, DAYS[1], DAYS[-1], 2)
    assert built.daily.count() == 2 * 19 and built.audit["status"] == "passed"
    assert seen.value == len(rows)


def test_the_seed_of_the_true_range_needs_no_frame_of_14_rows(spark):
    rows = [("000001", date(2024, 1, 1) + timedelta(days=i), i, float(i * i % 7) if i else None) for i in range(30)]
    df = spark.createDataFrame(rows, "code string, trade_date date, _step int, _tr double")
    out = ft.wilder_atr(df)
    assert "-13" not in plan(out)
    got = [r.atr_14 for r in out.orderBy("trade_date").collect()]
    ranges = [r[3] for r in rows]
    want = [None] * 14 + [sum(ranges[1:15]) / 14]
    for x in ranges[15:]:
        want.append((13 * want[-1] + x) / 14)
    assert got[:14] == want[:14] and got[14:] == pytest.approx(want[14:])


def test_plain_codes_and_others_are_normalised_alike(spark):
    given = ["1", "600000", "900901", "599", "000005", "1234567", " 42 ", "600000.0", "600000.sh", "sz.000001", "", None, "12\n", "١٢"]
    df = spark.createDataFrame([(c,) for c in given], "c string")
    got = [r[0] for r in df.select(normalize_ts_code(F.col("c"))).collect()]
    assert got[:10] == [
        "000001.SZ", "600000.SH", "900901.SH", "000599.SZ", "000005.SZ", "1234567.SZ", "000042.SZ", "600000.SH", "600000.SH", "000001.SZ",
    ]
    assert got[10:] == ["000000.SZ", "000000.SZ", got[12], "000000.SZ"] and got[12].startswith("00")


def test_weeks_begin_on_monday(spark):
    lines = spark.createDataFrame(
        [(i, 1, 7, 1.0, 10.0 + i, 0.0, t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-07 23:59:59", "2024-01-08 00:00:00", "1969-12-31 12:00:00"])],
        "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate string",
    ).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    bars = weekly_bars(lines)
    assert "date_trunc" not in plan(bars) and "truncTimestamp" not in plan(bars)
    got = {r.trade_date: (r.open, r.close) for r in bars.collect()}
    assert got == {date(2024, 1, 1): (10.0, 11.0), date(2024, 1, 8): (12.0, 12.0), date(1969, 12, 29): (13.0, 13.0)}
