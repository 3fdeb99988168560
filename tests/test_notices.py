import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import notices as nt
from tidepanel.operators.calendar import trading_calendar
from tidepanel.schemas import DataContractError

CELLS = "id int, rows array<array<struct<text:string,down:int,across:int>>>"


def grid(rows):
    """Cells into places, one by one."""
    out, claims = [], {}
    for cells in rows:
        line, below, due = [], {}, sorted(claims.items())

        def claim():
            _, (text, left) = due.pop(0)
            if left > 1:
                below[len(line)] = (text, left - 1)
            line.append(text)

        for text, down, across in cells:
            while due and due[0][0] <= len(line):
                claim()
            for _ in range(across):
                if down > 1:
                    below[len(line)] = (text, down - 1)
                line.append(text)
        while due:
            claim()
        out.append(line)
        claims = below
    while claims:
        out.append([text for _, (text, _) in sorted(claims.items())])
        claims = {c: (text, left - 1) for c, (text, left) in claims.items() if left > 1}
    return out


def test_grid_of_random_spans(spark):
    rng = random.Random(6)
    tables = [
        [[(f"{r}.{c}", rng.choice([1, 1, 1, 2, 3, 5]), rng.choice([1, 1, 1, 2, 3, 0])) for c in range(rng.randint(0, 5))] for r in range(rng.randint(0, 6))]
        for _ in range(300)
    ]
    df = spark.createDataFrame(list(enumerate(tables)), CELLS)
    for r in df.select("id", nt.spanned_grid(F.col("rows")).alias("g")).collect():
        assert r.g == grid(tables[r.id]), tables[r.id]


def test_spans_of_written_tables(spark):
    head = "<tr><th rowspan=9>调出</th></tr><tr><td>调出</td><td>x</td><td>调入</td><td>y</td></tr>"
    bodies = {
        "down": "<tr><td rowspan=2>000001</td><td>a</td><td>600001</td><td>b</td></tr><tr><td>c</td><td>600002</td><td>d</td></tr>",
        "across": "<tr><td colspan='2'>000001</td><td COLSPAN = \"2\">600001</td></tr>",
        "odd": "<tr><td rowspan=x>000001</td><td data-rowspan=3>a</td><td colspan=>600001</td><td rowspan=0>b</td></tr>",
        "beyond": "<tr><td rowspan=3>000001</td><td>a</td><td>600001</td><td>b</td></tr>",
        "huge": "<tr><td colspan=99999999999999999999>000001</td></tr>",
        "narrow": "<tr><td rowspan=2>000001</td></tr>",
    }
    want = {
        "down": ["000001", "000001", "600001", "600002"],
        "across": ["000001", "600001"],
        "odd": ["000001", "600001"],
        "beyond": ["000001", "000001", "000001", "600001"],
        "huge": ["000001", "000001"],
        "narrow": ["000001", "000001"],
    }
    rows = [(k, date(2025, 1, 2), f"<table>{head}{b}</table>") for k, b in bodies.items()] + [("null", date(2025, 1, 2), None), ("none", date(2025, 1, 2), "")]
    found = {}
    for r in nt.html_table_events(spark.createDataFrame(rows, "announcement_id string, effective_date date, content string")).collect():
        found.setdefault(r.announcement_id, []).append(r.con_code[:6])
    assert {k: sorted(v) for k, v in found.items()} == want


@pytest.fixture(scope="module")
def calendar(spark):
    return trading_calendar(spark.createDataFrame([(date(2025, 1, d),) for d in (2, 3, 6, 7)], "trade_date date"))


def test_overrides_of_any_number(spark, calendar):
    listed = [(f"{i:06d}", date(2025, 1, 2 + i % 2), f"{i:06d}.SZ", "600000.SH", f"s{i}") for i in range(5000)]
    listed += [("000007", date(2025, 1, 6), "x", "y", "later"), ("*ST甲", date(2025, 1, 7), "000009.SZ", "600009.SH", "name"), (None, date(2025, 1, 7), "a", "b", "c")]
    texts = {
        "one": "自退市日起 000007。",
        "inside": "自退市日起 9000100",  # 900010 isn't listed, 000100 is
        "two": "自退市日起 004999 和 000003",  # the one listed first
        "name": "自退市日起 *ST甲",
        "unlisted": "自退市日起 777777",
        "other": "000007",
        "same": "自退市日起 000007。",
        "null": None,
    }
    rows = [(k, None, v) for k, v in texts.items()] + [("dated", date(2025, 1, 3), "自退市日起 000007"), ("one", None, "自退市日起 000007。")]
    notices = spark.createDataFrame(rows, "announcement_id string, effective_date date, plain string")
    found = nt.delisting_overrides(notices, spark.createDataFrame(listed, nt.OVERRIDE_SCHEMA), calendar)
    got = sorted((r.announcement_id, r.effective_date, r.override and r.override.source) for r in found.collect() if r.effective_date)
    assert got == [
        ("dated", date(2025, 1, 3), None), ("inside", date(2025, 1, 2), "s100"), ("name", date(2025, 1, 7), "name"),
        ("one", date(2025, 1, 3), "s7"), ("one", date(2025, 1, 3), "s7"), ("same", date(2025, 1, 3), "s7"), ("two", date(2025, 1, 3), "s3"),
    ]
    assert found.count() == len(rows)


def test_overrides_follow_their_positions(spark, calendar):
    listed = [("000001", date(2025, 1, 2), "a", "b", "second", 2), ("000001", date(2025, 1, 3), "a", "b", "first", 1)]
    notices = spark.createDataFrame([("n", None, "自退市日起 000001")], "announcement_id string, effective_date date, plain string")
    over = spark.createDataFrame(listed, nt.OVERRIDE_SCHEMA + ", position int")
    assert nt.delisting_overrides(notices, over, calendar).first().override.source == "first"
    assert nt.delisting_overrides(notices, over.limit(0), calendar).first().override is None
    with pytest.raises(DataContractError):
        nt.delisting_overrides(notices, over.withColumn("listed_code", F.lit("")), calendar)


def test_tables_are_read_once_and_no_expression_is_interpreted(spark):
    rows = [("a", date(2025, 1, 2), "<table><tr><td rowspan=2>调出</td><td>x</td><td>调入</td><td>y</td></tr></table>")]
    found = nt.html_table_events(spark.createDataFrame(rows, "announcement_id string, effective_date date, content string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan and "regexp_extract_all" not in plan


def test_classes_and_cases_are_those_of_ascii():
    row = "<tr><td>调出　</td><td>x</td><td>调入</td><td>y</td></tr><TR><TD>１２３４５６ 000001</TD><td>x</td><td>\t600001 </td></TR>"
    assert nt._content_codes(f"<TABLE>{row}</TABLE>") == [{"code": "000001", "action": "remove"}, {"code": "600001", "action": "add"}]
    assert nt._content_codes(f"<table>{row.replace('<tr>', '<tr ſ>')}") == []  # no end
    wide = f"<td colspan={'0' * 5000}3>000001</td><td rowspan={'9' * 5000}>x</td>"
    assert [line[:4] for line in nt._table_rows(f"<table><tr>{wide}</tr></table>")][0] == ["000001"] * 3 + ["x"]


def test_notices_of_a_small_file_are_dealt_over_the_cores(spark, tmp_path):
    from tidepanel.catalog.base import Tables
    from tidepanel.catalog.ingest_queries import notices

    events = [(i, datetime(2024, 1, 1 + i % 28), i % 50, "view", 1.0, "{}") for i in range(400)]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    made = notices(Tables(spark, str(tmp_path)))
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(int(r.announcement_id) for r in made.select("announcement_id").collect()) == list(range(400))


def test_texts_are_read_once_for_events_and_errors(spark, calendar):
    table = "<table><tr><td>调出</td><td>x</td><td>调入</td><td>y</td></tr><tr><td>000001</td><td>x</td><td>600001</td><td>y</td></tr></table>"
    texts = {
        "own": f"于2025年1月3日生效{table}", "bare": "于2025年1月3日生效", "listed": "自退市日起 000007。", "both": f"自退市日起 000007。{table}",
        "unlisted": f"自退市日起 777777。{table}", "late": f"于2025年2月3日生效{table}", None: f"于2025年1月3日生效{table}", "no": None,
    }
    rows = [*texts.items(), ("own", "于2025年1月6日生效")]
    over = spark.createDataFrame([("000007", date(2025, 1, 6), "000007.SZ", "600007.SH", "s")], nt.OVERRIDE_SCHEMA)
    notices = spark.createDataFrame(rows, "announcement_id string, content string")
    events, unread = nt.announcement_events(notices, calendar, date(2025, 1, 1), date(2025, 1, 31), over)
    plan = unread._jdf.queryExecution().executedPlan().toString() + events._jdf.queryExecution().executedPlan().toString()
    assert "生效" not in plan and "ArrowEvalPython" not in plan  # neither dates nor tables are looked for again
    named = lambda rows: sorted([tuple(x or "" for x in r) for r in rows])
    assert named(events.select("announcement_id", "con_code").collect()) == [
        ("", "000001.SZ"), ("", "600001.SH"), ("both", "000001.SZ"), ("both", "600001.SH"), ("listed", "000007.SZ"), ("listed", "600007.SH"), ("own", "000001.SZ"), ("own", "600001.SH"),
    ]
    # A null id meets none of the events.
    assert named(unread.collect()) == [("", "no codes"), ("bare", "no codes"), ("late", "no effective date"), ("no", "no effective date"), ("unlisted", "no effective date")]
