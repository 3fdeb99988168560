"""Reading, merging, normalising and writing; notice parsing."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from tidepanel.catalog import oracle as o
from tidepanel.catalog.base import Tables
from tidepanel.catalog.evaluation_queries import SUMMARY, summary_sql
from tidepanel.catalog.registry import checked, query
from tidepanel.functions import text as tx
from tidepanel.functions.codes import zfill
from tidepanel.functions.numeric import eps_divide, smoothstep, to_numeric
from tidepanel.operators import notices as nt
from tidepanel.operators import quality
from tidepanel.operators.calendar import trading_calendar
from tidepanel.operators.crosssection import top_k_portfolio
from tidepanel.operators.evaluation import evaluate_daily, evaluation_summary
from tidepanel.plans.extent import attach
from tidepanel.plans.staging import shared_dir, stage
from tidepanel.schemas import DataContractError
from tidepanel.sources import ingest as ig
from tidepanel.sources import readers as rd
from tidepanel.sources import writers as wr
from tidepanel.streaming import upsert as st

KEYS = "code trade_date"


def scratch(t: Tables, name: str) -> str:
    """A new folder next to the staged tables."""
    app = t.spark.sparkContext.applicationId
    return f"{shared_dir(t.spark)}/files/{app}/{name}-{uuid.uuid4().hex}"


PANEL_TEXT = (
    "code", "trade_date", "open", "close", "high", "low", "volume", "amount",
    "is_member", "is_suspended", "is_tradable", "in_signal_range",
)


@checked(
    "panel_from_csv",
    "A1, A5, B11",
    "panel",
    "SELECT * FROM panel",
    f"{KEYS} open close high low volume amount is_member is_suspended is_tradable in_signal_range",
)
def panel_from_csv(t: Tables):
    path = scratch(t, "panel-csv")
    wr.write_panel(t.panel.select(*PANEL_TEXT), path, fmt="csv", by_year=False)
    return rd.read_panel(t.spark, path, PANEL_TEXT)


@checked("panel_by_year", "A5", "panel", "SELECT *, year(trade_date) AS year FROM panel", f"{KEYS} year close volume")
def panel_by_year(t: Tables):
    path = scratch(t, "panel-parquet")
    wr.write_panel(t.panel, path)
    return t.spark.read.parquet(path)


RAW = ("ts_code", "trade_date", "open", "close", "vol")


@checked(
    "raw_responses",
    "A2",
    "bars",
    "SELECT code AS ts_code, CAST(trade_date AS VARCHAR) AS trade_date, open, close, vol FROM bars",
    "ts_code trade_date",
    "open close vol",
)
def raw_responses(t: Tables):
    """One landed folder per year, read back as text."""
    path = scratch(t, "raw")
    landed = t.market_bars.select(*RAW).withColumn("year", F.year("trade_date"))
    landed.repartition("year", "ts_code").write.partitionBy("year").csv(path, header=True)
    raw = rd.read_raw_responses(t.spark, f"{path}/*/*.csv", RAW)
    return raw.withColumns({c: to_numeric(F.col(c)) for c in ("open", "close", "vol")})


@checked(
    "constituent_list",
    "A3",
    "",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code,
  CASE WHEN s_suppkey % 2 = 0 THEN 'sh' WHEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0')[1] IN ('5', '6', '9') THEN 'sh'
    ELSE 'sz' END || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol FROM supplier""",
    "code symbol",
)
def constituent_list(t: Tables):
    """Half of the codes carry a prefix, all of them appear twice."""
    digits = zfill(F.col("s_suppkey").cast("string"))
    prefixed = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("SH."), digits)).otherwise(digits)
    listed = t.read("supplier").select(prefixed.alias("code"), F.lit(1).alias("row"))
    later = listed.withColumns({"code": F.regexp_replace("code", "SH", "sz"), "row": F.lit(2)})
    return rd.constituents(listed.unionByName(later), arrival="row")


ACTIVITY = """SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, CAST(ts AS DATE) AS trade_date,
  round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2"""
o.cte("activity", "", ACTIVITY)


def activity(t: Tables):
    """Events as a second panel: user by day."""
    return t.read("events").groupBy(
        zfill(F.col("user_id").cast("string")).alias("code"), F.to_date("ts").alias("trade_date")
    ).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


LO, HI = date(2024, 1, 5), date(2024, 1, 20)
EARLY, LATE = date(2024, 1, 2), date(2024, 1, 28)


@checked(
    "fetch_gaps",
    "A6",
    "activity",
    f"""WITH u AS (SELECT DISTINCT code FROM activity), h AS (SELECT code, min(trade_date) AS lo, max(trade_date) AS hi
  FROM activity WHERE trade_date BETWEEN DATE '{LO}' AND DATE '{HI}' AND n > 1 GROUP BY 1)
SELECT code, DATE '{LO}' AS fetch_start, DATE '{HI}' AS fetch_end, 'full' AS kind FROM u WHERE code NOT IN (SELECT code FROM h)
UNION ALL SELECT code, DATE '{LO}', lo - 1, 'early' FROM h WHERE lo > DATE '{LO}'
UNION ALL SELECT code, hi + 1, DATE '{HI}', 'late' FROM h WHERE hi < DATE '{HI}'""",
    "code fetch_start fetch_end kind",
)
def fetch_gaps(t: Tables):
    act = activity(t)
    return ig.plan_fetch_gaps(act.select("code"), act.where(F.col("n") > 1), LO, HI)


UPSERTED = f"""SELECT code, trade_date, CASE WHEN trade_date >= DATE '{LO}' THEN -total ELSE total END AS total, n FROM activity
WHERE trade_date <= DATE '{HI}' OR trade_date >= DATE '{LO}'"""


def versions(t: Tables):
    """An old batch up to the later date and a corrected one from the earlier."""
    act = activity(t)
    old = act.where(F.col("trade_date") <= F.lit(HI))
    new = act.where(F.col("trade_date") >= F.lit(LO)).withColumn("total", -F.col("total"))
    return old, new


@checked("upsert_keep_last", "A7", "activity", UPSERTED, f"{KEYS} total n")
def upsert_keep_last(t: Tables):
    return ig.upsert_keep_last(*versions(t))


@checked("streamed_upsert", "A7", "activity", UPSERTED, f"{KEYS} total n")
def streamed_upsert(t: Tables):
    """The same merge, fed by a file stream in micro-batches."""
    root = scratch(t, "stream")
    old, new = versions(t)
    for i, part in enumerate((old, new)):
        part.withColumn("arrival", F.lit(i)).write.mode("append").parquet(f"{root}/in")
    source = (
        t.spark.readStream.schema("code string, trade_date date, total double, n long, arrival int")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{root}/in")
    )
    st.stream_upsert(source, f"{root}/out", f"{root}/chk", order="arrival", fold_every=3).awaitTermination()
    return st.read_target(t.spark, f"{root}/out", order="arrival")


@checked(
    "text_date_range",
    "A8",
    "",
    f"SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{LO}' AND DATE '{HI}' AND event_id % 7 <> 0",
    "event_id",
)
def text_date_range(t: Tables):
    """Dates in three written forms, every seventh one unreadable."""
    forms = (
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
        .when(F.col("event_id") % 3 == 0, F.date_format("ts", "y/M/d"))
        .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyyMMdd"))
    )
    return ig.filter_date_range(t.read("events").withColumn("day", forms), "day", LO, HI)


_LINES = """SELECT day, bytes, sha256 FROM (SELECT day, CAST(strlen(txt) AS BIGINT) AS bytes, sha256(txt) AS sha256 FROM (
  SELECT day, string_agg(line || chr(10), '' ORDER BY event_id) AS txt FROM (
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, event_id || ',' || user_id AS line FROM events) GROUP BY day))"""


def day_files(t: Tables, name: str) -> str:
    """One text file a day, a line for each event in order of its number."""
    path = scratch(t, name)
    lines = t.read("events").select(
        F.to_date("ts").cast("string").alias("day"), "event_id", F.concat_ws(",", "event_id", "user_id").alias("value")
    )
    placed = lines.repartition("day").sortWithinPartitions("day", "event_id").drop("event_id")
    placed.write.partitionBy("day").option("maxRecordsPerFile", 0).text(path)
    return path


def day_sums(files):
    day = F.regexp_extract("file_path", "day=([0-9-]+)", 1)
    return files.select(day.alias("day"), "bytes", "sha256")


@checked("file_checksums", "A9", "", _LINES, "day bytes sha256")
def file_checksums(t: Tables):
    return day_sums(rd.checksum_manifest(t.spark, day_files(t, "sums"), "*.txt"))


@checked(
    "validation_gate",
    "D14",
    "",
    """SELECT c.name, CASE WHEN passes THEN (SELECT count(*) FROM events) ELSE -1 END AS rows
FROM (VALUES ('validated', true), ('failed', false), ('unknown', false), ('changed', false), ('missing', false)) c(name, passes)""",
    "name rows",
)
def validation_gate(t: Tables):
    """Row counts behind the gate; -1 where it refuses."""
    sums = rd.checksum_manifest(t.spark, day_files(t, "gate"), "*.txt").withColumn("name", F.regexp_extract("file_path", "day=([0-9-]+)", 1))
    sums = stage(sums.select("name", "sha256"), "sums")
    first = sums.agg(F.min("name").alias("n"))
    changed = sums.join(F.broadcast(first), F.col("name") == F.col("n"), "left").withColumn(
        "sha256", F.when(F.col("n").isNotNull(), F.lit("0")).otherwise(F.col("sha256"))
    ).drop("n")
    missing = sums.join(F.broadcast(first), F.col("name") == F.col("n"), "left_anti")
    status = lambda s: t.spark.createDataFrame([(s,)] if s else [], "status string")
    out = []
    for name, manifest, now in (
        ("validated", "validated", sums), ("failed", "failed", sums), ("unknown", None, sums),
        ("changed", "validated", changed), ("missing", "validated", missing),
    ):
        try:
            rows = quality.gate_on_validated(t.read("events"), status(manifest), now, sums).count()
        except DataContractError:
            rows = -1
        out.append((name, rows))
    return t.spark.createDataFrame(out, "name string, rows long")


@checked(
    "announcements_from_json",
    "A4",
    "",
    """SELECT CAST(event_id AS VARCHAR) AS announcement_id, CASE WHEN event_type <> 'click' THEN 'announcement' END AS item_type,
  CAST(ts AS DATE) AS item_date FROM events
WHERE event_type <> 'error' AND event_id % 5 <> 0 AND CAST(ts AS DATE) <= DATE '2024-01-12'""",
    "announcement_id item_type item_date",
)
def announcements_from_json(t: Tables):
    """Search responses of some hundred items each, saved as JSON, read and filtered."""
    item = F.struct(
        F.col("announcement_id").alias("id"), "title", F.col("item_type").alias("itemType"),
        F.col("item_date").cast("string").alias("itemDate"), "content",
    )
    page = F.floor(F.col("announcement_id").cast("long") / 500)
    saved = notices(t).groupBy(page.alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("value"))
    path = scratch(t, "responses")
    saved.select("value").write.option("lineSep", "\n").text(path)
    return nt.select_announcements(rd.read_announcements(t.spark, path, multi_line=False), date(2023, 6, 1), date(2023, 12, 12))


@checked("file_checksums_in_pieces", "A9", "", _LINES, "day bytes sha256")
def file_checksums_in_pieces(t: Tables):
    return day_sums(rd.checksum_manifest(t.spark, day_files(t, "pieces"), "*.txt", whole_bytes=0))


@checked("csv_row_counts", "A9", "panel", "SELECT count(*) AS rows FROM panel", "rows")
def csv_row_counts(t: Tables):
    path = scratch(t, "panel-rows")
    wr.write_panel(t.panel.select(*PANEL_TEXT), path, fmt="csv", by_year=False)
    return rd.csv_row_counts(t.spark, path).agg(F.sum("rows").alias("rows"))


@checked("evaluation_files", "A10, K9", "evaluated", summary_sql(), "n_dates", SUMMARY)
def evaluation_files(t: Tables):
    """The exported summary, read back from its JSON file."""
    path = scratch(t, "evaluation")
    daily = evaluate_daily(t.scores, t.extent)
    wr.write_evaluation(daily, evaluation_summary(daily), path)
    return t.spark.read.json(f"{path}/evaluation")


@checked(
    "appended_audit",
    "A11",
    "activity",
    "SELECT trade_date, n_users FROM (SELECT CAST(trade_date AS VARCHAR) AS trade_date, count(*) AS n_users FROM activity GROUP BY 1)",
    "trade_date n_users",
)
def appended_audit(t: Tables):
    """Two appends to one JSON-lines audit."""
    path = scratch(t, "audit")
    daily = activity(t).groupBy("trade_date").agg(F.count("*").alias("n_users"))
    wr.append_audit(daily.where(F.col("trade_date") < F.lit(LO)), path)
    wr.append_audit(daily.where(F.col("trade_date") >= F.lit(LO)), path)
    return t.spark.read.schema("trade_date string, n_users long").json(path)


@checked(
    "result_file",
    "A12",
    "scores",
    """SELECT CAST(trade_date AS VARCHAR) AS trade_date, code AS stock_id, 0.2 AS weight FROM (SELECT *, row_number() OVER
  (PARTITION BY trade_date ORDER BY score DESC, code) AS rn FROM scores) WHERE rn <= 5""",
    "trade_date stock_id",
    "weight",
)
def result_file(t: Tables):
    path = scratch(t, "result")
    wr.write_result(top_k_portfolio(t.scores), path)
    return t.spark.read.csv(
        path, header=True, schema="trade_date string, stock_id string, weight double"
    )


@checked(
    "assembled_market",
    "A13",
    "bars",
    """SELECT code AS ts_code, trade_date, close, adj_factor, turnover_rate,
  code IN (SELECT code FROM bars WHERE vol > 60) AND pos % 5 = 0 AND vol > 60 AS reported_suspend FROM bars""",
    "ts_code trade_date close adj_factor turnover_rate reported_suspend",
)
def assembled_market(t: Tables):
    bars = t.market_bars
    daily = bars.drop("adj_factor", "turnover_rate")
    halted = attach(bars, t.calendar, ["trade_date"], t.extent.dates, "inner").where(
        (F.col("pos") % 5 == 0) & (F.col("vol") > 60)
    )
    return ig.assemble_market(daily, bars, bars, halted.unionByName(halted))


_r = lambda e, d: f"round_even(({e}) * {float(10 ** d)}, 0) / {float(10 ** d)}"


@checked(
    "normalised_bars_v1",
    "A14",
    "bars",
    f"""SELECT code, trade_date, open, close, high, low, vol AS volume,
  {_r('(high - low) / open * 100.0', 2)} AS amplitude, {_r('close - open', 2)} AS change_amt FROM bars""",
    f"{KEYS} open close high low volume amplitude change_amt",
)
def normalised_bars_v1(t: Tables):
    text = t.market_bars.select(
        F.concat(F.lit("sz."), "ts_code").alias("code"),
        F.date_format("trade_date", "yyyy-MM-dd").alias("date"),
        *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "amount")],
        F.col("open").cast("string").alias("preclose"),
        F.col("vol").cast("string").alias("volume"),
        F.col("turnover_rate").cast("string").alias("turn"),
        F.lit("").alias("pctChg"),
    )
    return ig.normalise_bars_v1(text)


@checked(
    "normalised_bars_v2",
    "A15",
    "bars",
    f"""SELECT code, trade_date, {_r('(high - low) / p * 100.0', 2)} AS amplitude, {_r('close - p', 2)} AS change_amt,
  {_r('turnover_rate * 100.0', 4)} AS turnover, {_r('(close - p) / p * 100.0', 4)} AS pct_chg
FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY code ORDER BY trade_date), open) AS p FROM bars)""",
    KEYS,
    "amplitude change_amt turnover pct_chg",
)
def normalised_bars_v2(t: Tables):
    raw = t.market_bars.withColumnsRenamed(
        {"ts_code": "code", "vol": "volume", "turnover_rate": "turnover"}
    )
    return ig.normalise_bars_v2(raw)


@checked(
    "panel_summary",
    "A16",
    "panel",
    "SELECT count(*) AS rows, count(DISTINCT code) AS codes, min(trade_date) AS first_date, max(trade_date) AS last_date FROM panel",
    "rows codes first_date last_date",
)
def panel_summary(t: Tables):
    return ig.panel_summary(t.panel)


@checked(
    "failed_entities",
    "A17",
    "activity",
    f"SELECT DISTINCT code FROM activity WHERE code NOT IN (SELECT code FROM activity WHERE trade_date > DATE '{LATE}')",
    "code",
)
def failed_entities(t: Tables):
    act = activity(t)
    return ig.failed_entities(act, act.where(F.col("trade_date") > F.lit(LATE)))


@checked(
    "resumable_codes",
    "A18",
    "activity",
    f"SELECT DISTINCT code FROM activity WHERE code NOT IN (SELECT code FROM activity WHERE trade_date < DATE '{EARLY}')",
    "code",
)
def resumable_codes(t: Tables):
    done = t.read("events").where(F.to_date("ts") < F.lit(EARLY)).select(F.col("user_id").alias("code"))
    return ig.resume_skip(activity(t).select("code").distinct(), done)


@checked(
    "page_text",
    "B3",
    "",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '(\d)\s+(\d)', '\1\2', 'g'), '(\d)\s+(\d)', '\1\2', 'g') AS plain FROM pages""",
    "page_id plain",
)
def page_text(t: Tables):
    return t.read("pages").select("page_id", tx.plain_text(F.col("html")).alias("plain"))


@checked(
    "scalar_functions",
    "B11, B12, B14",
    "",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS parsed, value / (50.0 + 1e-12) AS ratio,
  CASE WHEN value > 100 THEN 1.0 ELSE pow(value / 100.0, 2) * (3 - 2 * value / 100.0) END AS smooth FROM events""",
    "event_id",
    "parsed ratio smooth",
)
def scalar_functions(t: Tables):
    return t.read("events").select(
        "event_id",
        to_numeric(F.get_json_object("props", "$.k")).alias("parsed"),
        eps_divide(F.col("value"), F.lit(50.0)).alias("ratio"),
        smoothstep(F.col("value") / 100.0).alias("smooth"),
    )


# Every event row is written up as a notice in one of four wordings, so parsing
# runs over the whole table and the expected answer is known from the row.
NOTICE_DAYS = (date(2024, 1, 1), date(2024, 1, 30))
o.cte(
    "weekdays",
    "",
    "SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM events WHERE isodow(ts) <= 5",
)
o.cte(
    "notice",
    "weekdays",
    """SELECT id, day, kind, lpad(CAST(user_id AS VARCHAR), 6, '0') AS gone, lpad(CAST(user_id + 600000 AS VARCHAR), 6, '0') AS come,
  CASE WHEN kind < 3 THEN day END AS stated_date, kind = 1 AS after_close,
  CASE kind WHEN 0 THEN nxt WHEN 2 THEN nxt WHEN 1 THEN later END AS effective_date
FROM (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS day, event_id % 4 AS kind, user_id,
    (SELECT min(trade_date) FROM weekdays WHERE trade_date >= CAST(ts AS DATE)) AS nxt,
    (SELECT min(trade_date) FROM weekdays WHERE trade_date > CAST(ts AS DATE)) AS later
  FROM events)""",
)


def notice_calendar(t: Tables):
    days = t.read("events").select(F.to_date("ts").alias("trade_date"))
    return trading_calendar(days.where(F.weekday("trade_date") < 5))


def notices(t: Tables):
    day = F.to_date("ts")
    year, month, dom = (f(day).cast("string") for f in (F.year, F.month, F.dayofmonth))
    written = F.concat(year, F.lit("年"), month, F.lit("月"), dom, F.lit("日"))
    # Some notices carry formatting spaces inside numbers.
    spaced = F.concat(
        F.substring(year, 1, 3), F.lit(" "), F.substring(year, 4, 1), F.lit(" 年 "),
        month, F.lit(" 月 "), dom, F.lit(" 日"),
    )
    gone = zfill(F.col("user_id").cast("string"))
    come = zfill((F.col("user_id") + 600000).cast("string"))
    kind = F.col("event_id") % 4
    sentence = (
        F.when(kind == 0, F.concat(F.lit("<p>本次调整自<b>"), written, F.lit("</b>起生效。</p>")))
        .when(kind == 1, F.concat(F.lit("<p>于"), written, F.lit("收市后生效。</p>")))
        .when(kind == 2, F.concat(F.lit("<p>实施日期为"), spaced, F.lit("。</p>")))
        .otherwise(F.concat(F.lit("<p>自退市日起调整，涉及"), gone, F.lit("。</p>")))
    )
    decoy = F.lit("<table><tr><td>123456</td><td>调入调出</td></tr></table>")
    table = F.concat(
        F.lit("<table class=\"x\"><tr><td>调出代码</td><td>名称</td><td>调入代码</td><td>名称</td></tr><tr><td> "),
        gone, F.lit("</td><td>甲</td><td><span>"), come, F.lit("</span></td><td>乙</td></tr></table>"),
    )
    return t.dealt("events").select(
        F.col("event_id").cast("string").alias("announcement_id"),
        F.when(F.col("event_type") == "click", F.lit(None))
        .when(F.col("event_type") == "error", F.lit("news"))
        .otherwise(F.lit("announcement"))
        .alias("item_type"),
        F.when(F.col("event_id") % 5 == 0, F.lit("中证500调整"))
        .otherwise(F.lit("关于沪深<em>300</em>的公告"))
        .alias("title"),
        day.alias("item_date"),
        F.concat(sentence, decoy, table).alias("content"),
        F.concat(
            F.lit("沪深 300 指数样本调整名单：\n"), gone, F.lit(" 甲 "), come,
            F.lit(" 乙\n说明 123456\n中证 500 指数样本调整名单\n111111 222222"),
        ).alias("body"),
        gone.alias("gone"),
        come.alias("come"),
        kind.alias("kind"),
    )


@checked(
    "selected_announcements",
    "A4",
    "",
    """SELECT CAST(event_id AS VARCHAR) AS announcement_id FROM events
WHERE event_type <> 'error' AND event_id % 5 <> 0 AND CAST(ts AS DATE) <= DATE '2024-01-12'""",
    "announcement_id",
)
def selected_announcements(t: Tables):
    return nt.select_announcements(notices(t), date(2023, 6, 1), date(2023, 12, 12))


@checked(
    "notice_effective_dates",
    "B4, B5, B6",
    "notice",
    "SELECT id AS announcement_id, stated_date, after_close, effective_date FROM notice",
    "announcement_id stated_date after_close effective_date",
)
def notice_effective_dates(t: Tables):
    return nt.effective_dates(notices(t), notice_calendar(t))


def _both(where: str = "effective_date IS NOT NULL") -> str:
    return f"""SELECT id AS announcement_id, effective_date, gone || '.SZ' AS con_code, 'remove' AS action FROM notice WHERE {where}
UNION ALL SELECT id, effective_date, come || '.SH', 'add' FROM notice WHERE {where}"""


EVENT_COLS = "announcement_id effective_date con_code action"


@checked("notice_table_events", "B7", "notice", _both(), EVENT_COLS)
def notice_table_events(t: Tables):
    dated = nt.effective_dates(notices(t), notice_calendar(t))
    return nt.html_table_events(dated.where(F.col("effective_date").isNotNull()))


SPANNED = """SELECT n.id AS announcement_id, n.effective_date, lpad(CAST(n.user_id + v.shift AS VARCHAR), 6, '0') || v.suffix AS con_code, v.action
FROM (SELECT *, CAST(gone AS BIGINT) AS user_id FROM notice) n,
  (VALUES (0, '.SZ', 'remove'), (0, '.SZ', 'remove'), (1000, '.SZ', 'remove'), (600000, '.SH', 'add'), (300000, '.SZ', 'add'), (601000, '.SH', 'add')) v(shift, suffix, action)
WHERE n.effective_date IS NOT NULL"""


@checked("notice_spanned_events", "B7", "notice", SPANNED, EVENT_COLS)
def notice_spanned_events(t: Tables):
    """Tables whose cells reach over rows and columns: read cell by cell, two codes
    would stand in the wrong column."""

    def code(shift: int):
        return zfill((F.col("gone").cast("long") + shift).cast("string"))

    parts = [
        "<table><tr><th rowspan=3>x</th></tr><tr><td>调出代码</td><td>名称</td><td>调入代码</td><td>名称</td></tr><tr><td rowspan='2'>", code(0),
        "</td><td>甲</td><td>", code(600000), "</td><td rowspan=2>乙</td></tr><tr><td>丙</td><td><b>", code(300000),
        "</b></td></tr><TR><TD ColSpan=\"2\">", code(1000), "</TD><TD colspan = 2>", code(601000), "</TD></TR></table>",
    ]
    spanned = notices(t).withColumn("table", F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    rows = spanned.withColumn("content", F.concat(F.substring_index("content", "<table", 1), "table"))
    dated = nt.effective_dates(rows, notice_calendar(t))
    return nt.html_table_events(dated.where(F.col("effective_date").isNotNull()))


@checked("notice_text_events", "B8", "notice", _both("true"), EVENT_COLS)
def notice_text_events(t: Tables):
    return nt.text_section_events(nt.effective_dates(notices(t), notice_calendar(t)))


@checked(
    "notice_sheet_events",
    "B9",
    "notice",
    _both("CAST(id AS BIGINT) % 3 <> 2"),
    EVENT_COLS,
)
def notice_sheet_events(t: Tables):
    """Sheet rows of two indexes, and of sheets without an index column."""
    dated = nt.effective_dates(notices(t), notice_calendar(t))
    turn = F.col("announcement_id").cast("long") % 3
    sheets = F.array(
        F.struct(F.lit("调出名单").alias("sheet_name"), F.col("gone").alias("code")),
        F.struct(F.lit("调入名单").alias("sheet_name"), F.col("come").alias("code")),
    )
    rows = dated.select(
        "announcement_id",
        "effective_date",
        F.when(turn == 0, "300").when(turn == 2, "905").alias("index_code"),
        F.explode(sheets).alias("s"),
    )
    return nt.sheet_events(rows.select("announcement_id", "effective_date", "index_code", "s.*"))


def overrides(t: Tables):
    """Two hand-kept entries: the smallest and the largest code."""
    ends = t.read("events").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).first()
    rows = [
        (f"{ends['a']:06d}", date(2024, 1, 10), f"{ends['a']:06d}.SZ", "688001.SH", "first"),
        (f"{ends['b']:06d}", date(2024, 1, 11), f"{ends['b']:06d}.SZ", "688002.SH", "second"),
    ]
    return t.spark.createDataFrame(rows, nt.OVERRIDE_SCHEMA)


_ends = "(SELECT lpad(CAST(min(user_id) AS VARCHAR), 6, '0') AS a, lpad(CAST(max(user_id) AS VARCHAR), 6, '0') AS b FROM events)"
DELISTED = f"""SELECT id AS announcement_id, CASE WHEN gone = a THEN DATE '2024-01-10' ELSE DATE '2024-01-11' END AS effective_date,
  u.action, CASE WHEN u.action = 'remove' THEN gone || '.SZ' WHEN gone = a THEN '688001.SH' ELSE '688002.SH' END AS con_code
FROM notice, {_ends}, (VALUES ('remove'), ('add')) u(action) WHERE kind = 3 AND (gone = a OR gone = b)"""


@checked("delisting_events", "B10", "notice", DELISTED, EVENT_COLS)
def delisting_events(t: Tables):
    calendar = notice_calendar(t)
    # The notice's own table is left out: only the reference to a delisting remains.
    bare = notices(t).withColumn("content", F.regexp_replace("content", "(?s)<table.*", ""))
    dated = nt.effective_dates(bare, calendar)
    return nt.override_events(nt.delisting_overrides(dated, overrides(t), calendar))


DELISTED_PARTS = """SELECT id AS announcement_id, DATE '2024-01-08' + CAST(CAST(gone AS BIGINT) % 4 AS INTEGER) AS effective_date, u.action,
  CASE WHEN u.action = 'remove' THEN gone || '.SZ' ELSE lpad(CAST(688000 + k AS VARCHAR), 6, '0') || '.SH' END AS con_code
FROM notice, (SELECT CAST(p_partkey AS BIGINT) AS code, min(p_size) AS k FROM part GROUP BY 1) p, (VALUES ('remove'), ('add')) u(action)
WHERE kind = 3 AND code = CAST(gone AS BIGINT)"""


@checked("delisting_events_by_list", "B10", "notice", DELISTED_PARTS, EVENT_COLS)
def delisting_events_by_list(t: Tables):
    """A list with an entry for every part, and a later one for each that must not apply."""
    code = zfill(F.col("p_partkey").cast("string"))
    day = F.date_add(F.lit(date(2024, 1, 8)), (F.col("p_partkey") % 4).cast("int"))
    add = F.concat((F.col("p_size") + 688000).cast("string"), F.lit(".SH"))
    entry = [code.alias("listed_code"), day.alias("day"), F.concat(code, F.lit(".SZ")).alias("remove"), add.alias("add"), F.lit("list").alias("source")]
    first = t.read("part").select(*entry, F.lit(1).alias("position"))
    later = first.withColumns({"add": F.lit("688999.SH"), "position": F.lit(2)})
    bare = notices(t).withColumn("content", F.substring_index("content", "<table", 1))
    dated = nt.effective_dates(bare, notice_calendar(t))
    return nt.override_events(nt.delisting_overrides(dated, later.unionByName(first), notice_calendar(t)))


@checked(
    "announcement_events",
    "A4, B3-B10",
    "notice",
    _both()
    + f""" UNION ALL SELECT id, CASE WHEN gone = a THEN DATE '2024-01-10' ELSE DATE '2024-01-11' END, x.con_code, x.action
FROM notice, {_ends}, LATERAL (SELECT gone || '.SZ' AS con_code, 'remove' AS action UNION ALL SELECT come || '.SH', 'add') x
WHERE kind = 3 AND (gone = a OR gone = b)""",
    EVENT_COLS,
)
def announcement_events(t: Tables):
    return nt.announcement_events(notices(t), notice_calendar(t), *NOTICE_DAYS, overrides(t))[0]


@checked(
    "notice_parse_errors",
    "B4, B10",
    "notice",
    f"""SELECT id AS announcement_id, 'no effective date' AS error FROM notice, {_ends}
WHERE effective_date IS NULL AND NOT (kind = 3 AND (gone = a OR gone = b))""",
    "announcement_id error",
)
def notice_parse_errors(t: Tables):
    return nt.announcement_events(notices(t), notice_calendar(t), *NOTICE_DAYS, overrides(t))[1]
