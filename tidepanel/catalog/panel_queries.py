"""Bars, calendar, panel construction and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import RESEARCH_START, SIGNAL_END, SIGNAL_START, Tables
from tidepanel.catalog.registry import checked, query
from tidepanel.operators import calendar as cal
from tidepanel.operators import panel as pn
from tidepanel.operators import quality, universe

KEYS = "code trade_date"


@checked("weekly_bars", "A2, A13", "b0", "SELECT * FROM b0", f"{KEYS} open close high low vol amount")
def weekly_bars(t: Tables):
    return t.plain_bars


@checked("trading_calendar", "A19", "cal", "SELECT * FROM cal", "trade_date pos")
def trading_calendar(t: Tables):
    return cal.trading_calendar(t.plain_bars.select("trade_date"))


@checked(
    "research_window",
    "A19",
    "cal",
    f"""SELECT max(CASE WHEN pos = (SELECT count(*) FROM cal WHERE trade_date < DATE '{SIGNAL_END}') - 118
          THEN trade_date END) AS warmup_start,
        max(CASE WHEN pos = (SELECT count(*) FROM cal WHERE trade_date <= DATE '{SIGNAL_END}') + 4
          THEN trade_date END) AS market_end FROM cal""",
    "warmup_start market_end",
)
def research_window(t: Tables):
    found = cal.research_window(t.calendar, SIGNAL_END, SIGNAL_END)
    days = t.calendar.where(F.col("trade_date").isin(*found.values()))
    return days.agg(
        F.min("trade_date").alias("warmup_start"), F.max("trade_date").alias("market_end")
    )


@checked(
    "causal_adjusted_prices",
    "D1",
    "bars",
    """SELECT code, trade_date, open * s AS open, close * s AS close, high * s AS high, low * s AS low
FROM (SELECT *, adj_factor / first_value(adj_factor) OVER (PARTITION BY code ORDER BY trade_date) AS s FROM bars)""",
    f"{KEYS} open close high low",
)
def causal_adjusted_prices(t: Tables):
    return pn.causal_adjust(t.market_bars).withColumnRenamed("ts_code", "code")


@checked(
    "dense_calendar_panel",
    "D2, D3, D4",
    "filled",
    "SELECT * FROM filled",
    f"{KEYS} pos is_suspended open close high low adj_factor turnover",
)
def dense_calendar_panel(t: Tables):
    bars = pn.causal_adjust(t.market_bars).withColumn("code", F.col("ts_code"))
    return pn.densify(bars, t.calendar).withColumn("turnover", F.col("turnover_rate"))


@checked(
    "member_flags",
    "D5",
    "panel",
    "SELECT * FROM panel",
    f"{KEYS} is_member is_suspended is_tradable",
)
def member_flags(t: Tables):
    bars = pn.causal_adjust(t.market_bars).withColumn("code", F.col("ts_code"))
    return pn.mark_members(pn.densify(bars, t.calendar), t.members)


@checked(
    "derived_moves",
    "D6",
    "panel",
    "SELECT * FROM panel",
    f"{KEYS} volume amount turnover amplitude change_amt pct_chg",
)
def derived_moves(t: Tables):
    return t.panel


@checked(
    "pit_labels",
    "D7",
    "panel",
    "SELECT * FROM panel",
    f"{KEYS} label_entry_failed",
    "label",
)
def pit_labels(t: Tables):
    return pn.pit_label(t.panel.drop("label", "label_entry_failed"))


@checked(
    "contest_labels",
    "D8",
    "panel",
    "SELECT code, trade_date, contest_label AS label FROM panel",
    KEYS,
    "label",
)
def contest_labels(t: Tables):
    return pn.contest_label(t.panel)


@checked(
    "legacy_labels",
    "D9",
    "panel",
    """SELECT code, trade_date, (o5 - o1) / (o1 + 1e-12) AS label FROM panel WHERE o1 > 1e-4""",
    KEYS,
    "label",
)
def legacy_labels(t: Tables):
    return pn.legacy_label(t.panel.drop("label"))


@checked(
    "signal_range",
    "D10",
    "panel",
    "SELECT * FROM panel",
    f"{KEYS} in_signal_range",
)
def signal_range(t: Tables):
    return pn.in_signal_range(t.panel.drop("in_signal_range"), SIGNAL_START, SIGNAL_END)


@checked(
    "instrument_index",
    "D11",
    "panel",
    "SELECT code, trade_date, dense_rank() OVER (ORDER BY code) - 1 AS instrument FROM panel",
    f"{KEYS} instrument",
)
def instrument_index(t: Tables):
    return pn.instrument_index(t.panel, t.panel)


@checked(
    "model_panel",
    "L1",
    "panel",
    "SELECT *, 'pit' AS source FROM panel",
    f"{KEYS} open close high low volume amount amplitude change_amt turnover pct_chg adj_factor"
    " is_member is_suspended is_tradable label_entry_failed source in_signal_range",
    "label",
)
def model_panel(t: Tables):
    return pn.build_panel(t.market_bars, t.members, t.calendar, SIGNAL_START, SIGNAL_END)


@checked(
    "quality_report",
    "D13",
    "panel members snap expected",
    """SELECT count(*) AS rows, count(DISTINCT code) AS stocks,
  count(*) FILTER (WHERE is_member AND in_signal_range) AS signal_rows,
  count(*) FILTER (WHERE open IS NULL OR close IS NULL OR high IS NULL OR low IS NULL OR volume IS NULL
    OR amount IS NULL OR turnover IS NULL OR adj_factor IS NULL) AS unexpected_core_null_rows,
  count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high)) AS ohlc_invalid_rows,
  count(*) FILTER (WHERE volume < 0) AS negative_volume_rows,
  count(*) FILTER (WHERE open <= 0 OR close <= 0 OR high <= 0 OR low <= 0) AS nonpositive_price_rows,
  count(*) FILTER (WHERE is_member AND in_signal_range AND label IS NULL) AS candidate_null_label_rows,
  count(*) FILTER (WHERE is_member AND in_signal_range AND label IS NULL AND trade_date NOT IN (
    SELECT DISTINCT trade_date FROM panel WHERE is_member AND in_signal_range ORDER BY trade_date DESC LIMIT 5))
    AS unexpected_candidate_null_label_rows,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT code, trade_date FROM panel)) AS BIGINT) AS duplicate_code_date,
  (SELECT count(*) FROM (SELECT trade_date FROM panel WHERE is_member AND in_signal_range GROUP BY 1
     HAVING count(DISTINCT code) <> (SELECT n FROM expected))) AS bad_member_count_dates,
  (SELECT count(DISTINCT code) FROM members WHERE code NOT IN (
     SELECT code FROM snap WHERE trade_date = (SELECT max(trade_date) FROM snap))) AS historical_removed_stock_count,
  'passed' AS status
FROM panel""",
    "rows stocks signal_rows unexpected_core_null_rows ohlc_invalid_rows negative_volume_rows"
    " nonpositive_price_rows candidate_null_label_rows unexpected_candidate_null_label_rows"
    " duplicate_code_date bad_member_count_dates historical_removed_stock_count status",
)
def quality_report(t: Tables):
    removed = universe.historically_removed(t.members, t.snapshots)
    passed = t.membership.audit["status"] == "passed"
    return quality.quality_report(t.panel, t.expected, removed, passed)
