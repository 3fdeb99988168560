"""Membership reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.catalog.base import RESEARCH_START, SIGNAL_END, Tables
from tidepanel.catalog.registry import checked
from tidepanel.functions.codes import normalize_ts_code, pure_code, zfill
from tidepanel.operators import universe as un

RANGE = f"trade_date BETWEEN DATE '{RESEARCH_START}' AND DATE '{SIGNAL_END}'"
TS = "code || CASE WHEN code[1] IN ('5', '6', '9') THEN '.SH' ELSE '.SZ' END"
PREV = """(SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev
 FROM (SELECT DISTINCT trade_date FROM snap))"""
EVENTS = f"""SELECT d.trade_date AS effective_date, s.code, 'add' AS action
  FROM snap s JOIN {PREV} d USING (trade_date)
  WHERE d.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap p WHERE p.trade_date = d.prev AND p.code = s.code)
UNION ALL
SELECT d.trade_date, s.code, 'remove'
  FROM {PREV} d JOIN snap s ON s.trade_date = d.prev
  WHERE NOT EXISTS (SELECT 1 FROM snap n WHERE n.trade_date = d.trade_date AND n.code = s.code)"""


@checked(
    "deduped_snapshots",
    "C1",
    "snap",
    f"SELECT trade_date, {TS} AS con_code, recent_amt AS weight FROM snap",
    "trade_date con_code weight",
)
def deduped_snapshots(t: Tables):
    """Every row arrives twice, an outdated weight first."""
    newer = t.snapshots.withColumn("batch", F.lit(2))
    older = t.snapshots.withColumns({"weight": F.col("weight") * 2, "batch": F.lit(1)})
    return un.clean_snapshots(older.unionByName(newer), arrival="batch")


@checked(
    "snapshot_diff_events",
    "C10",
    "snap",
    f"SELECT effective_date, {TS} AS con_code, action FROM ({EVENTS})",
    "effective_date con_code action",
)
def snapshot_diff_events(t: Tables):
    return un.diff_events(t.snapshots)


@checked(
    "unknown_actions",
    "C2",
    "snap",
    f"SELECT count(*) AS n FROM ({EVENTS}) WHERE action = 'remove'",
    "n",
)
def unknown_actions(t: Tables):
    """Misspelled removals are all found."""
    misspelled = t.events.withColumn(
        "action", F.when(F.col("action") == "remove", F.lit("drop")).otherwise(F.upper("action"))
    )
    return un.unknown_actions(misspelled).agg(F.count("*").alias("n"))


@checked(
    "anchor_snapshot",
    "C3",
    "snap",
    f"""SELECT trade_date, count(*) AS members FROM snap
WHERE trade_date = (SELECT max(trade_date) FROM snap WHERE trade_date <= DATE '{RESEARCH_START}') GROUP BY 1""",
    "trade_date members",
)
def anchor_snapshot(t: Tables):
    day = un.anchor_date(t.snapshots, RESEARCH_START, t.expected)
    return (
        t.snapshots.where(F.col("trade_date") == F.lit(day))
        .groupBy("trade_date")
        .agg(F.count("*").alias("members"))
    )


@checked(
    "daily_membership",
    "C4, C5",
    "members",
    f"SELECT trade_date, code, {TS} AS ts_code, source_date, weight FROM members",
    "trade_date code ts_code source_date weight",
)
def daily_membership(t: Tables):
    return t.membership.daily


@checked(
    "reconcile_with_gaps",
    "C6",
    "snap",
    f"""SELECT s.trade_date, {TS} AS con_code, 'missing_from_rebuild' AS finding
FROM (SELECT x.trade_date, x.code, max(e.effective_date) AS since
      FROM snap x JOIN ({EVENTS}) e ON e.code = x.code AND e.effective_date <= x.trade_date
        AND e.action = 'add' AND e.effective_date > (SELECT max(trade_date) FROM snap WHERE trade_date <= DATE '{RESEARCH_START}')
      WHERE x.{RANGE} GROUP BY 1, 2) s
WHERE NOT EXISTS (SELECT 1 FROM ({EVENTS}) e WHERE e.code = s.code AND e.action = 'remove'
  AND e.effective_date > s.since AND e.effective_date <= s.trade_date)""",
    "trade_date con_code finding",
)
def reconcile_with_gaps(t: Tables):
    """Without the additions, every re-added code is missing from the rebuild."""
    removals = t.events.where(F.col("action") == "remove")
    anchor = un.anchor_date(t.snapshots, RESEARCH_START, t.expected)
    return un.reconcile(t.snapshots, removals, anchor, SIGNAL_END)


@checked(
    "reconcile_report",
    "C6",
    "snap",
    f"""SELECT trade_date, list(con_code ORDER BY con_code) AS missing_from_rebuild FROM (
SELECT s.trade_date, {TS} AS con_code
FROM (SELECT x.trade_date, x.code, max(e.effective_date) AS since
      FROM snap x JOIN ({EVENTS}) e ON e.code = x.code AND e.effective_date <= x.trade_date
        AND e.action = 'add' AND e.effective_date > (SELECT max(trade_date) FROM snap WHERE trade_date <= DATE '{RESEARCH_START}')
      WHERE x.{RANGE} GROUP BY 1, 2) s
WHERE NOT EXISTS (SELECT 1 FROM ({EVENTS}) e WHERE e.code = s.code AND e.action = 'remove'
  AND e.effective_date > s.since AND e.effective_date <= s.trade_date)) GROUP BY 1""",
    "trade_date missing_from_rebuild",
)
def reconcile_report(t: Tables):
    return un.mismatch_report(reconcile_with_gaps(t))


@checked(
    "daily_count_breaks",
    "C7",
    "members expected",
    """SELECT trade_date, count(*) AS members FROM members
WHERE code <> (SELECT max(code) FROM members) GROUP BY 1 HAVING count(*) <> (SELECT n FROM expected)""",
    "trade_date members",
)
def daily_count_breaks(t: Tables):
    """Dropping one code breaks the count on exactly its member days."""
    last = t.members.agg(F.max("code")).first()[0]
    return un.count_breaks(t.members.where(F.col("code") != last), t.expected)


@checked(
    "membership_intervals",
    "C8",
    "members snap",
    f"""SELECT m.code, min(m.trade_date) AS start_date, max(m.trade_date) AS end_date,
  coalesce('snapshot_diff:' || max(a.d), 'tushare_snapshot:' || (SELECT max(trade_date) FROM snap
     WHERE trade_date <= DATE '{RESEARCH_START}')) AS source_announcement, 'passed' AS status
FROM (SELECT x.code, x.trade_date, c.pos - row_number() OVER (PARTITION BY x.code ORDER BY x.trade_date) AS run
      FROM members x JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos
        FROM (SELECT DISTINCT trade_date FROM members)) c USING (trade_date)) m
LEFT JOIN (SELECT code, max(effective_date) AS d FROM ({EVENTS}) WHERE action = 'add'
  AND effective_date > (SELECT max(trade_date) FROM snap WHERE trade_date <= DATE '{RESEARCH_START}')
  AND effective_date <= DATE '{SIGNAL_END}' GROUP BY 1) a ON a.code = m.code
GROUP BY m.code, m.run""",
    "code start_date end_date source_announcement status",
)
def membership_intervals(t: Tables):
    return t.membership.intervals


@checked(
    "membership_audit",
    "C9",
    "members snap cal",
    f"""SELECT CAST((SELECT max(trade_date) FROM snap WHERE trade_date <= DATE '{RESEARCH_START}') AS VARCHAR) AS anchor_date,
  (SELECT count(*) FROM cal WHERE {RANGE}) AS calendar_days,
  (SELECT count(DISTINCT trade_date) FROM snap) AS snapshot_dates,
  (SELECT count(*) FROM ({EVENTS}) WHERE effective_date > (SELECT max(trade_date) FROM snap
     WHERE trade_date <= DATE '{RESEARCH_START}')) AS event_count,
  (SELECT count(DISTINCT code) FROM members) AS union_stock_count, 'passed' AS status""",
    "anchor_date calendar_days snapshot_dates event_count union_stock_count status",
)
def membership_audit(t: Tables):
    return un.audit_row(t.membership)


@checked(
    "inferred_events",
    "C10",
    "snap",
    f"""SELECT effective_date, {TS} AS con_code, action FROM ({EVENTS})
WHERE effective_date = (SELECT max(trade_date) FROM snap)""",
    "effective_date con_code action",
)
def inferred_events(t: Tables):
    """The newest change is announced but was not parsed."""
    day = t.snapshots.agg(F.max("trade_date")).first()[0]
    known = t.events.where(F.col("effective_date") < F.lit(day))
    size = t.events.where((F.col("effective_date") == F.lit(day)) & (F.col("action") == "add")).count()
    official = [{"effective_date": day, "source": "official", "expected_changes": size}]
    return un.infer_events(known, t.snapshots, official).where(
        F.col("effective_date") == F.lit(day)
    )


@checked(
    "deduped_events",
    "C11",
    "snap",
    f"SELECT effective_date, {TS} AS con_code, action FROM ({EVENTS})",
    "effective_date con_code action",
)
def deduped_events(t: Tables):
    return un.dedupe_events(t.events.unionByName(t.events))


@checked(
    "historically_removed",
    "C12",
    "members snap",
    """SELECT DISTINCT code FROM members WHERE code NOT IN (
SELECT code FROM snap WHERE trade_date = (SELECT max(trade_date) FROM snap))""",
    "code",
)
def historically_removed(t: Tables):
    return un.historically_removed(t.members, t.snapshots)


@checked(
    "normalized_codes",
    "B1, B2",
    "",
    """SELECT s_suppkey, digits || '.' || CASE WHEN s_suppkey % 4 = 1 THEN 'SH' WHEN s_suppkey % 4 = 3 THEN 'SZ'
  WHEN digits[1] IN ('5', '6', '9') THEN 'SH' ELSE 'SZ' END AS qualified, digits AS pure
FROM (SELECT s_suppkey, lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS digits FROM supplier)""",
    "s_suppkey qualified pure",
)
def normalized_codes(t: Tables):
    """Codes of both exchanges: a number with decimals, qualified in either case, or prefixed."""
    number = F.col("s_suppkey") * 7919 % 1000000
    digits = zfill(number.cast("string"))
    text = (
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit(" "), number.cast("string"), F.lit(".0")))
        .when(F.col("s_suppkey") % 4 == 1, F.concat(digits, F.lit(".SH ")))
        .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("sz."), digits))
        .otherwise(F.concat(digits, F.lit(".sz")))
    )
    return t.read("supplier").select(
        "s_suppkey", normalize_ts_code(text).alias("qualified"), pure_code(text).alias("pure")
    )
