"""Point-in-time membership rebuilt from snapshots and change events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.codes import normalize_ts_code
from tidepanel.operators.calendar import calendar_bounds, snap_positions
from tidepanel.plans.extent import attach
from tidepanel.plans.staging import stage
from tidepanel.schemas import DataContractError, require_columns, require_none

ANCHOR_SOURCE = "tushare_snapshot"  # fixed value: source tag of anchor members


def dedupe_snapshots(snapshots: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per (date, code): the latest arrival, or the largest weight
    where no arrival order is recorded."""
    order = F.col(arrival).desc() if arrival else F.col("weight").desc_nulls_last()
    newest = Window.partitionBy("trade_date", "con_code").orderBy(order)
    return (
        snapshots.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    )


def clean_snapshots(snapshots: DataFrame, arrival: str | None = None) -> DataFrame:
    require_columns(snapshots, ["trade_date", "con_code"], "snapshots")
    if "weight" not in snapshots.columns:
        snapshots = snapshots.withColumn("weight", F.lit(None).cast("double"))
    coded = snapshots.withColumns(
        {
            "trade_date": F.col("trade_date").cast("date"),
            "con_code": normalize_ts_code(F.col("con_code")),
        }
    )
    return dedupe_snapshots(coded, arrival)


def unknown_actions(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.lower("action").isin("add", "remove"), F.lit(False)))


def clean_events(events: DataFrame, check: bool = True) -> DataFrame:
    require_columns(
        events, ["effective_date", "con_code", "action", "source_announcement"], "events"
    )
    if check:
        require_none(
            events,
            ~F.coalesce(F.lower("action").isin("add", "remove"), F.lit(False)),
            "unknown membership action",
        )
    return events.withColumns(
        {
            "effective_date": F.col("effective_date").cast("date"),
            "con_code": normalize_ts_code(F.col("con_code")),
            "action": F.lower("action"),
        }
    )


def anchor_date(snapshots: DataFrame, first_day: date, expected: int) -> date:
    """Latest snapshot not after the first day; a later one must not be used."""
    row = (
        snapshots.where(F.col("trade_date") <= F.lit(first_day))
        .groupBy("trade_date")
        .agg(F.countDistinct("con_code").alias("n"))
        .orderBy(F.desc("trade_date"))
        .first()
    )
    if row is None:
        raise DataContractError("no snapshot on or before the first calendar day")
    if row["n"] != expected:
        raise DataContractError(
            f"anchor {row['trade_date']} has {row['n']} members, expected {expected}"
        )
    return row["trade_date"]


def verdicts(events: DataFrame, anchor: date) -> DataFrame:
    """One verdict per (code, day) after the anchor. On one day additions come
    first, so a code both added and removed ends up removed."""
    return (
        events.where(F.col("effective_date") > F.lit(anchor))
        .groupBy("con_code", "effective_date")
        .agg(F.bool_and(F.col("action") == "add").alias("member"))
    )


def validity_spans(snapshots: DataFrame, events: DataFrame, anchor: date) -> DataFrame:
    """Half-open spans [from_date, to_date) in which a code is a member."""
    changes = verdicts(events, anchor)
    seeds = snapshots.where(F.col("trade_date") == F.lit(anchor)).select(
        "con_code", F.col("trade_date").alias("effective_date"), F.lit(True).alias("member")
    )
    by_code = Window.partitionBy("con_code").orderBy("effective_date")
    return (
        seeds.unionByName(changes)
        .withColumn("to_date", F.lead("effective_date").over(by_code))
        .where("member")
        .select("con_code", F.col("effective_date").alias("from_date"), "to_date")
    )


def reconcile(snapshots: DataFrame, events: DataFrame, anchor: date, last_day: date) -> DataFrame:
    """Rebuilt state against every snapshot from the anchor on: the codes one
    side lacks, per mismatching date.

    The snapshot dates serve as the calendar the spans are expanded on.
    """
    scoped = snapshots.where(
        F.col("trade_date").between(F.lit(anchor), F.lit(last_day))
    )
    when = (
        scoped.select("trade_date")
        .distinct()
        .withColumn("pos", F.row_number().over(Window.orderBy("trade_date")) - 1)
    )
    rebuilt = replay(validity_spans(snapshots, events, anchor), when).select(
        "trade_date", F.col("ts_code").alias("con_code"), F.lit(True).alias("in_rebuild")
    )
    expected = scoped.select("trade_date", "con_code", F.lit(True).alias("in_snapshot"))
    return (
        rebuilt.join(expected, ["trade_date", "con_code"], "full")
        .where(F.col("in_rebuild").isNull() | F.col("in_snapshot").isNull())
        .select(
            "trade_date",
            "con_code",
            F.when(F.col("in_rebuild").isNull(), F.lit("missing_from_rebuild"))
            .otherwise(F.lit("extra_in_rebuild"))
            .alias("finding"),
        )
    )


def mismatch_report(findings: DataFrame) -> DataFrame:
    """Sorted code lists per mismatching snapshot date, for the audit file."""
    def listed(kind: str):
        return F.array_sort(
            F.collect_list(F.when(F.col("finding") == kind, F.col("con_code")))
        ).alias(kind)

    return findings.groupBy("trade_date").agg(
        listed("missing_from_rebuild"), listed("extra_in_rebuild")
    )


def replay(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """Spans to the dense (code, day) membership relation.

    Span ends become calendar positions, and the positions in between are
    generated per span, so no range join is needed.
    """
    edge = calendar_bounds(calendar)
    placed = snap_positions(spans, "from_date", calendar, "pos_from", edge)
    placed = snap_positions(placed, "to_date", calendar, "pos_to", edge)
    days = edge["last_pos"] + 1
    member_days = (
        placed.withColumn("pos_to", F.coalesce("pos_to", F.lit(days)))
        .where("pos_from < pos_to")
        .select("con_code", F.explode(F.sequence("pos_from", F.col("pos_to") - 1)).alias("pos"))
    )
    return (
        attach(member_days, calendar, ["pos"], days)
        .select(
            "trade_date",
            F.substring_index("con_code", ".", 1).alias("code"),
            F.col("con_code").alias("ts_code"),
            "pos",
        )
    )


def matched_snapshot_dates(snapshots: DataFrame, findings: DataFrame, anchor: date, last_day: date) -> DataFrame:
    """Snapshot dates that agree with the rebuilt state; the anchor always does."""
    seen = snapshots.where(
        F.col("trade_date").between(F.lit(anchor), F.lit(last_day))
    ).select("trade_date").distinct()
    bad = findings.select("trade_date").distinct().where(F.col("trade_date") > F.lit(anchor))
    return seen.join(bad, "trade_date", "left_anti")


def as_of_weights(
    daily: DataFrame, snapshots: DataFrame, matched: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Weight and source date from the latest agreeing snapshot on or before
    the day; a code that snapshot lacks has no weight."""
    days = calendar.select("trade_date", F.lit(True).alias("is_day"))
    marks = matched.select("trade_date", F.col("trade_date").alias("mark"))
    # Dates only: as long as the calendar.
    upto = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    source = (
        days.join(marks, "trade_date", "full")
        .withColumn("source_date", F.last("mark", ignorenulls=True).over(upto))
        .where("is_day")
        .select("trade_date", "source_date")
    )
    dated = attach(daily, source, ["trade_date"], calendar_bounds(calendar)["last_pos"] + 1)
    weights = snapshots.select(
        F.col("trade_date").alias("source_date"), F.col("con_code").alias("ts_code"), "weight"
    )
    return dated.join(weights, ["source_date", "ts_code"], "left")


def count_breaks(daily: DataFrame, expected: int) -> DataFrame:
    return (
        daily.groupBy("trade_date").agg(F.count("*").alias("members"))
        .where(F.col("members") != expected)
    )


def membership_intervals(
    daily: DataFrame, events: DataFrame, anchor: date, last_day: date, passed: bool
) -> DataFrame:
    """Maximal runs of consecutive calendar positions per code.

    The last day is inclusive. The source is that of the code's last addition
    in the whole replay, whichever interval it belongs to.
    """
    by_code = Window.partitionBy("ts_code").orderBy("pos")
    runs = daily.withColumn("_run", F.col("pos") - F.row_number().over(by_code))
    spans = runs.groupBy("ts_code", "code", "_run").agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date")
    )
    replayed = events.where(
        (F.col("effective_date") > F.lit(anchor)) & (F.col("effective_date") <= F.lit(last_day))
    )
    added = (
        replayed.where(F.col("action") == "add")
        .groupBy(F.col("con_code").alias("ts_code"))
        .agg(
            F.max_by(
                "source_announcement", F.struct("effective_date", "source_announcement")
            ).alias("_added")
        )
    )
    return spans.join(added, "ts_code", "left").select(
        "code",
        "ts_code",
        "start_date",
        "end_date",
        F.coalesce("_added", F.lit(f"{ANCHOR_SOURCE}:{anchor}")).alias("source_announcement"),
        F.lit("passed" if passed else "failed").alias("status"),
    )


@dataclass(frozen=True)
class Membership:
    anchor: date
    daily: DataFrame
    intervals: DataFrame
    findings: DataFrame
    breaks: DataFrame
    audit: dict


def build_membership(
    snapshots: DataFrame,
    events: DataFrame,
    calendar: DataFrame,
    start,
    end,
    expected: int,
    arrival: str | None = None,
) -> Membership:
    """Replay the events from the anchor snapshot and check every later one.

    The cleaned inputs, the daily relation and the findings are written once, since
    the checks, the intervals and every later step read them.
    ``findings`` and ``breaks`` are exceptions only; a failing audit is meant
    to stop the build.
    """
    # Checks, spans, weights and counts read both, so they are cleaned once.
    snaps = stage(clean_snapshots(snapshots, arrival), "clean-snapshots")
    changes = stage(clean_events(events), "clean-events")
    research = (
        calendar.where(
            F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        )
        .select("trade_date")
        .withColumn("pos", F.row_number().over(Window.orderBy("trade_date")) - 1)
    )
    research = stage(research, "research-days")
    edge = research.agg(
        F.min("trade_date").alias("a"), F.max("trade_date").alias("b"), F.count("*").alias("n")
    ).first()
    if not edge["n"]:
        raise DataContractError("no trading day in the research range")
    anchor = anchor_date(snaps, edge["a"], expected)
    findings = stage(reconcile(snaps, changes, anchor, edge["b"]), "findings")
    matched = matched_snapshot_dates(snaps, findings, anchor, edge["b"])
    replayed = replay(validity_spans(snaps, changes, anchor), research)
    daily = stage(as_of_weights(replayed, snaps, matched, research), "membership")
    breaks = count_breaks(daily, expected)
    counts = {
        "snapshot_dates": snaps.select("trade_date").distinct().count(),
        "event_count": changes.where(F.col("effective_date") > F.lit(anchor)).count(),
        "union_stock_count": daily.select("ts_code").distinct().count(),
        "mismatch_dates": findings.select("trade_date").distinct().count(),
        "bad_count_dates": breaks.count(),
    }
    passed = counts["mismatch_dates"] == 0 and counts["bad_count_dates"] == 0
    audit = {
        "anchor_date": str(anchor),
        "calendar_days": edge["n"],
        **counts,
        "status": "passed" if passed else "failed",
    }
    intervals = membership_intervals(daily, changes, anchor, edge["b"], passed)
    return Membership(anchor, daily, intervals, findings, breaks, audit)


def audit_row(membership: Membership) -> DataFrame:
    spark = membership.daily.sparkSession
    return spark.createDataFrame([membership.audit])


def infer_events(
    events: DataFrame,
    snapshots: DataFrame,
    official: list[dict],
) -> DataFrame:
    """Fill announced dates that carry no parsed event from snapshot diffs.

    ``official`` lists ``effective_date``, ``source`` and ``expected_changes``.
    Both sides of the diff must have the announced size.
    """
    spark = events.sparkSession
    given = [(str(o["effective_date"]), o["source"], int(o["expected_changes"])) for o in official]
    specs = spark.createDataFrame(given, "day string, source string, expected long").withColumn("day", F.col("day").cast("date"))
    parsed = events.select(F.col("effective_date").alias("day")).distinct()
    open_specs = specs.join(parsed, "day", "left_anti")
    # Announced days between the snapshot dates around them; as short as the calendar.
    dates = snapshots.select(F.col("trade_date").alias("day")).distinct()
    line = dates.select("day", F.col("day").alias("snap"), F.lit(1).alias("kind")).unionByName(
        open_specs.select("day", "source", "expected", F.lit(0).alias("kind")), allowMissingColumns=True
    )
    order = Window.orderBy("day", "kind")
    placed = line.withColumns(
        {
            "before": F.last("snap", True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "after": F.first("snap", True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    ).where("kind = 0").select("day", "source", "expected", "before", "after")
    codes = snapshots.select("trade_date", normalize_ts_code(F.col("con_code")).alias("con_code")).distinct()
    side = lambda name: placed.select("day", F.col(name).alias("trade_date")).join(codes, "trade_date").select("day", "con_code", F.lit(True).alias(name))
    changes = (
        side("before").join(side("after"), ["day", "con_code"], "full")
        .where(F.col("before").isNull() | F.col("after").isNull())
        .select("day", "con_code", F.when(F.col("after").isNull(), "remove").otherwise("add").alias("action"))
    )
    sizes = changes.groupBy("day").agg(
        F.count_if(F.col("action") == "remove").alias("removed"), F.count_if(F.col("action") == "add").alias("added")
    )
    wrong = placed.join(sizes, "day", "left").where(
        F.col("before").isNull() | F.col("after").isNull()
        | ~F.col("removed").eqNullSafe(F.col("expected")) | ~F.col("added").eqNullSafe(F.col("expected"))
    ).orderBy("day").first()
    if wrong is not None:
        if wrong["before"] is None or wrong["after"] is None:
            raise DataContractError(f"{wrong['day']}: no snapshot on both sides")
        raise DataContractError(
            f"{wrong['day']}: announced {wrong['expected']} changes, "
            f"snapshots show {wrong['removed'] or 0} out and {wrong['added'] or 0} in"
        )
    source = F.concat_ws("", "source", F.lit(";"), F.col("before").cast("string"), F.lit("->"), F.col("after").cast("string"))
    found = changes.join(placed, "day").select(
        F.col("day").alias("effective_date"), "con_code", "action", source.alias("source_announcement")
    )
    return dedupe_events(events.unionByName(found))


def dedupe_events(events: DataFrame) -> DataFrame:
    """One row per (day, code, action); the smallest source is kept."""
    return events.groupBy("effective_date", "con_code", "action").agg(
        F.min("source_announcement").alias("source_announcement")
    )


def diff_events(snapshots: DataFrame, source: str = "snapshot_diff") -> DataFrame:
    """Add and remove events between every two consecutive snapshots."""
    dates = snapshots.select("trade_date").distinct()
    order = Window.orderBy("trade_date")
    steps = dates.select(
        "trade_date",
        F.lag("trade_date").over(order).alias("previous"),
        F.lead("trade_date").over(order).alias("following"),
    )
    kept = snapshots.select("trade_date", "con_code").join(steps, "trade_date")
    by_code = Window.partitionBy("con_code").orderBy("trade_date")
    marked = kept.withColumns(
        {
            "_seen_before": F.lag("trade_date").over(by_code),
            "_seen_after": F.lead("trade_date").over(by_code),
        }
    )
    added = marked.where(
        F.col("previous").isNotNull() & ~F.col("_seen_before").eqNullSafe(F.col("previous"))
    ).select(F.col("trade_date").alias("effective_date"), "con_code", F.lit("add").alias("action"))
    removed = marked.where(
        F.col("following").isNotNull() & ~F.col("_seen_after").eqNullSafe(F.col("following"))
    ).select(F.col("following").alias("effective_date"), "con_code", F.lit("remove").alias("action"))
    return added.unionByName(removed).withColumn(
        "source_announcement", F.concat(F.lit(f"{source}:"), F.col("effective_date").cast("string"))
    )


def historically_removed(daily: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Codes that were members at some time but are not in the newest snapshot."""
    newest = snapshots.agg(F.max("trade_date").alias("trade_date"))
    # ``newest`` is a single row.
    current = snapshots.join(F.broadcast(newest), "trade_date", "left_semi").select(
        F.substring_index(normalize_ts_code(F.col("con_code")), ".", 1).alias("code")
    )
    return daily.select("code").distinct().join(current, "code", "left_anti")
