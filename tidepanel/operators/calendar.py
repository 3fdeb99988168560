"""Trading calendar: ordinals, neighbours and snapping of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.plans.extent import attach
from tidepanel.schemas import DataContractError


def by_day():
    """A calendar holds one row per trading day, so a window over it is small."""
    return Window.orderBy("trade_date")


def trading_calendar(days: DataFrame, open_flag: str | None = "is_open") -> DataFrame:
    """Distinct open days with their ordinal, the unit of time."""
    if open_flag is not None and open_flag in days.columns:
        days = days.where(F.col(open_flag) == 1)
    return (
        days.select(F.col("trade_date").cast("date").alias("trade_date"))
        .where(F.col("trade_date").isNotNull())
        .distinct()
        .withColumn("pos", F.row_number().over(by_day()) - 1)
    )


def research_window(
    calendar: DataFrame, start, end, warmup_days: int = 118, tail_days: int = 5
) -> dict:
    """Warm-up start and market end around the research range [start, end].

    The start is the ``warmup_days``-th trading day before the range, the end
    the ``tail_days``-th after it, or the last known day.
    """
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    row = calendar.agg(
        F.count_if(F.col("trade_date") < start).alias("before"),
        F.count_if(F.col("trade_date") <= end).alias("upto"),
        F.max("pos").alias("last"),
    ).first()
    if row["before"] < warmup_days:
        raise DataContractError(
            f"warm-up needs {warmup_days} trading days, found {row['before']}"
        )
    wanted = {
        "warmup_start": row["before"] - warmup_days,
        "market_end": min(row["upto"] + tail_days - 1, row["last"]),
    }
    days = {
        r["pos"]: r["trade_date"]
        for r in calendar.where(F.col("pos").isin(*wanted.values())).collect()
    }
    return {name: days[pos] for name, pos in wanted.items()}


def day_spine(calendar: DataFrame) -> DataFrame:
    """Every natural day up to the last trading day, with the trading day it
    falls on or before (``same_or_next``) and the one strictly after it."""
    bounds = calendar.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = bounds.select(F.explode(F.sequence("a", "b")).alias("day"))
    ahead = Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    after = Window.orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    joined = days.join(calendar, days["day"] == calendar["trade_date"], "left")
    return joined.select(
        "day",
        F.first("trade_date", ignorenulls=True).over(ahead).alias("same_or_next"),
        F.first("pos", ignorenulls=True).over(ahead).alias("same_or_next_pos"),
        F.first("trade_date", ignorenulls=True).over(after).alias("next_day"),
    )


def calendar_bounds(calendar: DataFrame):
    return calendar.agg(
        F.min("trade_date").alias("first_day"),
        F.max("trade_date").alias("last_day"),
        F.max("pos").alias("last_pos"),
    ).first()


def snap_positions(
    df: DataFrame, date: str, calendar: DataFrame, out: str, edge=None
) -> DataFrame:
    """Ordinal of the first trading day on or after ``date``.

    Earlier than the calendar snaps to its first day; later than its end is NULL.
    ``edge`` are the calendar's bounds where the caller has them.
    """
    edge = edge or calendar_bounds(calendar)
    first, last = edge["first_day"], edge["last_day"]
    spine = day_spine(calendar).select(
        F.col("day").alias("_snap"), F.col("same_or_next_pos").alias(out)
    )
    key = F.greatest(F.col(date), F.lit(first))
    inside = df.withColumn("_snap", F.when(F.col(date) <= F.lit(last), key))
    return attach(inside, spine, ["_snap"], (last - first).days + 1).drop("_snap")


def snap_to_trading_day(
    df: DataFrame, date: str, after_close: str, calendar: DataFrame, out: str = "effective_date"
) -> DataFrame:
    """After-close wording moves to the next trading day; a day off moves
    forward; NULL when the calendar has no such day."""
    edge = calendar_bounds(calendar)
    first, last = edge["first_day"], edge["last_day"]
    spine = day_spine(calendar).select(
        F.col("day").alias("_snap"), "same_or_next", "next_day"
    )
    before_start = F.col(date) < F.lit(first)
    keyed = df.withColumn("_snap", F.col(date))
    return (
        attach(keyed, spine, ["_snap"], (last - first).days + 1)
        .withColumn(
            out,
            F.when(F.col(date).isNull() | (F.col(date) > F.lit(last)), F.lit(None))
            .when(before_start, F.lit(first))
            .when(F.col(after_close), F.col("next_day"))
            .otherwise(F.col("same_or_next"))
            .cast("date"),
        )
        .drop("_snap", "same_or_next", "next_day")
    )
