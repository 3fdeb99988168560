"""Chronological splits by trading-day ordinal.

A split depends on the ordered list of dates only, which is as short as the
calendar. Results are tables of segments: name, first day, last day, days.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.schemas import DataContractError, require_none

SEGMENTS = "segment string, start_date date, end_date date, n_days int"


def distinct_days(df: DataFrame) -> DataFrame:
    return (
        df.select(F.col("trade_date").cast("date").alias("trade_date"))
        .distinct()
        .withColumn("ordinal", F.row_number().over(Window.orderBy("trade_date")) - 1)
    )


def date_range_split(
    panel: DataFrame, train: tuple, test: tuple, strict_dates: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two closed ranges over the signal rows. ``strict_dates`` names a text
    date column in which an unparsable value is an error."""
    if strict_dates is not None:
        require_none(panel, F.col("trade_date").isNull(), f"unparsable {strict_dates}")
    if "in_signal_range" in panel.columns:
        panel = panel.where("in_signal_range")

    def part(bounds):
        low, high = (F.lit(b).cast("date") for b in bounds)
        return panel.where(F.col("trade_date").between(low, high))

    for bounds in (train, test):
        if str(bounds[0]) > str(bounds[1]):
            raise DataContractError(f"range starts after it ends: {bounds}")
    return part(train), part(test)


def business_days_before(day: Column, n: int) -> Column:
    """The date ``n`` weekdays before ``day``.

    Stepping back from a weekend first lands on Friday; zero steps from a
    weekend move to Monday.
    """
    weekday = F.weekday(day)  # Monday = 0
    weekend = weekday >= 5
    if n == 0:
        return F.when(weekend, F.date_add(day, 7 - weekday)).otherwise(day)
    anchor = F.when(weekend, F.date_sub(day, weekday - 4)).otherwise(day)
    left = F.when(weekend, F.lit(n - 1)).otherwise(F.lit(n))
    at = F.when(weekend, F.lit(4)).otherwise(weekday)
    weeks = F.floor(left / 5).cast("int")
    rest = (left - weeks * 5).cast("int")
    extra = F.when(rest > at, rest + 2).otherwise(rest)
    return F.date_sub(anchor, (weeks * 7 + extra).cast("int"))


def last_two_months_split(panel: DataFrame, length: int) -> tuple[DataFrame, DataFrame, date]:
    """Train before the last two months; validation from there, with enough
    weekdays of context in front for its first sequence."""
    row = (
        panel.agg(F.max("trade_date").alias("last"))
        .select(F.add_months("last", -2).alias("start"))
        .select("start", business_days_before(F.col("start"), length - 1).alias("context"))
        .first()
    )
    train = panel.where(F.col("trade_date") < F.lit(row["start"]))
    validation = panel.where(F.col("trade_date") >= F.lit(row["context"]))
    return train, validation, row["start"]


def recent_years(panel: DataFrame, years: int | None) -> DataFrame:
    """Rows from ``years`` calendar years before the latest date, inclusive."""
    if years is None:
        return panel
    if years <= 0:
        raise DataContractError("the number of years must be positive")
    row = panel.agg(F.add_months(F.max("trade_date"), -12 * int(years)).alias("cutoff")).first()
    return panel.where(F.col("trade_date") >= F.lit(row["cutoff"]))


def narrow_window(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Signal rows if flagged, else member rows, within optional bounds."""
    for flag in ("in_signal_range", "is_member"):
        if flag in panel.columns:
            panel = panel.where(F.col(flag))
            break
    if start is not None:
        panel = panel.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        panel = panel.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return panel


def ratio_day_counts(
    n_days: int, ratios: Sequence[float] = (0.70, 0.15, 0.15), gap_days: int = 5
) -> tuple[int, int, int]:
    """Days per part after both gaps; halves round to even, the test takes the rest."""
    if len(ratios) != 3 or any(float(r) <= 0 for r in ratios):
        raise DataContractError("three positive ratios are needed")
    usable = n_days - 2 * int(gap_days)
    if usable < 3:
        raise DataContractError("too few days after the gaps")
    total = float(sum(ratios))
    train = round(usable * (float(ratios[0]) / total))
    validation = round(usable * (float(ratios[1]) / total))
    test = usable - train - validation
    if min(train, validation, test) <= 0:
        raise DataContractError("a part would be empty")
    return train, validation, test


def segments(days: DataFrame, lengths: Sequence[tuple[str, int]], first: int = 0) -> DataFrame:
    """Consecutive ordinal ranges as a segment table; empty ones have no dates."""
    label = F.lit(None).cast("string")
    at = first
    for name, length in lengths:
        label = F.when(
            (F.col("ordinal") >= at) & (F.col("ordinal") < at + length), F.lit(name)
        ).otherwise(label)
        at += length
    found = days.withColumn("segment", label).where(F.col("segment").isNotNull())
    filled = found.groupBy("segment").agg(
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.count("*").cast("int").alias("n_days"),
    )
    names = days.sparkSession.createDataFrame([(n,) for n, _ in lengths], "segment string")
    return F.broadcast(names).join(filled, "segment", "left").select(
        "segment", "start_date", "end_date", F.coalesce("n_days", F.lit(0)).alias("n_days")
    )


def purged_split(
    panel: DataFrame,
    train_days: int,
    val_days: int,
    test_days: int,
    gap_days: int = 5,
    gap2_days: int | None = None,
) -> DataFrame:
    """train / gap1 / validation / gap2 / test from the first day on.

    The gaps keep labels of one part out of the next. Without test days there
    is neither gap2 nor test.
    """
    gap2 = gap_days if gap2_days is None else int(gap2_days)
    if gap2 < 0 or test_days < 0:
        raise DataContractError("gap2 and test days must not be negative")
    if test_days == 0:
        gap2 = 0
    lengths = [
        ("train", train_days),
        ("gap1", gap_days),
        ("validation", val_days),
        ("gap2", gap2),
        ("test", test_days),
    ]
    days = distinct_days(panel)
    have, need = days.count(), sum(n for _, n in lengths)
    if have < need:
        raise DataContractError(f"{need} trading days needed, {have} present")
    return segments(days, lengths)


def single_signal_split(
    panel: DataFrame, train_days: int | None = None, train_end=None
) -> DataFrame:
    """One signal day followed by five scored days.

    Training labels end where their exit falls on the signal day at the
    latest. The embargo runs up to and including the signal day.
    """
    if train_days is not None and train_end is not None:
        raise DataContractError("give a window length or an end date, not both")
    days = distinct_days(panel)
    n = days.count()
    first = 0
    if train_days is not None:
        if train_days <= 0:
            raise DataContractError("the training window must be positive")
        if n < train_days + 10:
            raise DataContractError(f"{train_days + 10} trading days needed, {n} present")
        first = n - (train_days + 10)
    if n - first < 12:
        raise DataContractError("too few trading days")
    signal = n - 6
    train_stop = n - 10
    if train_end is not None:
        train_stop = days.where(F.col("trade_date") <= F.lit(train_end).cast("date")).count()
        if train_stop <= first:
            raise DataContractError("no training day up to the end date")
        if signal - (train_stop - 1) < 5:
            raise DataContractError("less than five trading days between training and signal")
    lengths = [
        ("train", train_stop - first),
        ("embargo_context", signal + 1 - train_stop),
        ("test", 5),
    ]
    named = segments(days, lengths, first)
    marked = days.where(F.col("ordinal") == signal).select(
        F.lit("signal").alias("segment"),
        F.col("trade_date").alias("start_date"),
        F.col("trade_date").alias("end_date"),
        F.lit(1).alias("n_days"),
    )
    return named.unionByName(marked)


def assign_segments(panel: DataFrame, split: DataFrame) -> DataFrame:
    """Tag every row with its segment. The split has a handful of rows, which
    become literals of one CASE expression."""
    tag = F.lit(None).cast("string")
    for row in split.where(F.col("start_date").isNotNull()).collect():
        inside = F.col("trade_date").between(F.lit(row["start_date"]), F.lit(row["end_date"]))
        tag = F.when(inside & F.lit(row["segment"] != "signal"), F.lit(row["segment"])).otherwise(tag)
    return panel.withColumn("segment", tag)


def refit_rows(panel: DataFrame, split: DataFrame) -> DataFrame:
    """Rows from train through validation for a refit.

    Rows of the first gap stay as context without a label and do not count as
    fit rows.
    """
    tagged = assign_segments(panel, split)
    gap = F.coalesce(F.col("segment") == "gap1", F.lit(False))
    used = F.coalesce(F.col("segment").isin("train", "validation"), F.lit(False))
    return tagged.withColumns(
        {"label": F.when(~gap, F.col("label")), "is_refit_row": used}
    )
