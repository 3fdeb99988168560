"""How large a panel is: what decides broadcasting and splitting of dates.

A panel has one row per (code, trade_date). The rows of one code are bounded by
the calendar, so windows per code are safe. The rows of one date are bounded
only by the number of codes, and a date-level table only by the calendar, so
plans that work per date ask this measured extent first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
DIRECT_WINDOW_ROWS = 1_000_000
#: Bytes of rows that a task of windows by date sorts at most, unless one date has more.
TASK_BYTES = 128 << 20


@dataclass(frozen=True)
class Extent:
    """Upper bounds: distinct dates, and rows on the fullest date.

    A date of more than ``task_rows`` rows is split into buckets of about
    ``bucket_rows``.
    """

    dates: int
    per_date: int
    task_rows: int = DIRECT_WINDOW_ROWS
    bucket_rows: int = DIRECT_WINDOW_ROWS

    @classmethod
    def measure(cls, df: DataFrame, date: str = "trade_date") -> "Extent":
        row = (
            df.groupBy(date)
            .count()
            .agg(F.count("*").alias("dates"), F.max("count").alias("per_date"))
            .first()
        )
        return cls(int(row["dates"] or 0), int(row["per_date"] or 0))

    @property
    def direct(self) -> bool:
        """True when one date fits a single window task."""
        return self.per_date <= self.task_rows

    def buckets(self, fan_out: int = 1) -> int:
        """Ranges needed for ``fan_out`` groups per date."""
        return max(2, -(-self.dates * self.per_date * fan_out // self.bucket_rows))


def gathered_dates(df: DataFrame, extent: Extent, fan_out: int = 1, date: str = "trade_date") -> DataFrame:
    """``df`` dealt by date for the windows to come.

    Where the session's partitions would hold more than TASK_BYTES (a field counts as
    16 bytes), there are as many as keep tasks that small; otherwise the window's own
    shuffle does. ``fan_out`` is how often a task makes a row stand: adaptive execution
    joins partitions by the size they have before that, so it is not left to it then.
    """
    parts = min(-(-extent.dates * extent.per_date * len(df.columns) * 16 * fan_out // TASK_BYTES), 4 * extent.dates)
    spark = df.sparkSession
    kept = spark.sparkContext.defaultParallelism if fan_out > 1 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df if parts <= kept else df.repartition(parts, date)


def attach(
    df: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    side_rows: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Join a keyed side of ``side_rows`` rows at most.

    Within the limit it is broadcast. Beyond it, or where no bound is known, the
    join shuffles and adaptive execution splits hot keys.
    """
    if side_rows is not None and side_rows <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, list(on), how)


def with_date_stats(
    df: DataFrame,
    extent: Extent,
    date: str = "trade_date",
    **stats: Column,
) -> DataFrame:
    """Add per-date aggregates without gathering a date in one task.

    The aggregation combines map-side, so a hot date costs one row per task.
    """
    side = df.groupBy(date).agg(*[c.alias(name) for name, c in stats.items()])
    return attach(df, side, [date], extent.dates)
