"""Incremental ingest: what to fetch, how to merge, how to normalise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.codes import strip_market_prefix, zfill
from tidepanel.functions.numeric import round_half_even_scaled, to_numeric
from tidepanel.functions.text import parse_date
from tidepanel.schemas import require_none


def by_code():
    return Window.partitionBy("code").orderBy("trade_date")


def plan_fetch_gaps(universe: DataFrame, existing: DataFrame, start, end) -> DataFrame:
    """Date ranges still to be fetched per entity.

    Complete entities give no row; a late start or early end gives the missing
    side; an entity without data gives the whole window.
    """
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    have = (
        existing.where(F.col("trade_date").between(start, end))
        .groupBy("code")
        .agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    )

    def span(first: Column, last: Column, kind: str) -> Column:
        return F.struct(
            first.alias("fetch_start"), last.alias("fetch_end"), F.lit(kind).alias("kind")
        )

    gaps = F.array(
        F.when(F.col("lo").isNull(), span(start, end, "full")),
        F.when(F.col("lo") > start, span(start, F.date_sub("lo", 1), "early")),
        F.when(F.col("hi") < end, span(F.date_add("hi", 1), end, "late")),
    )
    return (
        universe.select("code").distinct()
        .join(have, "code", "left")
        .select("code", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g"))
        .select("code", "g.fetch_start", "g.fetch_end", "g.kind")
    )


def upsert_keep_last(existing: DataFrame, new: DataFrame, keys=("code", "trade_date"), order: str | None = None) -> DataFrame:
    """Union of both, the newer batch winning on equal keys.

    ``max_by`` combines map-side, so no key is gathered. ``order`` ranks rows
    that repeat a key inside one batch.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    values = [c for c in existing.columns if c not in keys]
    rank = F.struct("_batch", *([order] if order else []), *values)
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values]).select(
        *existing.columns
    )


def filter_date_range(rows: DataFrame, date: str, start, end, strict: bool = False) -> DataFrame:
    """Closed range on a text date. Unparsable dates drop, or fail if strict."""
    parsed = rows.withColumn("_date", parse_date(F.col(date)))
    if strict:
        require_none(parsed, F.col("_date").isNull(), f"unparsable {date}")
    inside = F.col("_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return parsed.where(inside).drop("_date")


def assemble_market(
    daily: DataFrame, factors: DataFrame, basics: DataFrame, suspensions: DataFrame
) -> DataFrame:
    """Daily bars with factor, turnover and whether a suspension was reported."""
    keys = ["ts_code", "trade_date"]
    halted = suspensions.select(*keys).distinct().withColumn("_halted", F.lit(True))
    return (
        daily.join(factors.select(*keys, "adj_factor"), keys, "left")
        .join(basics.select(*keys, "turnover_rate"), keys, "left")
        .join(halted, keys, "left")
        .withColumn("reported_suspend", F.col("_halted").isNotNull())
        .drop("_halted")
    )


def normalise_bars_v1(raw: DataFrame) -> DataFrame:
    """Bars that come with the prior close, all columns as text."""
    numbers = ("open", "high", "low", "close", "preclose", "volume", "amount", "turn", "pctChg")
    bars = raw.withColumns({c: to_numeric(F.col(c)) for c in numbers})
    span = F.try_divide(F.col("high") - F.col("low"), F.col("preclose")) * 100.0
    return bars.select(
        strip_market_prefix(F.col("code")).alias("code"),
        parse_date(F.col("date")).alias("trade_date"),
        "open", "close", "high", "low", "volume", "amount",
        round_half_even_scaled(span, 2).alias("amplitude"),
        round_half_even_scaled(F.col("close") - F.col("preclose"), 2).alias("change_amt"),
        F.col("turn").alias("turnover"),
        F.col("pctChg").alias("pct_chg"),
    )


def normalise_bars_v2(raw: DataFrame) -> DataFrame:
    """Bars without a prior close: the last close, or the open on the first row."""
    prior = F.coalesce(F.lag("close").over(by_code()), F.col("open"))
    bars = raw.withColumn("code", zfill(F.col("code"))).withColumn("_prior", prior)
    moved = F.col("close") - F.col("_prior")
    return bars.select(
        "code", "trade_date", "open", "close", "high", "low", "volume", "amount",
        round_half_even_scaled(
            F.try_divide(F.col("high") - F.col("low"), F.col("_prior")) * 100.0, 2
        ).alias("amplitude"),
        round_half_even_scaled(moved, 2).alias("change_amt"),
        round_half_even_scaled(F.col("turnover") * 100.0, 4).alias("turnover"),
        round_half_even_scaled(F.try_divide(moved, F.col("_prior")) * 100.0, 4).alias("pct_chg"),
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count("*").alias("rows"),
        F.countDistinct("code").alias("codes"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
    )


def failed_entities(requested: DataFrame, delivered: DataFrame) -> DataFrame:
    """Requested codes that no delivered row mentions."""
    return requested.select("code").distinct().join(
        delivered.select("code").distinct(), "code", "left_anti"
    )


def resume_skip(universe: DataFrame, completed: DataFrame) -> DataFrame:
    """Codes still to be fetched when resuming."""
    done = completed.select(zfill(F.col("code").cast("string")).alias("code")).distinct()
    return universe.join(done, "code", "left_anti")
