"""Quality report of a built panel, and the gate in front of its users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.schemas import PRICES, DataContractError, require_columns

CORE = (*PRICES, "volume", "amount", "turnover", "adj_factor")
TAIL_DAYS = 5


def quality_counts(panel: DataFrame) -> DataFrame:
    """Row-level findings in one pass over the panel."""
    require_columns(panel, [*CORE, "is_member", "in_signal_range", "label"], "quality report")
    last_days = (
        panel.where(F.col("is_member") & F.col("in_signal_range"))
        .select("trade_date")
        .distinct()
        .orderBy(F.desc("trade_date"))
        .limit(TAIL_DAYS)
    )
    # At most five dates.
    tail_start = last_days.agg(F.min("trade_date").alias("d")).first()["d"]
    null_core = F.lit(False)
    for c in CORE:
        null_core = null_core | F.col(c).isNull()
    nonpositive = F.lit(False)
    for c in PRICES:
        nonpositive = nonpositive | (F.col(c) <= 0)
    bad_range = (F.col("high") < F.greatest("open", "close", "low")) | (
        F.col("low") > F.least("open", "close", "high")
    )
    signal = F.col("is_member") & F.col("in_signal_range")
    unlabelled = signal & F.col("label").isNull()
    early = F.col("trade_date") < F.lit(tail_start)
    return panel.agg(
        F.count("*").alias("rows"),
        F.countDistinct("code").alias("stocks"),
        F.count_if(signal).alias("signal_rows"),
        F.count_if(null_core).alias("unexpected_core_null_rows"),
        F.count_if(bad_range).alias("ohlc_invalid_rows"),
        F.count_if(F.col("volume") < 0).alias("negative_volume_rows"),
        F.count_if(nonpositive).alias("nonpositive_price_rows"),
        F.count_if(unlabelled).alias("candidate_null_label_rows"),
        F.count_if(unlabelled & early).alias("unexpected_candidate_null_label_rows"),
    )


def duplicate_keys(panel: DataFrame) -> DataFrame:
    return panel.groupBy("code", "trade_date").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_code_date")
    )


def bad_count_dates(panel: DataFrame, expected: int) -> DataFrame:
    """Signal dates whose number of distinct members is not the expected one."""
    return (
        panel.where(F.col("is_member") & F.col("in_signal_range"))
        .groupBy("trade_date")
        .agg(F.countDistinct("code").alias("members"))
        .where(F.col("members") != expected)
    )


FAILURES = (
    "duplicate_code_date",
    "unexpected_core_null_rows",
    "ohlc_invalid_rows",
    "negative_volume_rows",
    "nonpositive_price_rows",
    "unexpected_candidate_null_label_rows",
)


def quality_report(
    panel: DataFrame, expected: int, removed: DataFrame, membership_passed: bool
) -> DataFrame:
    """One row: counts, list of failed checks, and the status.

    ``removed`` are the codes that left the universe; a panel without any
    suffers from survivorship.
    """
    single = lambda df: df.withColumn("_one", F.lit(1))
    joined = single(quality_counts(panel))
    for part in (
        duplicate_keys(panel),
        bad_count_dates(panel, expected).agg(F.count("*").alias("bad_member_count_dates")),
        removed.agg(F.countDistinct("code").alias("historical_removed_stock_count")),
    ):
        joined = joined.join(single(part), "_one")
    conditions = {
        "membership_reconciliation": F.lit(not membership_passed),
        "no_historical_removed_stocks": F.col("historical_removed_stock_count") == 0,
        "bad_signal_member_count_dates": F.col("bad_member_count_dates") > 0,
        **{name: F.col(name) > 0 for name in FAILURES},
    }
    failures = F.filter(
        F.array(*[F.when(broken, F.lit(name)) for name, broken in conditions.items()]),
        lambda x: x.isNotNull(),
    )
    return (
        joined.drop("_one")
        .withColumn("failures", failures)
        .withColumn("status", F.when(F.size("failures") == 0, "passed").otherwise("failed"))
    )


def require_validated(manifest: DataFrame) -> None:
    """Refuse a dataset whose manifest does not say it was validated."""
    rows = manifest.select("status").limit(2).collect()
    if len(rows) != 1 or rows[0]["status"] != "validated":
        raise DataContractError("the dataset manifest is not validated")


def gate_on_validated(panel: DataFrame, manifest: DataFrame, actual: DataFrame, recorded: DataFrame) -> DataFrame:
    """The panel, once its manifest says validated and its files are those recorded."""
    require_validated(manifest)
    require_same_files(actual, recorded)
    return panel


def require_same_files(actual: DataFrame, recorded: DataFrame) -> None:
    """Refuse when a file's hash differs from the recorded one."""
    now, then = actual.select("name", "sha256"), recorded.select(
        "name", F.col("sha256").alias("recorded")
    )
    changed = then.join(now, "name", "left").where(
        ~F.col("sha256").eqNullSafe(F.col("recorded"))
    )
    rows = changed.limit(1).collect()
    if rows:
        raise DataContractError(f"file changed since it was recorded: {rows[0]['name']}")
