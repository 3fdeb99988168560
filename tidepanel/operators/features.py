"""Causal rolling features per code.

All windows share one partitioning and ordering, so one shuffle and one sort
serve every frame. A code has at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import clean, eps_divide
from tidepanel.plans.checked_join import checked_join
from tidepanel.schemas import DataContractError, require_columns

# The feature names and their order.
LOW_VOLATILITY = (
    "amplitude", "STD5", "STD10", "STD20", "STD60",
    "volatility_10", "volatility_20", "atr_14",
)
BASE24 = (
    *LOW_VOLATILITY,
    "amount", "turnover", "volume_ratio", "volume_change",
    "VMA5", "VMA20", "VSTD20", "WVMA20",
    "ROC5", "ROC20", "ROC60", "RANK5", "RANK20", "RANK60", "RSV20", "MA20",
)
MARKET4 = (
    "market_return_20", "market_volatility_20", "market_drawdown_60", "market_breadth_20",
)
CROSS4 = ("stress_x_ROC60", "stress_x_low_vol", "stress_x_RANK20", "stress_x_volume_change")
COMPONENT2 = ("volatility_stress_x_ROC20", "drawdown_stress_x_STD20")

FEATURE_SETS = {
    "baseline24": BASE24,
    "baseline24_market4": BASE24 + MARKET4,
    "baseline24_market4_cross4": BASE24 + MARKET4 + CROSS4,
    "baseline24_market4_component2": BASE24 + MARKET4 + COMPONENT2,
}

#: Label, flags and origin of a row: never features, and never filled.
AUDIT = (
    "label", "is_member", "is_suspended", "is_tradable", "in_signal_range",
    "label_entry_failed", "adj_factor", "source",
)

ATR_DAYS = 14
ATR_BLOCK = 1024


def by_code():
    return Window.partitionBy("code").orderBy("trade_date")


def last(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def full(value: Column, over: Column, n: int) -> Column:
    """The value only where all ``n`` inputs of the window are present."""
    return F.when(F.count(over).over(last(n)) == n, value)


def rolling(agg, over: Column, n: int) -> Column:
    return full(agg(over).over(last(n)), over, n)


def rank_in_window(recent: Column, today: Column, n: int) -> Column:
    """Average-tie percent rank of today's value among the last ``n``."""
    window = F.slice(recent, -n, n) if n < 60 else recent
    below = F.aggregate(
        window,
        F.lit(0.5),
        lambda acc, x: acc
        + F.when(x < today, F.lit(1.0)).when(x == today, F.lit(0.5)).otherwise(F.lit(0.0)),
    )
    return F.when(F.count(today).over(last(n)) == n, below / F.lit(float(n)))


def wilder_atr(df: DataFrame, out: str = "atr_14") -> DataFrame:
    """Wilder's average true range, seeded with the mean of the first 14 ranges.

    The recursion a(t) = (13 a(t-1) + TR(t)) / 14 unrolls to a weighted running
    sum. It is taken in blocks short enough for the weights to stay in range,
    and the end values of earlier blocks are folded in. Needs ``_tr`` and
    ``_step``, the 0-based row number of the code.
    """
    decay = (ATR_DAYS - 1) / ATR_DAYS
    step = F.col("_step")
    # Read at one step only, where the rows so far, without the first, are the last 14.
    so_far = by_code().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seed = F.avg(F.when(step > 0, F.col("_tr"))).over(so_far)
    term = (
        F.when(step > ATR_DAYS, F.col("_tr") / F.lit(float(ATR_DAYS)))
        .when(step == ATR_DAYS, seed)
        .otherwise(F.lit(0.0))
    )
    offset = step % ATR_BLOCK
    blocks = df.withColumns({"_term": term, "_block": F.floor(step / F.lit(ATR_BLOCK))})
    inside = (
        Window.partitionBy("code", "_block")
        .orderBy("trade_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    weighted = F.sum(F.col("_term") * F.pow(F.lit(decay), -offset)).over(inside)
    local = blocks.withColumn("_local", weighted * F.pow(F.lit(decay), offset))
    # One end value per finished block of the code, oldest first.
    ends = F.collect_list(F.when(offset == ATR_BLOCK - 1, F.col("_local"))).over(
        by_code().rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = F.aggregate(
        ends, F.lit(0.0), lambda acc, x: acc * F.lit(decay**ATR_BLOCK) + x
    ) * F.pow(F.lit(decay), offset + 1)
    return local.withColumn(
        out, F.when(step >= ATR_DAYS, F.col("_local") + carried)
    ).drop("_term", "_block", "_local")


def baseline24(panel: DataFrame, zero_fill: bool = True) -> DataFrame:
    """The 24 per-code features; other columns are carried along untouched.

    With ``zero_fill`` the warm-up gaps and undefined ratios of the features
    become 0. Labels and flags are never filled.
    """
    require_columns(
        panel,
        ["code", "trade_date", "close", "high", "low", "volume", "amplitude", "amount", "turnover"],
        "features",
    )
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    prior = F.lag("close").over(by_code())
    prior_volume = F.lag("volume").over(by_code())
    staged = panel.withColumns(
        {
            "_ret": F.try_divide(close, prior) - 1.0,
            "_tr": F.when(
                prior.isNotNull(),
                F.greatest(high - low, F.abs(high - prior), F.abs(low - prior)),
            ),
            "volume_change": F.try_divide(volume, prior_volume) - 1.0,
            "_step": F.row_number().over(by_code()) - 1,
            **{f"ROC{n}": eps_divide(F.lag("close", n).over(by_code()), close) for n in (5, 20, 60)},
        }
    ).withColumn("_wret", F.abs(F.col("_ret")) * volume)
    # Its blocks are sorted once more, so it comes first, while the rows are narrow.
    staged = wilder_atr(staged).drop("_tr", "_step")

    ret, wret = F.col("_ret"), F.col("_wret")
    lowest, highest = rolling(F.min, low, 20), rolling(F.max, high, 20)
    features = {
        **{f"STD{n}": eps_divide(rolling(F.stddev_pop, close, n), close) for n in (5, 10, 20, 60)},
        "MA20": eps_divide(rolling(F.avg, close, 20), close),
        "RSV20": eps_divide(close - lowest, highest - lowest),
        **{f"VMA{n}": eps_divide(rolling(F.avg, volume, n), volume) for n in (5, 20)},
        "VSTD20": eps_divide(rolling(F.stddev_pop, volume, 20), volume),
        "WVMA20": eps_divide(rolling(F.stddev_samp, wret, 20), rolling(F.avg, wret, 20)),
        "volume_ratio": F.try_divide(rolling(F.avg, volume, 5), rolling(F.avg, volume, 20)),
        "volatility_10": rolling(F.stddev_samp, ret, 10),
        "volatility_20": rolling(F.stddev_samp, ret, 20),
        "_recent": F.collect_list("close").over(last(60)),
    }
    framed = staged.withColumns(features)
    result = framed.withColumns(
        {f"RANK{n}": rank_in_window(F.col("_recent"), close, n) for n in (5, 20, 60)}
    ).drop("_recent", "_ret", "_wret")
    if zero_fill:
        result = result.withColumns({name: clean(F.col(name)) for name in BASE24})
    return result


def restore_audit_columns(
    features: DataFrame, panel: DataFrame, columns: Sequence[str] = AUDIT, keys: Sequence[str] = ("code", "trade_date")
) -> DataFrame:
    """Take the audit columns as the panel has them, whatever happened to them since.

    Those of ``columns`` that the panel has are joined back one to one; repeated keys
    on either side are refused. Rows without a partner get nulls."""
    own = [c for c in columns if c in panel.columns]
    bare = features.drop(*own)
    return checked_join(bare, panel.select(*keys, *own), keys, "one_to_one", "left", "audit columns")[0]


def fill_market(df: DataFrame) -> DataFrame:
    """Warm-up days of the market state count as 0, like those of the features.

    Every later step (scaler, stress, gate) fits and applies on the filled columns.
    """
    return df.withColumns({name: clean(F.col(name)) for name in MARKET4})


def select_features(
    feature_set: str,
    exclude: tuple[str, ...] = (),
    include: tuple[str, ...] | None = None,
) -> list[str]:
    """Resolve a named set, drop the excluded names, then pick the included."""
    if feature_set not in FEATURE_SETS:
        raise DataContractError(f"unknown feature set {feature_set!r}")
    names = ["instrument", *FEATURE_SETS[feature_set]]
    unknown = sorted(set(exclude) - set(names))
    if unknown:
        raise DataContractError(f"features to drop do not exist: {unknown}")
    names = [n for n in names if n not in exclude]
    if include:
        unknown = sorted(set(include) - set(names))
        if unknown:
            raise DataContractError(f"features to keep do not exist: {unknown}")
        names = list(include)
    return names
