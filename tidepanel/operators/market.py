"""Market state from the cross-section, and its interactions with features.

Once the panel is reduced to one row per date the series is as short as the
calendar, so its windows run in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import to_numeric
from tidepanel.operators.features import LOW_VOLATILITY, MARKET4
from tidepanel.plans.extent import attach
from tidepanel.schemas import DataContractError, candidate, require_columns

# Fixed values: +1 where a larger reading means more market stress.
STRESS_DIRECTIONS = (-1.0, 1.0, -1.0, -1.0)


def days(n: int):
    return Window.orderBy("trade_date").rowsBetween(-(n - 1), 0)


def full_days(agg, name: str, n: int) -> Column:
    value = F.col(name)
    return F.when(F.count(value).over(days(n)) == n, agg(value).over(days(n)))


def market_daily(panel: DataFrame) -> DataFrame:
    """Equal-weight return and share of risers over tradable members."""
    require_columns(panel, ["trade_date", "pct_chg"], "market state")
    ret = to_numeric(F.col("pct_chg")) / 100.0
    return (
        panel.where(candidate(panel))
        .select("trade_date", ret.alias("_ret"))
        .where(F.col("_ret").isNotNull())
        .groupBy("trade_date")
        .agg(
            F.avg("_ret").alias("market_return"),
            F.avg((F.col("_ret") > 0).cast("double")).alias("breadth_positive"),
        )
    )


def rolling_state(daily: DataFrame, breadth_name: str, empty_return: float | None = None) -> DataFrame:
    """20-day return, volatility and breadth, and 60-day drawdown.

    ``empty_return`` replaces a missing daily return inside the wealth index only.
    """
    grown = F.col("market_return")
    if empty_return is not None:
        grown = F.coalesce(grown, F.lit(empty_return))
    to_date = Window.orderBy("trade_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    wealth = daily.withColumns(
        {"_wealth": F.product(1.0 + grown).over(to_date), "_growth": 1.0 + F.col("market_return")}
    )
    return wealth.withColumns(
        {
            "market_return_20": full_days(F.product, "_growth", 20) - 1.0,
            "market_volatility_20": full_days(F.stddev_pop, "market_return", 20),
            "market_drawdown_60": F.try_divide(F.col("_wealth"), full_days(F.max, "_wealth", 60))
            - 1.0,
            breadth_name: full_days(F.avg, "breadth_positive", 20),
        }
    ).drop("_wealth", "_growth")


def market4(panel: DataFrame) -> DataFrame:
    daily = market_daily(panel)
    return rolling_state(daily, "market_breadth_20").select("trade_date", *MARKET4)


def add_market4(panel: DataFrame, state: DataFrame | None = None, dates: int | None = None) -> DataFrame:
    """Attach the date-level state to every row of the panel."""
    side = market4(panel) if state is None else state
    return attach(panel, side, ["trade_date"], dates)


def daily_means(panel: DataFrame, fit_rows: Column) -> DataFrame:
    return (
        panel.where(F.coalesce(fit_rows, F.lit(False)))
        .groupBy("trade_date")
        .agg(*[F.avg(name).alias(name) for name in MARKET4])
    )


def fit_market_stress(panel: DataFrame, fit_rows: Column) -> tuple[dict, dict]:
    """Center and population scale of the daily state over the fit rows."""
    require_columns(panel, ["trade_date", *MARKET4], "market stress")
    row = daily_means(panel, fit_rows).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"c_{c}") for c in MARKET4],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in MARKET4],
    ).first()
    if not row["n"]:
        raise DataContractError("market stress: no fit rows")
    center = {c: row[f"c_{c}"] for c in MARKET4}
    scale = {c: row[f"s_{c}"] for c in MARKET4}
    check_scale(center, scale)
    return center, scale


def check_scale(center: Mapping[str, float], scale: Mapping[str, float]) -> None:
    for name in MARKET4:
        if center.get(name) is None:
            raise DataContractError(f"market stress: no center for {name}")
        if scale.get(name) is None or not scale[name] > 0:
            raise DataContractError(f"market stress: scale of {name} must be positive")


def stress_components(center: Mapping[str, float], scale: Mapping[str, float]) -> list[Column]:
    """Standardised state, signed so that larger means more stress."""
    return [
        (F.col(name) - F.lit(center[name])) / F.lit(scale[name]) * F.lit(direction)
        for name, direction in zip(MARKET4, STRESS_DIRECTIONS)
    ]


def mean_of(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total / F.lit(float(len(columns)))


def cross4(panel: DataFrame, center: Mapping[str, float], scale: Mapping[str, float]) -> DataFrame:
    """Market stress times four ranked features."""
    require_columns(
        panel, [*MARKET4, *LOW_VOLATILITY, "ROC60", "RANK20", "volume_change"], "cross features"
    )
    check_scale(center, scale)
    stress = mean_of(stress_components(center, scale))
    low_volatility = mean_of([F.lit(1.0) - F.col(c) for c in LOW_VOLATILITY])
    return panel.withColumns(
        {
            "stress_x_ROC60": stress * F.col("ROC60"),
            "stress_x_low_vol": stress * low_volatility,
            "stress_x_RANK20": stress * F.col("RANK20"),
            "stress_x_volume_change": stress * F.col("volume_change"),
        }
    )


def component2(panel: DataFrame, center: Mapping[str, float], scale: Mapping[str, float]) -> DataFrame:
    """Two single components of the stress times one feature each."""
    require_columns(panel, [*MARKET4, "ROC20", "STD20"], "component features")
    check_scale(center, scale)
    _, volatility, drawdown, _ = stress_components(center, scale)
    return panel.withColumns(
        {
            "volatility_stress_x_ROC20": volatility * F.col("ROC20"),
            "drawdown_stress_x_STD20": drawdown * F.col("STD20"),
        }
    )
