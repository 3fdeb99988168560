"""Market-pressure gate: how far scores give way to a defensive ranking.

The rule is fitted and evaluated on date-level readings; only the final blend
touches the scored rows. ``residual`` is an external adjustment, 0 by default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import clamp, sigmoid, smoothstep
from tidepanel.operators.features import LOW_VOLATILITY, MARKET4
from tidepanel.operators.market import check_scale, daily_means, mean_of, stress_components
from tidepanel.plans.extent import Extent, attach, with_date_stats
from tidepanel.schemas import DataContractError

COMPONENTS = tuple(f"stress_{i}" for i in range(4))


@dataclass(frozen=True)
class GateRule:
    """Fitted readings; the remaining fields are fixed defaults."""

    center: dict
    scale: dict
    low: float
    high: float
    component_low: tuple
    component_high: tuple
    low_quantile: float = 0.70
    high_quantile: float = 0.90
    min_components: int = 2
    rule_min: float = 0.30
    rule_max: float = 0.50
    cap: float = 0.60
    residual_fraction: float = 0.20
    bias: float = -1.5
    strength: float = 1.25
    latest_weight: float = 0.75
    history_weight: float = 0.25
    market_features: tuple = field(default=MARKET4)


def with_components(daily: DataFrame, center, scale) -> DataFrame:
    """Signed components and their mean from a date-level market table."""
    parts = dict(zip(COMPONENTS, stress_components(center, scale)))
    return daily.withColumns(parts).withColumn(
        "stress", mean_of([F.col(c) for c in COMPONENTS])
    )


def fit_gate_rule(
    panel: DataFrame, rows: Column, low_quantile: float = 0.70, high_quantile: float = 0.90
) -> GateRule:
    """Center, scale and interpolated pressure quantiles over training dates."""
    if not 0.0 < low_quantile < high_quantile < 1.0:
        raise DataContractError("quantiles must satisfy 0 < low < high < 1")
    daily = daily_means(panel, rows)
    row = daily.agg(
        *[F.avg(c).alias(f"c_{c}") for c in MARKET4],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in MARKET4],
    ).first()
    center = {c: row[f"c_{c}"] for c in MARKET4}
    scale = {c: row[f"s_{c}"] for c in MARKET4}
    check_scale(center, scale)
    wanted = F.array(F.lit(low_quantile), F.lit(high_quantile))
    q = with_components(daily, center, scale).agg(
        *[F.percentile(c, wanted).alias(c) for c in ("stress", *COMPONENTS)]
    ).first()
    return GateRule(
        center,
        scale,
        q["stress"][0],
        q["stress"][1],
        tuple(q[c][0] for c in COMPONENTS),
        tuple(q[c][1] for c in COMPONENTS),
        low_quantile,
        high_quantile,
    )


def rule_table(spark, rule: GateRule) -> DataFrame:
    """The rule as rows (part, center, scale, low, high), for storing and reuse."""
    rows = [("mean_pressure", None, None, rule.low, rule.high)]
    rows += [
        (name, rule.center[name], rule.scale[name], rule.component_low[i], rule.component_high[i])
        for i, name in enumerate(MARKET4)
    ]
    return spark.createDataFrame(
        rows, "part string, center double, scale double, low double, high double"
    )


def load_rule(table: DataFrame, low_quantile: float = 0.70, high_quantile: float = 0.90) -> GateRule:
    """Reuse a stored rule; its features must be the four of the market table."""
    rows = {r["part"]: r for r in table.limit(len(MARKET4) + 2).collect()}
    if set(rows) != {"mean_pressure", *MARKET4}:
        raise DataContractError("the stored rule was fitted on other features")
    center = {c: rows[c]["center"] for c in MARKET4}
    scale = {c: rows[c]["scale"] for c in MARKET4}
    check_scale(center, scale)
    if any(rows[c]["low"] is None or rows[c]["high"] is None for c in MARKET4):
        raise DataContractError("the stored rule has no component thresholds")
    return GateRule(
        center,
        scale,
        rows["mean_pressure"]["low"],
        rows["mean_pressure"]["high"],
        tuple(rows[c]["low"] for c in MARKET4),
        tuple(rows[c]["high"] for c in MARKET4),
        low_quantile,
        high_quantile,
    )


def pressure(value: Column, low: float, high: float) -> Column:
    """Place between both thresholds; a step where they coincide."""
    if high == low:
        return (value >= F.lit(low)).cast("double")
    return clamp((value - F.lit(low)) / F.lit(high - low))


def gate_two_of_four(daily: DataFrame, rule: GateRule, residual: Column | None = None) -> DataFrame:
    """Opens when enough components are abnormal, by the weakest of the
    strongest ``min_components`` pressures."""
    residual = F.lit(0.0) if residual is None else residual
    parts = with_components(daily, rule.center, rule.scale)
    limits = list(zip(COMPONENTS, rule.component_low, rule.component_high))
    pressures = F.array(*[pressure(F.col(c), lo, hi) for c, lo, hi in limits])
    abnormal = F.lit(0)
    for c, lo, _ in limits:
        abnormal = abnormal + (F.col(c) >= F.lit(lo)).cast("int")
    kth = F.sort_array(pressures, asc=False)[rule.min_components - 1]
    base = F.when(
        abnormal >= rule.min_components,
        F.lit(rule.rule_min) + F.lit(rule.rule_max - rule.rule_min) * smoothstep(kth),
    ).otherwise(F.lit(0.0))
    lifted = base * (F.lit(1.0) + F.lit(rule.residual_fraction) * sigmoid(residual))
    return parts.withColumns(
        {"abnormal_components": abnormal, "gate": clamp(lifted, 0.0, rule.cap)}
    )


def gate_aggregate(daily: DataFrame, rule: GateRule, residual: Column | None = None) -> DataFrame:
    """Opens with the mean pressure."""
    residual = F.lit(0.0) if residual is None else residual
    parts = with_components(daily, rule.center, rule.scale)
    base = F.lit(rule.rule_max) * smoothstep(pressure(F.col("stress"), rule.low, rule.high))
    lifted = base * (F.lit(1.0) + F.lit(rule.residual_fraction) * F.tanh(residual))
    return parts.withColumn("gate", clamp(lifted, 0.0, rule.cap))


def gate_logistic(daily: DataFrame, rule: GateRule, length: int, residual: Column | None = None) -> DataFrame:
    """Logistic in the latest stress and its mean over the last ``length`` days."""
    residual = F.lit(0.0) if residual is None else residual
    parts = with_components(daily, rule.center, rule.scale)
    recent = Window.orderBy("trade_date").rowsBetween(-(length - 1), 0)
    blended = F.lit(rule.latest_weight) * F.col("stress") + F.lit(
        rule.history_weight
    ) * F.avg("stress").over(recent)
    return parts.withColumn(
        "gate", sigmoid(F.lit(rule.bias) + F.lit(rule.strength) * blended + residual)
    )


def gate_override(daily: DataFrame, value: float) -> DataFrame:
    if not 0.0 <= value <= 1.0:
        raise DataContractError("the gate must lie in [0, 1]")
    return daily.withColumn("gate", F.lit(float(value)))


def defensive_blend(
    scored: DataFrame,
    gates: DataFrame,
    extent: Extent,
    low_weight: float = 0.5,
    reversal_weight: float = 0.5,
    score: str = "score",
) -> DataFrame:
    """Mix the score with a defensive one brought to the score's mean and
    spread on the date. ``scored`` carries standardised features."""
    defensive = F.lit(low_weight) * -mean_of([F.col(c) for c in LOW_VOLATILITY]) + F.lit(
        reversal_weight
    ) * F.col("ROC60")
    raw = scored.withColumn("_def", defensive)

    def spread(name: str) -> Column:
        return F.sqrt(F.greatest(F.var_pop(name), F.lit(1e-8)))

    stated = with_date_stats(
        raw,
        extent,
        _sm=F.avg(score),
        _ss=spread(score),
        _dm=F.avg("_def"),
        _ds=spread("_def"),
    )
    gated = attach(stated, gates.select("trade_date", "gate"), ["trade_date"], extent.dates)
    matched = (F.col("_def") - F.col("_dm")) / F.col("_ds") * F.col("_ss") + F.col("_sm")
    return gated.withColumns(
        {
            "defensive_score": matched,
            "gated_score": (F.lit(1.0) - F.col("gate")) * F.col(score) + F.col("gate") * matched,
        }
    ).drop("_def", "_sm", "_ss", "_dm", "_ds")
