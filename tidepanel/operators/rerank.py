"""Reversible re-ranking of scored candidates under a market regime rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.crosssection import average_rank, score_order
from tidepanel.operators.features import LOW_VOLATILITY
from tidepanel.operators.market import mean_of
from tidepanel.plans.extent import Extent
from tidepanel.plans.ordering import row_positions
from tidepanel.schemas import DataContractError, require_columns, require_none, require_unique

# Style families, their factors and whether lower is better.
FAMILIES = {
    "low_volatility": (LOW_VOLATILITY, False),
    "low_activity": (("amount", "turnover"), False),
    "long_term_reversal": (("ROC60",), True),
}
FACTORS = tuple(f for factors, _ in FAMILIES.values() for f in factors)

# Floor and margin unit of each regime reading.
REGIME_RULE = {
    "breadth_today": (0.50, 0.05),
    "breadth_change_5_20": (-0.01, 0.05),
    "vol20_hist_percentile": (1.0 / 3.0, 0.10),
}
TOP_K = 5
POOL_K = 15


def not_above_so_far(rows: DataFrame, position: str, value: str, out: str) -> DataFrame:
    """How many rows up to each position (from 0) have a value not above its own.

    An earlier and a later position stand on the two sides of exactly one node of a
    binary tree over positions, so counts at its nodes add up: n log n rows in all.
    """
    levels = F.sequence(F.lit(0), F.lit(30))
    sides = (
        rows.where(F.col(value).isNotNull())
        .select(F.col(position).alias("_p"), F.col(value).alias("_v"), F.explode(levels).alias("_level"))
        .withColumns(
            {"_node": F.expr("shiftright(_p, _level + 1)"), "_later": F.expr("shiftright(_p, _level) & 1") == 1}
        )
    )
    upto = Window.partitionBy("_level", "_node").orderBy("_v").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = F.sum(F.when(F.col("_later"), 0).otherwise(1)).over(upto)
    counted = sides.withColumn("_n", F.when(F.col("_later"), earlier).otherwise(0))
    return counted.groupBy(F.col("_p").alias(position)).agg((F.sum("_n") + 1).alias(out))


def regime_metrics(daily: DataFrame) -> DataFrame:
    """Readings of the rule from the date-level market table.

    Breadth of the day, 5-day minus 20-day mean breadth, and the share of the
    20-day volatilities up to and including the day that are not above it.
    """
    days = Window.orderBy("trade_date")
    history = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    five, twenty = days.rowsBetween(-4, 0), days.rowsBetween(-19, 0)
    breadth, ret = F.col("breadth_positive"), F.col("market_return")
    volatile = daily.withColumn(
        "_vol", F.when(F.count(ret).over(twenty) == 20, F.stddev_pop(ret).over(twenty))
    ).withColumns({"_known": F.count("_vol").over(history), "_at": F.row_number().over(days) - 1})
    ranked = volatile.join(not_above_so_far(volatile, "_at", "_vol", "_not_above"), "_at", "left")
    rank = F.col("_not_above") / F.col("_known")
    return ranked.select(
        "trade_date",
        breadth.alias("breadth_today"),
        F.when(
            F.count(breadth).over(twenty) == 20,
            F.avg(breadth).over(five) - F.avg(breadth).over(twenty),
        ).alias("breadth_change_5_20"),
        F.when(F.col("_vol").isNotNull(), rank).alias("vol20_hist_percentile"),
    )


def regime_rule(metrics: DataFrame, check: bool = True) -> DataFrame:
    """All three readings at or above their floor trigger the regime."""
    require_columns(metrics, REGIME_RULE, "regime rule")
    if check:
        missing = F.lit(False)
        for name in REGIME_RULE:
            missing = missing | F.col(name).isNull() | ~(F.abs(F.col(name)) < float("inf"))
        require_none(metrics, missing, "regime readings must be finite")
    passed = {f"{n}_pass": F.col(n) >= F.lit(low) for n, (low, _) in REGIME_RULE.items()}
    margin = {
        f"{n}_margin": (F.col(n) - F.lit(low)) / F.lit(unit)
        for n, (low, unit) in REGIME_RULE.items()
    }
    all_passed = F.lit(True)
    for column in passed.values():
        all_passed = all_passed & column
    return metrics.withColumns(
        {
            **passed,
            **margin,
            "triggered": all_passed,
            "trigger_margin": F.least(*margin.values()),
        }
    )


def family_overlay(candidates: DataFrame, extent: Extent, check: bool = True) -> DataFrame:
    """Mean directional rank per family, their mean, and its rank."""
    require_columns(candidates, ["trade_date", "code", *FACTORS], "family overlay")
    if check:
        missing = F.lit(False)
        for name in FACTORS:
            missing = missing | F.col(name).isNull()
        require_none(candidates.select("trade_date", "code", *FACTORS), missing, "missing factor")
    copies = candidates.withColumns({f"_r_{f}": F.col(f) for f in FACTORS})
    low = [f"_r_{f}" for fs, up in FAMILIES.values() if not up for f in fs]
    high = [f"_r_{f}" for fs, up in FAMILIES.values() if up for f in fs]
    ranked = average_rank(copies, low + high, extent, descending=low)
    scored = ranked.withColumns(
        {
            family: mean_of([F.col(f"_r_{f}") for f in factors])
            for family, (factors, _) in FAMILIES.items()
        }
    )
    styled = scored.withColumn(
        "reversal_style_composite", mean_of([F.col(f) for f in FAMILIES])
    ).drop(*low, *high)
    return average_rank(
        # Ranked at nine decimals, so sums that differ only in rounding tie.
        styled.withColumn("family_rank_pct", F.round("reversal_style_composite", 9)),
        ["family_rank_pct"],
        extent,
    )


def validate_candidates(
    candidates: DataFrame, alpha: float = 0.0, k: int = TOP_K, least: int | None = None
) -> None:
    if not 0.0 <= alpha <= 1.0:
        raise DataContractError(f"alpha must lie in [0, 1], got {alpha}")
    if k != TOP_K:
        raise DataContractError(f"only the top {TOP_K} may be selected, got {k}")
    require_unique(candidates, ["trade_date", "code"], "candidate codes")
    small = candidates.groupBy("trade_date").count().where(F.col("count") < (least or k))
    require_none(small, F.lit(True), "too few candidates")


def _audit_columns(original: str = "original_rank", final: str = "final_rank") -> dict[str, Column]:
    return {
        "rank_change": F.col(original) - F.col(final),
        "in_original_top5": F.col(original) <= TOP_K,
        "in_final_top5": F.col(final) <= TOP_K,
    }


def blend_rerank(
    candidates: DataFrame,
    triggered: Column,
    alpha: float,
    extent: Extent,
    enabled: bool = True,
    score: str = "score",
    check: bool = True,
) -> DataFrame:
    """Blend the score's rank with the family rank on triggered dates.

    ``triggered`` is constant within a date. With a zero effective weight the
    final order is the original one.
    """
    if check:
        validate_candidates(candidates, alpha)
    styled = family_overlay(candidates, extent, check)
    modelled = average_rank(styled.withColumn("model_rank_pct", F.col(score)), ["model_rank_pct"], extent)
    weight = F.when(F.lit(enabled) & F.coalesce(triggered, F.lit(False)), F.lit(float(alpha))).otherwise(F.lit(0.0))
    blended = modelled.withColumns({"effective_alpha": weight, "rerank_enabled": F.lit(enabled)}).withColumn(
        "final_score",
        (F.lit(1.0) - F.col("effective_alpha")) * F.col("model_rank_pct")
        + F.col("effective_alpha") * F.col("family_rank_pct"),
    )
    placed = score_order(blended, extent, score, "original_rank")
    active = F.col("effective_alpha") > 0
    order = [
        F.desc(F.when(active, F.round("final_score", 12)).otherwise(-F.col("original_rank"))),
        F.desc(F.when(active, F.col("model_rank_pct"))),
        F.desc(F.when(active, F.col("family_rank_pct"))),
        F.col("code"),
    ]
    return row_positions(placed, ["trade_date"], order, extent, "final_rank").withColumns(
        _audit_columns()
    )


def pool_rerank(
    candidates: DataFrame,
    triggered: Column,
    extent: Extent,
    enabled: bool = True,
    families: Sequence[str] = ("low_volatility",),
    score: str = "score",
    check: bool = True,
) -> DataFrame:
    """Reorder the original top 15 by the chosen families; others keep their place."""
    unknown = [f for f in families if f not in FAMILIES]
    if not families or unknown:
        raise DataContractError(f"unknown families {unknown or families}")
    if check:
        validate_candidates(candidates, least=POOL_K)
    styled = family_overlay(candidates, extent, check)
    pooled = styled.withColumns(
        {
            "model_rank_pct": F.col(score),
            "pool_family_score": mean_of([F.col(f) for f in families]),
        }
    ).withColumn("pool_family_rank_pct", F.round("pool_family_score", 9))
    ranked = average_rank(pooled, ["model_rank_pct", "pool_family_rank_pct"], extent)
    placed = score_order(ranked, extent, score, "original_rank").withColumns(
        {
            "in_original_top15": F.col("original_rank") <= POOL_K,
            "pool_rerank_active": F.lit(enabled) & F.coalesce(triggered, F.lit(False)),
        }
    )
    moved = F.col("pool_rerank_active") & F.col("in_original_top15")
    order = [
        F.when(moved, F.lit(0)).otherwise(F.col("original_rank")),
        F.desc(F.when(moved, F.round("pool_family_score", 9))),
        F.desc(F.when(moved, F.col("model_rank_pct"))),
        F.col("code"),
    ]
    return row_positions(placed, ["trade_date"], order, extent, "final_rank").withColumns(
        {**_audit_columns(), "final_score": -F.col("final_rank").cast("double")}
    )


def selection_manifest(audit: DataFrame, weight: str | None = "effective_alpha") -> DataFrame:
    """Per date: both selections, their overlap, and a hash of the record.

    Only the few selected rows are gathered; the candidate count is combined
    map-side.
    """
    chosen = audit.groupBy("trade_date").agg(
        F.count("*").alias("candidate_count"),
        *([F.max(weight).alias(weight)] if weight else []),
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.when(F.col(rank) <= TOP_K, F.struct(F.col(rank).alias("r"), "code"))
                    )
                ),
                lambda s: s["code"],
            ).alias(name)
            for rank, name in (("original_rank", "original_top5"), ("final_rank", "final_top5"))
        ],
    )
    overlap = F.size(F.array_intersect("original_top5", "final_top5"))
    rollback = [(F.col(weight) == 0).alias("rollback_active")] if weight else []
    counted = chosen.select(
        "*",
        overlap.alias("top5_overlap"),
        (F.lit(TOP_K) - overlap).alias("top5_changed_count"),
        *rollback,
    )
    return counted.withColumn("audit_sha256", F.sha2(F.to_json(F.struct("*")), 256))
