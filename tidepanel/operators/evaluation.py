"""Daily evaluation of scores against realised labels.

Selections keep at most twenty rows per date before the shuffle. Everything
else about a date is a combined aggregate, so the size of a date is no limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.crosssection import average_rank
from tidepanel.plans.extent import Extent, attach
from tidepanel.schemas import require_columns

SIZES = (5, 10, 20)
HEAD = 5


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def daily_rank_ic(
    scores: DataFrame, extent: Extent, min_names: int = 10, constant_as_zero: bool = True
) -> DataFrame:
    """Spearman correlation per date. A constant side counts as 0 in the
    evaluator and drops the date during training."""
    require_columns(scores, ["trade_date", "code", "score", "label"], "rank IC")
    ranked = average_rank(
        scores.select(
            "trade_date", "code", F.col("score").alias("_s"), F.col("label").alias("_l")
        ),
        ["_s", "_l"],
        extent,
        pct=False,
    )
    ic = ranked.groupBy("trade_date").agg(
        F.count("*").alias("n"), correlation("_s", "_l").alias("rank_ic")
    ).where(F.col("n") >= min_names).drop("n")
    if constant_as_zero:
        return ic.withColumn("rank_ic", F.coalesce("rank_ic", F.lit(0.0)))
    return ic.where(F.col("rank_ic").isNotNull())


def ic_summary(daily: DataFrame, ic: str = "rank_ic") -> DataFrame:
    """Mean, population deviation, their ratio, and the share of positive days."""
    return daily.agg(
        F.count(ic).alias("n_dates"),
        F.coalesce(F.avg(ic), F.lit(0.0)).alias("mean_ic"),
        F.coalesce(F.stddev_pop(ic), F.lit(0.0)).alias("std_ic"),
        F.coalesce(F.try_divide(F.avg(ic), F.stddev_pop(ic)), F.lit(0.0)).alias("icir"),
        F.coalesce(F.avg((F.col(ic) > 0).cast("double")), F.lit(0.0)).alias("positive_ratio"),
    )


def _best(scores: DataFrame, order: Sequence[Column], k: int, out: str) -> DataFrame:
    best = Window.partitionBy("trade_date").orderBy(*order)
    return scores.withColumn(out, F.row_number().over(best)).where(F.col(out) <= k)


def predicted_best(scores: DataFrame, k: int) -> DataFrame:
    return _best(scores, [F.desc("score"), F.col("code")], k, "place")


def universe_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("trade_date").agg(
        F.count("*").alias("n_names"), F.avg("label").alias("universe_return")
    )


def top_k_returns(scores: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """Mean label of the k best and its excess over the date's mean. A date
    with fewer names uses all of them."""
    picked = predicted_best(scores, max(sizes)).groupBy("trade_date").agg(
        *[F.avg(F.when(F.col("place") <= k, F.col("label"))).alias(f"top{k}_return") for k in sizes]
    )
    # Both sides have one row per date.
    return universe_stats(scores).join(picked, "trade_date").select(
        "trade_date",
        "n_names",
        "universe_return",
        *[f"top{k}_return" for k in sizes],
        *[
            (F.col(f"top{k}_return") - F.col("universe_return")).alias(f"top{k}_excess_return")
            for k in sizes
        ],
    )


def head_positions(scores: DataFrame, extent: Extent, k: int = HEAD) -> DataFrame:
    """True ascending place of the k predicted best of every date.

    The date's rows are only counted against the k chosen labels, so no date
    is sorted. Equal labels go by code.
    """
    chosen = predicted_best(scores, k).select(
        "trade_date", F.struct("place", F.struct("label", "code").alias("at")).alias("pick")
    ).groupBy("trade_date").agg(
        F.transform(F.array_sort(F.collect_list("pick")), lambda p: p["at"]).alias("picks")
    )
    own = F.struct("label", "code")
    placed = attach(scores, chosen, ["trade_date"], extent.dates)
    counts = placed.groupBy("trade_date").agg(
        F.count("*").alias("n_names"),
        F.any_value(F.size("picks")).alias("n_picks"),
        *[
            F.count_if(own < F.get("picks", F.lit(i))).alias(f"_below_{i}") for i in range(k)
        ],
    )
    return counts.select(
        "trade_date",
        "n_names",
        F.slice(F.array(*[f"_below_{i}" for i in range(k)]), F.lit(1), F.col("n_picks")).alias(
            "below"
        ),
    )


def head_quality(scores: DataFrame, extent: Extent) -> DataFrame:
    """NDCG at 5 with the true percentile as gain, and its plain mean.

    The lowest label has gain 0, the highest 1; discounts are 1 / log2(place + 1).
    """
    at = head_positions(scores, extent)
    span = F.greatest(F.col("n_names") - 1, F.lit(1)).cast("double")
    discount = lambda i: F.lit(1.0) / F.log2((i + 2).cast("double"))
    gains = F.transform("below", lambda b: b / span)
    dcg = F.aggregate(
        F.transform(gains, lambda g, i: g * discount(i)), F.lit(0.0), lambda a, x: a + x
    )
    ideal = F.aggregate(
        F.transform(
            gains, lambda g, i: (F.col("n_names") - 1 - i).cast("double") / span * discount(i)
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    mean = F.aggregate(gains, F.lit(0.0), lambda a, x: a + x) / F.size(gains)
    return at.select(
        "trade_date",
        (dcg / F.greatest(ideal, F.lit(1e-12))).alias("ndcg_at_5"),
        mean.alias("top5_true_percentile"),
    )


def capture(scores: DataFrame, k: int = HEAD) -> DataFrame:
    """How much of the best possible return the selection captured.

    Dates with fewer than k names are left out; ratios to a vanishing
    denominator are 0.
    """
    predicted = predicted_best(scores, k).groupBy("trade_date").agg(
        F.sum("label").alias("pred_return_sum")
    )
    ideal = _best(scores, [F.desc("label"), F.col("code")], k, "place").groupBy("trade_date").agg(
        F.sum("label").alias("max_return_sum")
    )
    dates = (
        universe_stats(scores)
        .where(F.col("n_names") >= k)
        .join(predicted, "trade_date")
        .join(ideal, "trade_date")
        .withColumn("random_return_sum", F.lit(float(k)) * F.col("universe_return"))
    )
    best, got, chance = (F.col(c) for c in ("max_return_sum", "pred_return_sum", "random_return_sum"))
    reachable = F.abs(best) > 1e-9
    room = best - chance
    ratio = lambda x: F.when(reachable, F.try_divide(x, best + F.lit(1e-12))).otherwise(F.lit(0.0))
    return dates.select(
        "trade_date",
        "pred_return_sum",
        "max_return_sum",
        "random_return_sum",
        ratio(got).alias("ratio_pred"),
        ratio(chance).alias("ratio_random"),
        F.when(F.abs(room) > 1e-6, F.try_divide(got - chance, room + F.lit(1e-12)))
        .otherwise(F.lit(0.0))
        .alias("final_score"),
    )


def evaluate_daily(scores: DataFrame, extent: Extent, min_names: int = 10) -> DataFrame:
    """One row per evaluable date with all daily measures."""
    returns = top_k_returns(scores).where(F.col("n_names") >= min_names)
    return (
        returns.join(daily_rank_ic(scores, extent, min_names), "trade_date")
        .join(head_quality(scores, extent), "trade_date")
    )


def evaluation_summary(daily: DataFrame) -> DataFrame:
    """Means over dates, the worst day, and the share of winning days."""
    means = [f"top{k}_{kind}" for k in SIZES for kind in ("return", "excess_return")]
    excess = F.col("top5_excess_return")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return daily.agg(
        F.count("*").alias("n_dates"),
        zero(F.avg("rank_ic")).alias("mean_ic"),
        zero(F.stddev_pop("rank_ic")).alias("std_ic"),
        zero(F.try_divide(F.avg("rank_ic"), F.stddev_pop("rank_ic"))).alias("icir"),
        zero(F.avg((F.col("rank_ic") > 0).cast("double"))).alias("positive_ratio"),
        *[F.avg(m).alias(f"{m}_mean") for m in means],
        F.min(excess).alias("worst_daily_top5_excess_return"),
        F.avg((excess > 0).cast("double")).alias("positive_top5_excess_day_ratio"),
        F.avg("ndcg_at_5").alias("ndcg_at_5_mean"),
        F.avg("top5_true_percentile").alias("top5_true_percentile_mean"),
    )


def scope_to_split(scores: DataFrame, split: DataFrame, part: str = "test") -> DataFrame:
    """Rows of one part. When the split has a signal day, the test part is
    that single day; ``full`` keeps everything."""
    if part == "full":
        return scores
    bounds = {r["segment"]: r for r in split.collect()}
    row = bounds["signal"] if part == "test" and "signal" in bounds else bounds[part]
    return scores.where(
        F.col("trade_date").between(F.lit(row["start_date"]), F.lit(row["end_date"]))
    )


def stability_score(trials: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Mean minus ``penalty`` population deviations per configuration; a
    configuration without a score gets minus infinity."""
    return trials.groupBy("config").agg(
        F.coalesce(
            F.avg("score") - F.lit(penalty) * F.stddev_pop("score"), F.lit(float("-inf"))
        ).alias("stability_score")
    )


def best_config(scored: DataFrame, require_positive: bool = True) -> DataFrame:
    """The best configuration; none when no score is above zero."""
    best = scored.agg(
        F.max_by("config", F.struct("stability_score", "config")).alias("config"),
        F.max("stability_score").alias("stability_score"),
    )
    return best.where(F.col("stability_score") > 0) if require_positive else best


def early_stop(log: DataFrame, patience: int = 10) -> DataFrame:
    """Best epoch and stopping epoch of every run in a metric log.

    Only a strict improvement resets the count. A run has as many rows as epochs.
    """
    epochs = Window.partitionBy("run").orderBy("epoch")
    before = epochs.rowsBetween(Window.unboundedPreceding, -1)
    upto = epochs.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    improved = F.col("metric") > F.coalesce(F.max("metric").over(before), F.lit(float("-inf")))
    traced = log.withColumns(
        {"_improved": improved, "_n": F.row_number().over(epochs)}
    ).withColumn("_best_n", F.max(F.when(F.col("_improved"), F.col("_n"))).over(upto))
    waited = F.col("_n") - F.coalesce("_best_n", F.lit(0))
    flagged = traced.withColumn("_stop", waited >= patience)
    stops = flagged.withColumn(
        "_stop_n", F.min(F.when(F.col("_stop"), F.col("_n"))).over(Window.partitionBy("run"))
    )
    ran = stops.where(F.col("_stop_n").isNull() | (F.col("_n") <= F.col("_stop_n")))
    return ran.groupBy("run").agg(
        F.max_by("epoch", F.when(F.col("_improved"), F.col("_n"))).alias("best_epoch"),
        F.max(F.when(F.col("_improved"), F.col("metric"))).alias("best_metric"),
        F.max("epoch").alias("last_epoch"),
        F.bool_or("_stop").alias("stopped_early"),
    )
