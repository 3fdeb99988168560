"""Ranking losses as audit measures of a score table.

Per-date normalisers are combined aggregates. The pairwise losses never form
pairs: sums of one-sided terms at the nodes of a tree over the scores cover them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.features import LOW_VOLATILITY
from tidepanel.operators.market import mean_of
from tidepanel.plans.extent import Extent, attach, gathered_dates, with_date_stats
from tidepanel.plans.ordering import prefix_sums, row_positions
from tidepanel.schemas import DataContractError

TARGETS = ("ordinal_softmax", "normalized_rank_softmax", "percentile_target")
SHORTCUT_FEATURES = (*LOW_VOLATILITY, "turnover")  # fixed value


def target_distribution(
    rows: DataFrame,
    extent: Extent,
    kind: str = "normalized_rank_softmax",
    temperature: float = 1.0,
    out: str = "target_prob",
) -> DataFrame:
    """Target probabilities of a date from its relevance values."""
    if kind not in TARGETS:
        raise DataContractError(f"unknown target type {kind!r}")
    rel = F.col("relevance")
    ranged = with_date_stats(rows, extent, _lo=F.min(rel), _hi=F.max(rel))
    unit = (rel - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))
    if kind == "percentile_target":
        # All values tied: every mass is zero and the target is uniform.
        mass = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(unit)
    elif kind == "ordinal_softmax":
        mass = F.exp((rel - F.col("_hi")) / F.lit(temperature))
    else:
        top = F.when(F.col("_hi") > F.col("_lo"), F.lit(1.0)).otherwise(F.lit(0.0))
        mass = F.exp((unit - top) / F.lit(temperature))
    weighed = ranged.withColumn("_mass", mass)
    return with_date_stats(weighed, extent, _sum=F.sum("_mass")).withColumn(
        out, F.col("_mass") / F.col("_sum")
    ).drop("_lo", "_hi", "_mass", "_sum")


def target_concentration(targets: DataFrame, prob: str = "target_prob") -> DataFrame:
    """Per date: names, mass of the 1, 5 and 10 largest targets, and entropy."""
    largest = Window.partitionBy("trade_date").orderBy(F.desc(prob), F.col("code"))
    head = (
        targets.select("trade_date", "code", prob)
        .withColumn("_n", F.row_number().over(largest))
        .where(F.col("_n") <= 10)
        .groupBy("trade_date")
        .agg(*[F.sum(F.when(F.col("_n") <= k, F.col(prob))).alias(f"top{k}_mass") for k in (1, 5, 10)])
    )
    p = F.col(prob)
    whole = targets.groupBy("trade_date").agg(
        F.count("*").alias("num_stocks"),
        (-F.sum(p * F.log(F.greatest(p, F.lit(1e-30))))).alias("entropy"),
    )
    return whole.join(head, "trade_date")


def concentration_summary(daily: DataFrame) -> DataFrame:
    names = ("num_stocks", "top1_mass", "top5_mass", "top10_mass", "entropy")
    return daily.agg(
        F.count("*").alias("num_cross_sections"),
        *[
            agg(n).alias(f"{n}_{label}")
            for n in names
            for label, agg in (("min", F.min), ("mean", F.avg), ("max", F.max))
        ],
    )


def head_threshold(rows: DataFrame, k: int) -> DataFrame:
    """The k-th largest relevance of every date (the smallest if fewer)."""
    largest = Window.partitionBy("trade_date").orderBy(F.desc("relevance"), F.col("code"))
    return (
        rows.select("trade_date", "code", "relevance")
        .withColumn("_n", F.row_number().over(largest))
        .where(F.col("_n") <= k)
        .groupBy("trade_date")
        .agg(F.min("relevance").alias("head_threshold"))
    )


def top_weights(
    rows: DataFrame, extent: Extent, k: int = 5, factor: float = 2.0, base: float = 1.0
) -> DataFrame:
    """``factor`` for names at or above the k-th relevance, ties included."""
    marked = attach(rows, head_threshold(rows, k), ["trade_date"], extent.dates)
    head = F.col("relevance") >= F.col("head_threshold")
    return marked.withColumns(
        {"is_head": head, "pair_weight": F.when(head, F.lit(factor)).otherwise(F.lit(base))}
    ).drop("head_threshold")


def listwise_loss(
    weighted: DataFrame, extent: Extent, temperature: float = 1.0
) -> DataFrame:
    """Cross entropy of the weighted, re-normalised targets per date.

    ``weighted`` carries score, target_prob and pair_weight.
    """
    scaled = weighted.withColumns(
        {
            "_z": F.col("score") / F.lit(temperature),
            "_t": F.col("target_prob") * F.col("pair_weight"),
        }
    )
    topped = with_date_stats(scaled, extent, _max=F.max("_z"))
    # One pass: log-sum-exp, and both sums of the targets.
    dates = topped.groupBy("trade_date").agg(
        (F.any_value("_max") + F.log(F.sum(F.exp(F.col("_z") - F.col("_max"))))).alias("_lse"),
        F.sum("_t").alias("_mass"),
        F.sum(F.col("_t") * F.col("_z")).alias("_dot"),
    )
    share = F.lit(1.0) / (F.col("_mass") + F.lit(1e-12))
    return dates.select(
        "trade_date",
        ((F.col("_lse") * F.col("_mass") - F.col("_dot")) * share).alias("listwise_loss"),
    )


def kernel_coefficients(degree: int = 16) -> list[float]:
    """log(1 + x) on [0, 1] as a polynomial without constant term.

    Its nearest singularity is at -1, so the error falls by 5.8 with every degree.
    """
    near = np.polynomial.chebyshev.Chebyshev.interpolate(np.log1p, degree, domain=[0.0, 1.0])
    return [float(a) for a in near.convert(kind=np.polynomial.Polynomial).coef[1:]]


def _with_group_stats(df: DataFrame, keys: Sequence[str], extent: Extent, **stats: Column) -> DataFrame:
    """Aggregates of each group on its rows: a window while a date fits one task."""
    if extent.direct:
        whole = Window.partitionBy(*keys)
        return df.withColumns({name: c.over(whole) for name, c in stats.items()})
    return df.join(df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()]), list(keys))


def _halved(rows: DataFrame, by: Sequence[str], extent: Extent) -> DataFrame:
    """Every row once for each level of a binary tree over its group's order of scores.

    Two rows stand on different sides of exactly one node. ``_upper`` marks the side
    of the larger scores, whose least score ``_least`` lies between the two sides;
    ``_gap`` is the distance to it, so no exponential of it overflows. ``_names``, the
    rows of the group, tells how many levels have a node with two sides.
    """
    placed = row_positions(rows, by, [F.col("score"), F.col("code")], extent, "_pos")
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("_names") - 1)) - 1)
    sides = (
        placed.withColumn("_p", F.col("_pos").cast("long") - 1)
        .withColumn("_level", F.explode(levels))
        .withColumns(
            {
                "_node": F.expr("shiftright(_p, _level + 1)"),
                "_upper": F.expr("shiftright(_p, _level) & 1") == 1,
            }
        )
        .drop("_pos", "_p", "_names")
    )
    least = F.min(F.when(F.col("_upper"), F.col("score")))
    stated = _with_group_stats(sides, [*by, "_level", "_node"], extent, _least=least)
    gap = F.abs(F.col("score") - F.col("_least"))
    return stated.where(F.col("_least").isNotNull()).withColumn("_gap", gap)


def _sized(rows: DataFrame, by: Sequence[str], extent: Extent) -> DataFrame:
    """Rows with ``_names``, the number of rows of their group, of two a date at most."""
    if extent.direct:
        return _with_group_stats(rows, by, extent, _names=F.count(F.lit(1)))
    return attach(rows, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_names")), by, 2 * extent.dates)


def _close_sums(sides: DataFrame, by: Sequence[str], label: str, **more: Column) -> DataFrame:
    """Per date: sums of log(1 + exp(-d)) over all pairs of a group, d being the
    difference of their scores, plain and times the sum of both weights; and the sums
    ``more`` over the sides."""
    coefficients = kernel_coefficients()
    upper, weight = F.col("_upper"), F.col("pair_weight")
    sums = [c.alias(name) for name, c in more.items()]
    for k in range(1, len(coefficients) + 1):
        term = F.exp(F.lit(-float(k)) * F.col("_gap"))
        for name, side in (("u", upper), ("l", ~upper)):
            sums += [
                F.sum(F.when(side, term).otherwise(0.0)).alias(f"{name}{k}"),
                F.sum(F.when(side, term * weight).otherwise(0.0)).alias(f"{name}w{k}"),
            ]
    nodes = sides.groupBy(*by, "_level", "_node").agg(*sums)
    plain, heavy = F.lit(0.0), F.lit(0.0)
    for k, a in enumerate(coefficients, 1):
        plain = plain + F.lit(a) * F.col(f"u{k}") * F.col(f"l{k}")
        heavy = heavy + F.lit(a) * (F.col(f"uw{k}") * F.col(f"l{k}") + F.col(f"u{k}") * F.col(f"lw{k}"))
    return nodes.groupBy("trade_date").agg(
        F.sum(plain).alias(label), F.sum(heavy).alias(f"{label}_w"), *[F.sum(name).alias(name) for name in more]
    )


def _close_pairs(rows: DataFrame, by: Sequence[str], extent: Extent, label: str) -> DataFrame:
    return _close_sums(_halved(rows, by, extent), by, label)


def _all_pairs(rows: DataFrame, extent: Extent) -> DataFrame:
    """Per date, from one tree: _close_sums() over all pairs, and ``_cross``, the sums of
    the difference of scores over the pairs whose larger score has the smaller
    relevance, plain and times the sum of both weights."""
    date = ["trade_date"]
    sides = _halved(_sized(rows, date, extent), date, extent)
    on = lambda x: F.when(F.col("_upper"), x).otherwise(F.lit(0.0))
    gap, weight = F.col("_gap"), F.col("pair_weight")
    sums = {"n": on(F.lit(1.0)), "d": on(gap), "wn": on(weight), "wd": on(weight * gap)}
    keys = [*date, "_level", "_node"]
    depth = max(1, extent.per_date.bit_length())
    summed = prefix_sums(sides, keys, "relevance", sums, extent, depth, 2 * extent.per_date)
    below = lambda name: F.col(f"{name}_le") - F.col(f"{name}_tie")
    plain = below("d") + gap * below("n")
    heavy = weight * plain + below("wd") + gap * below("wn")
    lower = lambda x: F.sum(F.when(~F.col("_upper"), x))
    return _close_sums(summed, date, "_all", _cross=lower(plain), _cross_w=lower(heavy))


def _crossed_heads(rows: DataFrame, extent: Extent) -> DataFrame:
    """Per date: differences of scores over pairs of a head name and a name of the
    rest with a larger score."""
    rest = ~F.col("is_head")
    centred = with_date_stats(rows, extent, _low=F.min("score")).withColumn("_s", F.col("score") - F.col("_low"))
    sums = {"n": F.when(rest, 1.0).otherwise(0.0), "s": F.when(rest, F.col("_s")).otherwise(0.0)}
    summed = prefix_sums(centred, ["trade_date"], "_s", sums, extent)
    above = lambda name: F.col(f"{name}_all") - F.col(f"{name}_le")
    return summed.where(F.col("is_head")).groupBy("trade_date").agg(
        F.sum(above("s") - F.col("_s") * above("n")).alias("_head_cross")
    )


def pairwise_losses(rows: DataFrame, extent: Extent) -> DataFrame:
    """Weighted and unweighted logistic pair losses, and the head loss, per date.

    ``rows`` carries score, relevance, pair_weight and is_head. Pairs with
    equal relevance do not count. A date without pairs has a loss of 0.

    The loss of a pair is log(1 + exp(-d)), d being the distance of its scores,
    plus d where the larger score has the smaller relevance. No pair is formed: a
    binary tree over the order of scores meets every pair at one node, where the
    first part is a polynomial in exp(-d), that is a product of sums of both sides,
    and the second a running sum along the relevance. Scores may spread at will.
    """
    rows = rows.select("trade_date", "code", "score", "relevance", "pair_weight", "is_head")
    date = ["trade_date"]
    if extent.direct:
        # A task's rows stand in it once for each level of the tree.
        rows = gathered_dates(rows, extent, max(1, extent.per_date.bit_length()))
    tied = _with_group_stats(rows, ["trade_date", "relevance"], extent, _names=F.count(F.lit(1)))
    tied = tied.where(F.col("_names") > 1)
    own = _sized(rows, ["trade_date", "is_head"], extent)
    level = rows.groupBy("trade_date", "relevance").agg(F.count("*").cast("double").alias("n"))
    n_tied = level.groupBy(*date).agg(F.sum(F.col("n") * F.col("n")).alias("_tied"))
    head = F.col("is_head")
    dates = rows.groupBy(*date).agg(
        F.count("*").cast("double").alias("_n"), F.count_if(head).alias("_heads"), F.count_if(~head).alias("_rest")
    ).join(n_tied, date)
    for side in (
        _all_pairs(rows, extent),
        _close_pairs(tied, ["trade_date", "relevance"], extent, "_same"),
        _close_pairs(own, ["trade_date", "is_head"], extent, "_own"),
        _crossed_heads(rows, extent),
    ):
        dates = attach(dates, side, date, extent.dates)
    known = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    ratio = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    pairs = (F.col("_n") * F.col("_n") - F.col("_tied")) / 2.0
    total = known("_all") - known("_same") + known("_cross")
    heavy = known("_all_w") - known("_same_w") + known("_cross_w")
    # Every head name outranks every other name.
    headed = known("_all") - known("_own") + known("_head_cross")
    some = lambda x: F.when(pairs > 0, x).otherwise(F.lit(0.0))
    return dates.select(
        "trade_date",
        F.round(pairs).cast("long").alias("n_pairs"),
        some(ratio(heavy, pairs)).alias("pairwise_loss"),
        some(ratio(total, pairs)).alias("global_loss"),
        ratio(headed, F.col("_heads") * F.col("_rest")).alias("head_loss"),
    )


def _summed_correlation(x: str, y: str) -> tuple[Column, Column]:
    n = F.count("*")
    return n * F.covar_pop(x, y), n * F.stddev_pop(x) * F.stddev_pop(y)


def stability_penalty(rows: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Squared negative part of the score-relevance correlation per date."""
    top, bottom = _summed_correlation("score", "relevance")
    return rows.groupBy("trade_date").agg(
        (top / F.greatest(bottom, F.lit(eps))).alias("_c")
    ).select(
        "trade_date",
        F.pow(F.greatest(-F.col("_c"), F.lit(0.0)), 2.0).alias("stability_penalty"),
    )


def volatility_index(
    rows: DataFrame,
    extent: Extent,
    features: Sequence[str] = SHORTCUT_FEATURES,
    eps: float = 1e-8,
    out: str = "shortcut_index",
) -> DataFrame:
    """Mean of per-date standardised features; a constant feature adds 0."""
    stats = {f"_m_{f}": F.avg(f) for f in features} | {f"_s_{f}": F.stddev_pop(f) for f in features}
    stated = with_date_stats(rows, extent, **stats)
    z = [
        F.when(F.col(f"_s_{f}") > eps, (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(
            F.lit(0.0)
        )
        for f in features
    ]
    return stated.withColumn(out, mean_of(z)).drop(*stats)


def shortcut_penalty(rows: DataFrame, eps: float = 1e-8, index: str = "shortcut_index") -> DataFrame:
    """Absolute correlation of the score with the volatility index per date."""
    top, bottom = _summed_correlation("score", index)
    return rows.groupBy("trade_date").agg(top.alias("_t"), bottom.alias("_b")).select(
        "trade_date",
        F.when(F.col("_b") > eps, F.col("_t") / F.col("_b")).otherwise(F.lit(0.0)).alias(
            "shortcut_correlation"
        ),
    ).withColumn("shortcut_penalty", F.abs("shortcut_correlation"))


def component_total(
    pairs: DataFrame,
    stability: DataFrame,
    shortcut: DataFrame,
    head: float = 1.0,
    rank: float = 0.2,
    stable: float = 0.05,
    short: float = 0.0,
) -> DataFrame:
    """Weighted sum of the per-date components."""
    total = (
        F.lit(head) * F.col("head_loss")
        + F.lit(rank) * F.col("global_loss")
        + F.lit(stable) * F.col("stability_penalty")
        + F.lit(short) * F.col("shortcut_penalty")
    )
    return (
        pairs.join(stability, "trade_date")
        .join(shortcut, "trade_date")
        .withColumn("total_loss", total)
    )


def auxiliary_regression(rows: DataFrame, extent: Extent, alpha: float = 0.5) -> DataFrame:
    """Mix of squared and absolute error against the date's min-max label."""
    ranged = with_date_stats(rows, extent, _lo=F.min("label"), _hi=F.max("label"))
    unit = (F.col("label") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-8))
    gap = F.col("score") - unit
    return ranged.groupBy("trade_date").agg(
        (F.lit(alpha) * F.avg(gap * gap) + F.lit(1.0 - alpha) * F.avg(F.abs(gap))).alias("aux_loss")
    )
