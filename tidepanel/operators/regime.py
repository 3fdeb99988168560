"""Market regimes by date, and audited stratified sampling of dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.numeric import to_numeric
from tidepanel.operators.market import rolling_state
from tidepanel.plans.permutation import keyed_number, permuted
from tidepanel.schemas import DataContractError, require_columns, require_none

STATES = ("weak", "normal", "strong")
INDICATORS = ("market_return_20", "market_volatility_20", "market_drawdown_60", "breadth_20")
MIN_FIT_DAYS = 30

# Test name, indicator, which quantile, and the comparison.
TESTS = {
    "weak_low_return": ("market_return_20", "q30", "<="),
    "weak_high_volatility": ("market_volatility_20", "q70", ">="),
    "weak_deep_drawdown": ("market_drawdown_60", "q30", "<="),
    "weak_low_breadth": ("breadth_20", "q30", "<="),
    "strong_high_return": ("market_return_20", "q70", ">="),
    "strong_low_volatility": ("market_volatility_20", "q30", "<="),
    "strong_shallow_drawdown": ("market_drawdown_60", "q70", ">="),
    "strong_high_breadth": ("breadth_20", "q70", ">="),
}


def state_table(panel: DataFrame) -> DataFrame:
    """Date-level indicators over all given rows.

    A missing return counts in the breadth denominator and as zero in the
    wealth index, unlike the market features.
    """
    require_columns(panel, ["trade_date", "pct_chg"], "market regimes")
    ret = to_numeric(F.col("pct_chg")) / 100.0
    daily = (
        panel.select("trade_date", ret.alias("_ret"))
        .groupBy("trade_date")
        .agg(
            F.avg("_ret").alias("market_return"),
            F.avg(F.coalesce(F.col("_ret") > 0, F.lit(False)).cast("double")).alias(
                "breadth_positive"
            ),
            F.count("_ret").alias("stocks_observed"),
        )
    )
    return rolling_state(daily, "breadth_20", empty_return=0.0)


def fit_thresholds(state: DataFrame, train_dates: DataFrame) -> dict[str, float]:
    """Interpolated 30 % and 70 % quantiles over the training dates."""
    fit = state.join(train_dates.select("trade_date").distinct(), "trade_date", "left_semi").dropna(
        subset=list(INDICATORS)
    )
    row = fit.agg(
        F.count("*").alias("fit_days"),
        F.min("trade_date").alias("fit_start"),
        F.max("trade_date").alias("fit_end"),
        *[F.percentile(c, F.array(F.lit(0.3), F.lit(0.7))).alias(c) for c in INDICATORS],
    ).first()
    if row["fit_days"] < MIN_FIT_DAYS:
        raise DataContractError(f"{row['fit_days']} training days, {MIN_FIT_DAYS} needed")
    limits = {f"{c}_{q}": row[c][i] for c in INDICATORS for i, q in enumerate(("q30", "q70"))}
    return {**limits, "fit_days": row["fit_days"], "fit_start": row["fit_start"], "fit_end": row["fit_end"]}


def label_states(state: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Weak when three of its four tests hold, else strong likewise, else
    normal. A missing indicator passes no test."""
    tests = {}
    for name, (indicator, quantile, sign) in TESTS.items():
        limit = F.lit(limits[f"{indicator}_{quantile}"])
        held = F.col(indicator) <= limit if sign == "<=" else F.col(indicator) >= limit
        tests[name] = F.coalesce(held, F.lit(False))

    def score(kind: str) -> Column:
        total = F.lit(0)
        for name in TESTS:
            if name.startswith(kind):
                total = total + F.col(name).cast("int")
        return total

    return (
        state.withColumns(tests)
        .withColumns({"weak_score": score("weak"), "strong_score": score("strong")})
        .withColumn(
            "market_state",
            F.when(F.col("weak_score") >= 3, "weak")
            .when(F.col("strong_score") >= 3, "strong")
            .otherwise("normal"),
        )
    )


def draw_targets(counts: Mapping[str, int], weak_share: float) -> dict[str, int]:
    """Draws per state for as many draws as dates; halves round to even."""
    if not 0.0 < weak_share < 1.0:
        raise DataContractError("the weak share must lie strictly between 0 and 1")
    unknown = set(counts) - set(STATES)
    if unknown:
        raise DataContractError(f"unknown states {sorted(unknown)}")
    if not counts.get("weak"):
        raise DataContractError("no weak date to sample")
    rest = counts.get("normal", 0) + counts.get("strong", 0)
    if not rest:
        raise DataContractError("no normal or strong date to sample")
    total = sum(counts.values())
    weak = round(total * weak_share)
    normal = round((total - weak) * counts.get("normal", 0) / rest)
    return {"weak": weak, "normal": normal, "strong": total - weak - normal}


def stratified_sample(
    dates: DataFrame, weak_share: float, seed: int, epoch: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Draw dates per state at the exact target counts, in shuffled order.

    Every date of a state is drawn once before any repeats, and repeats are drawn with
    replacement. Draw number, slot of a state and place of a date in its state are tied
    by keyed permutations, so each draw finds its date alone, without an order of all
    draws, and alike on every cluster. Returns the draws and the one-row audit.
    ``dates`` holds trade_date and market_state, one row per day.
    """
    counts = {r["market_state"]: r["count"] for r in dates.groupBy("market_state").count().collect()}
    targets = draw_targets(counts, weak_share)
    total, key = sum(targets.values()), F.lit(str(seed + epoch))
    place = F.row_number().over(Window.partitionBy("market_state").orderBy("trade_date")) - 1
    numbered = dates.select("trade_date", "market_state", place.cast("long").alias("_n"))
    # Slots: first all of the first state, then those of the second, and so on.
    slot = permuted(F.col("id"), F.lit(total), F.concat(key, F.lit(":draws")))
    state, have, first, end = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"), total
    for name in reversed(STATES):
        inside = F.col("_slot") < end  # later states are replaced by earlier ones that hold the slot
        end -= targets[name]
        state = F.when(inside, F.lit(name)).otherwise(state)
        have = F.when(inside, F.lit(counts.get(name, 0)).cast("long")).otherwise(have)
        first = F.when(inside, F.lit(end).cast("long")).otherwise(first)
    slots = dates.sparkSession.range(total).withColumn("_slot", slot)
    slots = slots.select("id", state.alias("market_state"), have.alias("_have"), (F.col("_slot") - first).alias("_j"))
    own = F.concat(key, F.lit(":"), F.col("market_state"))
    chosen = F.when(F.col("_j") < F.col("_have"), permuted(F.col("_j"), F.col("_have"), own)).otherwise(
        keyed_number(own, F.lit("again"), F.col("_j")) % F.col("_have")
    )
    drawn = slots.withColumn("_n", chosen).join(numbered, ["market_state", "_n"])
    drawn = drawn.select((F.col("id") + 1).cast("int").alias("draw"), "trade_date", "market_state")
    audit = drawn.agg(
        F.lit(epoch + 1).alias("epoch"),
        F.lit(seed).alias("sampler_seed"),
        F.lit(seed + epoch).alias("epoch_seed"),
        F.lit(float(weak_share)).alias("weak_target_share"),
        F.count("*").alias("sample_count"),
        *[F.count_if(F.col("market_state") == s).alias(f"{s}_draws") for s in STATES],
        (F.count("*") - F.countDistinct("trade_date")).alias("repeat_draws"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("draw", "trade_date"))), lambda s: s["trade_date"]
        ).alias("sampled_dates"),
    )
    return drawn, audit


def state_counts(labelled: DataFrame, train_dates: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Natural counts per state on training dates, and the audit table with a
    flag for the dates the thresholds were fitted on."""
    train = train_dates.select("trade_date").distinct()
    if check:
        require_none(
            train.join(labelled, "trade_date", "left_anti"), F.lit(True), "date without a state"
        )
    flagged = labelled.join(
        train.withColumn("_fit", F.lit(True)), "trade_date", "left"
    ).withColumn("is_threshold_fit_train_date", F.col("_fit").isNotNull()).drop("_fit")
    counts = flagged.where("is_threshold_fit_train_date").groupBy("market_state").agg(
        F.count("*").alias("n_dates")
    )
    return counts, flagged
