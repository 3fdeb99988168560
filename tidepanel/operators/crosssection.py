"""Ranks across the entities of one date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.plans.extent import Extent, gathered_dates
from tidepanel.plans.ordering import prefix_columns, prefix_sums, row_positions
from tidepanel.schemas import candidate, require_columns, require_none


INLINE_COLUMNS = 2


def _rank_in_turn(df, columns, counted, formula, extent, keys) -> DataFrame:
    """One window a column over the same partitions by date.

    Of more than INLINE_COLUMNS columns the ranks are those of their key, as if joined
    back on it: rows that share one get the largest, rows without one get none."""
    ranked = gathered_dates(df, extent)
    for name in columns:
        # One column after the other: a rank takes its value's place before the next sort.
        ranked = ranked.withColumn(name, formula(name, *prefix_columns(["trade_date"], F.col(name), counted)))
    if len(columns) <= INLINE_COLUMNS:
        return ranked
    named = F.lit(True)
    for key in keys:
        named = named & F.col(key).isNotNull()
    alike = Window.partitionBy(*keys)
    others = [c for c in df.columns if c not in (*keys, *columns)]
    return ranked.select(*keys, *others, *[F.when(named, F.max(c).over(alike)).alias(c) for c in columns])


def _rank_many(
    df: DataFrame,
    columns: Sequence[str],
    counted: Column,
    formula: Callable[[str, Column, Column, Column], Column],
    extent: Extent,
    keys: Sequence[str] = ("trade_date", "code"),
) -> DataFrame:
    """Replace columns by a rank built from counts of values below and equal.

    While a date fits one task, its rows are shuffled once and sorted by each column in
    turn. Otherwise the columns are unpivoted, ranked in a single pass over (date, column)
    groups, and put back.
    """
    if extent.direct:
        return _rank_in_turn(df, columns, counted, formula, extent, keys)
    pairs = ", ".join(f"{i}, `{name}`" for i, name in enumerate(columns))
    tall = df.select(
        *keys,
        counted.alias("_counted"),
        F.expr(f"stack({len(columns)}, {pairs}) as (_name, _v)"),
    )
    ranked = prefix_sums(
        tall,
        ["trade_date", "_name"],
        "_v",
        {"_n": F.col("_counted")},
        extent,
        fan_out=len(columns),
    )
    parts = (F.col("_n_le"), F.col("_n_tie"), F.col("_n_all"))
    wide = ranked.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_name") == i, formula(name, *parts))).alias(name)
            for i, name in enumerate(columns)
        ]
    )
    return df.drop(*columns).join(wide, list(keys), "left")


def pit_rank(df: DataFrame, columns: Sequence[str], extent: Extent) -> DataFrame:
    """Share of the date's candidates whose value is not above the row's.

    Every row is placed in the candidates' distribution, candidate or not. A
    date without candidates has no rank.
    """
    require_columns(df, ["trade_date", *columns], "point-in-time rank")
    return _rank_many(
        df,
        columns,
        candidate(df).cast("int"),
        lambda name, le, tie, whole: F.try_divide(le, whole),
        extent,
    )


def average_rank(
    df: DataFrame,
    columns: Sequence[str],
    extent: Extent,
    descending: Sequence[str] = (),
    pct: bool = True,
) -> DataFrame:
    """Average-tie rank among the date's known values, as a share or a count.

    Columns named in ``descending`` rank their largest value first.
    """

    def formula(name, le, tie, whole):
        rank = le - (tie - 1) / F.lit(2.0)
        if name in descending:
            rank = whole + F.lit(1.0) - rank
        return rank / whole if pct else rank

    return _rank_many(df, columns, F.lit(1), formula, extent)


def relevance(df: DataFrame, extent: Extent, label: str = "label", out: str = "relevance", check: bool = False) -> DataFrame:
    """Average rank of the label, 1 for the lowest; every label must be finite."""
    if check:
        require_none(
            df,
            F.col(label).isNull() | ~(F.abs(F.col(label)) < F.lit(float("inf"))),
            "label is not finite",
        )
    return average_rank(df.withColumn(out, F.col(label)), [out], extent, pct=False)


def directional_rank(df: DataFrame, column: str, higher_is_better: bool, extent: Extent, check: bool = True) -> DataFrame:
    """Average-tie percent rank where 1 is best; missing values are refused."""
    if check:
        require_none(
            df.select("trade_date", column),
            F.col(column).isNull() | ~(F.abs(F.col(column)) < F.lit(float("inf"))),
            f"{column} has missing or non-finite values",
        )
    return average_rank(df, [column], extent, () if higher_is_better else (column,))


def score_order(df: DataFrame, extent: Extent, score: str = "score", out: str = "raw_rank") -> DataFrame:
    """1-based place by score, best first; equal scores go by code."""
    return row_positions(df, ["trade_date"], [F.desc(score), F.col("code")], extent, out)


def full_ranking(scores: DataFrame, extent: Extent, k: int = 5) -> DataFrame:
    """The complete ranking table with the equal-weight selection marked."""
    placed = score_order(scores, extent)
    chosen = F.col("raw_rank") <= k
    return placed.select(
        F.col("trade_date").alias("signal_date"),
        F.col("code").alias("stock_id"),
        F.col("score").alias("raw_score"),
        "raw_rank",
        F.col("label").alias("future_return"),
        chosen.alias("selected_top5"),
        F.when(chosen, F.lit(1.0 / k)).otherwise(F.lit(0.0)).alias("weight"),
    )


def top_k(scores: DataFrame, k: int = 5, check: bool = True) -> DataFrame:
    """The k best rows of every date.

    The row-number filter is pushed below the shuffle, so every task sends at
    most k rows per date whatever the size of the date.
    """
    best = Window.partitionBy("trade_date").orderBy(F.desc("score"), F.col("code"))
    picked = scores.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    if check:
        short = picked.groupBy("trade_date").count().where(F.col("count") < k)
        require_none(short, F.lit(True), f"fewer than {k} names to select from")
    return picked


def top_k_portfolio(scores: DataFrame, k: int = 5, check: bool = True) -> DataFrame:
    return top_k(scores, k, check).select(
        "trade_date", F.col("code").alias("stock_id"), F.lit(1.0 / k).alias("weight")
    )
