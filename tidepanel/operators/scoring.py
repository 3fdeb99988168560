"""Scoring of a submitted portfolio against later prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.codes import zfill
from tidepanel.plans.extent import BROADCAST_ROWS
from tidepanel.schemas import DataContractError

MAX_PICKS = 5
FAILED_SCORE = -999.0  # fixed value
NAMES = {"股票代码": "stock_id", "权重": "weight"}  # fixed values: accepted aliases


def validate_submission(picks: DataFrame) -> DataFrame:
    """Picks under their standard names; raises when the rules are broken."""
    for alias, name in NAMES.items():
        if name not in picks.columns and alias in picks.columns:
            picks = picks.withColumnRenamed(alias, name)
    if not {"stock_id", "weight"} <= set(picks.columns):
        raise DataContractError("a submission needs stock_id and weight")
    row = picks.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    if row["n"] > MAX_PICKS:
        raise DataContractError(f"at most {MAX_PICKS} picks")
    # An empty submission sums to zero.
    if not 0.0 <= (row["w"] or 0.0) <= 1.0:
        raise DataContractError(f"weights sum to {row['w']}")
    return picks.select(
        zfill(F.col("stock_id").cast("string")).alias("code"), F.col("weight").cast("double")
    )


def portfolio_returns(picks: DataFrame, bars: DataFrame, last_rows: int = 5) -> DataFrame:
    """Open-to-open return over the last rows of every picked code.

    A single row returns 0; a code without rows is missing and adds nothing.
    ``picks`` may hold any number of rows: they are counted before they are broadcast.
    """
    few = picks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda df: df)
    held = bars.join(side(picks.select("code").distinct()), "code", "left_semi")
    newest = Window.partitionBy("code").orderBy(F.desc("trade_date"))
    tail = held.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last_rows)
    moves = tail.groupBy("code").agg(
        F.min_by("open", "trade_date").alias("first_open"),
        F.max_by("open", "trade_date").alias("last_open"),
    )
    return moves.join(side(picks), "code").select(
        "code",
        "weight",
        F.try_divide(F.col("last_open") - F.col("first_open"), F.col("first_open")).alias("ret"),
    )


def portfolio_score(picks: DataFrame, bars: DataFrame, last_rows: int = 5) -> DataFrame:
    return portfolio_returns(picks, bars, last_rows).agg(
        F.coalesce(F.sum(F.col("ret") * F.col("weight")), F.lit(0.0)).alias("final_score")
    )


def score_submission(picks: DataFrame, bars: DataFrame) -> DataFrame:
    """The portfolio's score, or the fixed failure score for an invalid one."""
    try:
        valid = validate_submission(picks)
    except DataContractError:
        return bars.sparkSession.range(1).select(F.lit(FAILED_SCORE).alias("final_score"))
    return portfolio_score(valid, bars)
