"""Standardisation fitted on training rows and kept as a parameter table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.numeric import finite_or_null
from tidepanel.schemas import DataContractError, candidate

PARAMETERS = "feature string, mean double, scale double"


def train_rows(panel: DataFrame, start, end) -> Column:
    """Candidates in the signal range whose date lies in the training period."""
    inside = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    rows = inside & candidate(panel)
    if "in_signal_range" in panel.columns:
        rows = rows & F.coalesce(F.col("in_signal_range"), F.lit(False))
    return rows


def drop_incomplete(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Non-finite features count as missing; rows with a missing one drop."""
    return panel.withColumns({f: finite_or_null(F.col(f)) for f in features}).dropna(
        subset=list(features)
    )


def fit_standardizer(panel: DataFrame, features: Sequence[str], rows: Column) -> DataFrame:
    """Mean and population standard deviation per feature, one row each."""
    fitted = (
        drop_incomplete(panel, features)
        .where(rows)
        .agg(
            *[F.avg(f).alias(f"m_{f}") for f in features],
            *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
        )
    )
    pairs = ", ".join(f"'{f}', `m_{f}`, `s_{f}`" for f in features)
    return fitted.select(F.expr(f"stack({len(features)}, {pairs}) as (feature, mean, scale)"))


def parameters(table: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Read a parameter table, checking that it fits the feature list.

    A scale of zero divides by one.
    """
    rows = {r["feature"]: r for r in table.limit(len(features) + 1).collect()}
    if set(rows) != set(features):
        raise DataContractError("the standardiser was fitted on other features")
    if any(r["mean"] is None for r in rows.values()):
        raise DataContractError("no training rows to fit the standardiser on")
    return {f: (rows[f]["mean"], rows[f]["scale"] or 1.0) for f in features}


def apply_standardizer(panel: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return drop_incomplete(panel, list(fitted)).withColumns(
        {f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in fitted.items()}
    )
