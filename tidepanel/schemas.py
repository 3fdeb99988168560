"""Column contracts and the explicit key checks Spark joins do not make."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "close", "high", "low")

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("trade_date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("amplitude", T.DoubleType()),
        T.StructField("change_amt", T.DoubleType()),
        T.StructField("turnover", T.DoubleType()),
        T.StructField("pct_chg", T.DoubleType()),
        T.StructField("adj_factor", T.DoubleType()),
        T.StructField("is_member", T.BooleanType()),
        T.StructField("is_suspended", T.BooleanType()),
        T.StructField("is_tradable", T.BooleanType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("label_entry_failed", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("in_signal_range", T.BooleanType()),
    ]
)

FLAG_COLUMNS = ("is_member", "is_suspended", "is_tradable", "in_signal_range")

SNAPSHOT_SCHEMA = "trade_date date, con_code string, weight double"
EVENT_SCHEMA = (
    "effective_date date, con_code string, action string, source_announcement string"
)
BAR_SCHEMA = (
    "ts_code string, trade_date date, open double, close double, high double, "
    "low double, vol double, amount double, turnover_rate double, adj_factor double"
)
SCORE_SCHEMA = "trade_date date, code string, score double, label double"
NOTICE_SCHEMA = (
    "announcement_id string, item_type string, title string, item_date date, content string"
)


class DataContractError(ValueError):
    """The input breaks a rule the computation depends on."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise DataContractError(f"{what}: missing columns {missing}")


def require_none(df: DataFrame, broken: Column, what: str) -> None:
    """Run one filtered look-up and raise with an example when a row matches."""
    rows = df.where(broken).limit(1).collect()
    if rows:
        raise DataContractError(f"{what}: {rows[0].asDict()}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    duplicated = df.groupBy(*keys).count().where("count > 1")
    rows = duplicated.limit(1).collect()
    if rows:
        raise DataContractError(f"{what}: duplicate key {rows[0].asDict()}")


def candidate(df: DataFrame) -> Column:
    """Member and tradable; a flag column that is absent counts as all true."""
    flags = [
        F.coalesce(F.col(name), F.lit(False))
        for name in ("is_member", "is_tradable")
        if name in df.columns
    ]
    result = F.lit(True)
    for flag in flags:
        result = result & flag
    return result

