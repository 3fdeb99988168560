"""Registered queries: name, survey row, Spark callable and reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.catalog.base import Tables, tables


@dataclass(frozen=True)
class Entry:
    name: str
    rows: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def comparable(x: Column) -> Column:
    """Round by magnitude, so that differences in the order of summation vanish.

    The small offset keeps values that are exact halves off the rounding edge.
    """
    return (
        F.when(F.abs(x) < 100, F.round(x + 1.7e-9, 6) + 0.0)
        .when(F.abs(x) < 1e6, F.round(x + 1.7e-6, 3) + 0.0)
        .otherwise(F.round(x / 1e6 + 1.7e-3, 0) * 1e6)
    )


def shaped(df: DataFrame, cols: str = "", dbl: str = "") -> DataFrame:
    """Pick the output columns; counters become long."""
    types = {f.name: f.dataType for f in df.schema.fields}
    picks = []
    for name in cols.split():
        small = isinstance(types[name], (T.IntegerType, T.ShortType))
        picks.append(F.col(name).cast("long").alias(name) if small else F.col(name))
    picks += [comparable(F.col(name)).alias(name) for name in dbl.split()]
    return df.select(*picks)


def query(name: str, rows: str, oracle: str | None = None, cols: str = "", dbl: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = fn(tables(spark, folder))
            return shaped(result, cols, dbl) if cols or dbl else result

        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, rows, run, oracle)
        return fn

    return register


def checked(name: str, rows: str, deps: str, body: str, cols: str = "", dbl: str = ""):
    """Register a query together with its reference SQL; both give ``cols`` as
    they are and ``dbl`` rounded."""
    from tidepanel.catalog.oracle import sql

    return query(name, rows, sql(deps, body, dbl, cols), cols, dbl)
