"""Joins that refuse repeated keys, checked in the pass that computes them.

Rows of a key are counted by windows over the join's own partitioning, so checking
shuffles nothing more and scans nothing again; the counts leave the job as observed
metrics while its result is written. A null key matches nothing, but counts as a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidepanel.plans.staging import stage
from tidepanel.schemas import DataContractError, require_columns

#: The sides whose keys must be unique.
SIDES = {"one_to_one": ("left", "right"), "many_to_one": ("right",), "one_to_many": ("left",)}


def _told(metrics: Observation) -> dict:
    """What was observed; nothing where Spark saw an empty side and left its plan out."""
    try:
        return metrics.get
    except Py4JJavaError as e:
        if "toPyRow" not in str(e):
            raise
        return {}


def checked_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "one_to_one", how: str = "left", what: str = "join"
) -> tuple[DataFrame, dict[str, int]]:
    """The written join of both sides on ``keys``, and its counts of rows.

    ``validate`` is one of ``one_to_one``, ``many_to_one`` and ``one_to_many``; a key
    that stands twice on a side that must be unique raises DataContractError, whether
    the other side has it or not. Counts: left, right (rows of each side), matched."""
    if validate not in SIDES:
        raise DataContractError(f"unknown validation {validate!r}")
    if how not in ("left", "inner"):
        raise DataContractError("a checked join is a left or an inner join")
    seen = {"left": Observation(f"{what} left"), "right": Observation(f"{what} right")}
    sides = {}
    for name, df in (("left", left), ("right", right)):
        require_columns(df, keys, what)
        metrics = [F.count(F.lit(1)).alias("n")]
        if name in SIDES[validate]:
            df = df.withColumn("_of_key", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
            metrics.append(F.max("_of_key").alias("most"))
            metrics.append(F.max(F.when(F.col("_of_key") > 1, F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).alias("key"))
        sides[name] = df.observe(seen[name], *metrics).drop("_of_key")
    matched = Observation(f"{what} matched")
    other = sides["right"].withColumn("_matched", F.lit(1))
    joined = sides["left"].join(other, list(keys), how)
    result = stage(joined.observe(matched, F.count("_matched").alias("n")).drop("_matched"), what)
    for name in SIDES[validate]:
        found = _told(seen[name])
        if (found.get("most") or 0) > 1:
            raise DataContractError(f"{what}: key {found['key']} is repeated on the {name} side")
    return result, {name: _told(x).get("n", 0) for name, x in (*seen.items(), ("matched", matched))}
