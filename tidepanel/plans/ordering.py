"""Ranks, positions and running sums along a value, per group.

When a group fits one task the plan is a plain window. Otherwise the rows are
range-partitioned by (group, value), every range becomes a bucket whose
contents are summed, and the running sum of the buckets before it is added to
the window inside it. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.plans.extent import Extent, attach
from tidepanel.plans.staging import stage

BUCKET, ROWS, SALT = "_bucket", "_rows", "_salt"
#: Keys with more than this share of all rows are dealt over so many tasks.
HEAVY, SALTS = 1000, 32


def row_positions(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    extent: Extent,
    out: str,
) -> DataFrame:
    """1-based position of every row in its group; ``order`` must be total."""
    if extent.direct:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    buckets = extent.buckets()
    placed = stage(
        df.repartitionByRange(buckets, *by, *order).withColumn(BUCKET, F.spark_partition_id()),
        "positions",
    )
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        placed.groupBy(*by, BUCKET)
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order)
    return (
        attach(placed, heads, [*by, BUCKET], extent.dates + buckets)
        .withColumn(out, (F.row_number().over(inside) + F.col("_before")).cast("long"))
        .drop(BUCKET, "_before")
    )


def prefix_columns(
    by: Sequence[str], value: Column, amount: Column
) -> tuple[Column, Column, Column]:
    """Window form of the sums up to, at and over all values of the group.

    All three are frames of one window, so a value costs one sort and no shuffle but
    that by the group."""
    known = value.isNotNull()
    counted = F.when(known, amount)
    ordered = Window.partitionBy(*by).orderBy(value)
    upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    whole = ordered.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        F.when(known, F.sum(counted).over(upto)),
        F.when(known, F.sum(counted).over(ties)),
        F.when(known, F.sum(counted).over(whole)),
    )


def prefix_sums(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    sums: Mapping[str, Column],
    extent: Extent,
    fan_out: int = 1,
    groups: int | None = None,
) -> DataFrame:
    """Sums over the rows of the group up to the row's value.

    Adds ``<name>_le`` (values not above), ``<name>_tie`` (equal values) and
    ``<name>_all`` (the whole group). Rows whose value is NULL take no part and
    get NULL. ``fan_out`` is how often a date's rows stand here, ``groups`` the most
    groups of a date (``fan_out`` unless given).
    """
    known = F.col(value).isNotNull()
    if extent.direct:
        columns = []
        for name, amount in sums.items():
            le, tie, whole = prefix_columns(by, F.col(value), amount)
            columns += [le.alias(f"{name}_le"), tie.alias(f"{name}_tie"), whole.alias(f"{name}_all")]
        return df.select("*", *columns)

    # Equal values collapse map-side first, so a hot value is one row per task.
    levels = df.where(known).groupBy(*by, value).agg(
        F.count("*").alias(ROWS), *[F.sum(amount).alias(f"{name}_tie") for name, amount in sums.items()]
    )
    buckets = extent.buckets(fan_out)
    placed = stage(
        levels.repartitionByRange(buckets, *by, value).withColumn(BUCKET, F.spark_partition_id()),
        "levels",
    )
    earlier = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    heads = (
        placed.groupBy(*by, BUCKET)
        .agg(*[F.sum(f"{name}_tie").alias(name) for name in sums])
        .select(
            *by,
            BUCKET,
            *[F.sum(name).over(earlier).alias(f"_{name}_before") for name in sums],
            *[F.sum(name).over(whole).alias(f"{name}_all") for name in sums],
        )
    )
    inside = (
        Window.partitionBy(*by, BUCKET)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = attach(placed, heads, [*by, BUCKET], extent.dates * (groups or fan_out) + buckets).select(
        *by,
        value,
        ROWS,
        *[
            # A bucket whose earlier sums are all NULL still counts as zero.
            (F.sum(f"{name}_tie").over(inside) + F.coalesce(F.col(f"_{name}_before"), F.lit(0))).alias(
                f"{name}_le"
            )
            for name in sums
        ],
        *[f"{name}_tie" for name in sums],
        *[f"{name}_all" for name in sums],
    )
    return join_levels(df, ranked, placed, [*by, value])


def join_levels(df: DataFrame, levels: DataFrame, sizes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join every row to its level, one row a key; ``levels`` and the written table
    ``sizes`` tell in ROWS how many rows of ``df`` have a key.

    Keys of over 1 / HEAVY of all rows (so fewer than HEAVY keys) are told by broadcast
    and dealt over SALTS tasks, and their levels with them; rows with a null key match
    nothing and are dealt as well. All others meet as in a plain join."""
    total = sizes.agg(F.coalesce(F.sum(ROWS), F.lit(0))).first()[0]
    heavy = F.col(ROWS) * HEAVY > total
    hot = sizes.where(heavy).select(*on, F.lit(True).alias("_hot"))
    loose = F.col("_hot").isNotNull()
    for name in on:
        loose = loose | F.col(name).isNull()
    # Which task a row goes to changes nothing in the result.
    deal = F.when(loose, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    rows = df.join(F.broadcast(hot), list(on), "left").withColumn(SALT, deal).drop("_hot")
    copies = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(levels.withColumn(SALT, F.explode(copies)).drop(ROWS), [*on, SALT], "left").drop(SALT)
