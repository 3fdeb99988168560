"""Overlapping windows stored once: blocks of rows, and where in them a sample lies.

The rows of a code are cut into blocks that repeat the last ``length`` - 1 rows of the
block before, so every window of ``length`` rows lies inside one block. A sample is a
block number and an offset; its rows are sliced out of the block only when it is read.
A value is stored once and a bit (``block_rows`` = 4 windows: 1.25 times), not
``length`` times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators.sequences import by_code, labelled
from tidepanel.plans.staging import stage
from tidepanel.schemas import DataContractError, candidate, require_columns


@dataclass(frozen=True)
class SequenceStore:
    """``blocks``: code, block, rows (values of the features, row by row).
    ``ends``: the panel's rows without the features, with block and offset of the
    window that ends there; both are null where the code has too few rows before."""

    blocks: DataFrame
    ends: DataFrame
    length: int

    def expand(self, ends: DataFrame | None = None) -> DataFrame:
        """Samples of the given rows of ``ends`` (all by default) with their ``seq``."""
        wanted = (self.ends if ends is None else ends).where(F.col("offset").isNotNull())
        rows = F.slice("rows", F.col("offset") + 1, self.length)
        return wanted.join(self.blocks, ["code", "block"]).withColumn("seq", rows).drop("rows", "block", "offset")

    def sliding_sequences(self) -> DataFrame:
        """Samples that end on candidates with a finite label."""
        chosen = self.ends.where(candidate(self.ends) & labelled())
        return self.expand(chosen.select("trade_date", "code", "label", "block", "offset"))

    def all_labelled_sequences(self, min_stocks: int = 10) -> DataFrame:
        """Labelled samples of dates with enough labelled rows, members or not."""
        some = self.ends.where(F.col("label").isNotNull()).groupBy("trade_date").agg(F.count("*").alias("n"))
        chosen = self.ends.where(labelled()).join(some.where(F.col("n") >= min_stocks), "trade_date", "left_semi")
        return self.expand(chosen.select("trade_date", "code", "label", "block", "offset"))

    def inference_sequences(self, day, check: bool = True) -> DataFrame:
        """Samples of the candidates of a day, label or not."""
        today = self.ends.where(F.col("trade_date") == F.lit(day).cast("date"))
        if check and not today.limit(1).count():
            raise DataContractError("the prediction date is not in the data")
        return self.expand(today.where(candidate(today)).select("trade_date", "code", "block", "offset"))

    def write(self, path: str) -> None:
        """Both tables below ``path``, blocks of a code together and in order."""
        self.blocks.sortWithinPartitions("code", "block").write.mode("overwrite").parquet(f"{path}/blocks")
        self.ends.write.mode("overwrite").parquet(f"{path}/ends")


def read_store(spark: SparkSession, path: str, length: int) -> SequenceStore:
    return SequenceStore(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/ends"), length)


def store_sequences(panel: DataFrame, features: Sequence[str], length: int, block_rows: int | None = None, staged: bool = False) -> SequenceStore:
    """Lay a panel out. One shuffle by code serves positions and blocks alike.

    A code has at most one row a day, so a code's rows are bounded; a group of the
    aggregation is one block. ``staged`` writes both tables before they are read."""
    require_columns(panel, ["code", "trade_date", *features], "sequences")
    size = block_rows or 4 * length
    if not 0 < length <= size:
        raise DataContractError("a block must hold a window at least")
    position = F.row_number().over(by_code()).cast("long") - 1
    placed = panel.withColumn("_at", position).withColumn("block", F.floor(F.col("_at") / size))
    begin = F.greatest(F.col("block") * size - (length - 1), F.lit(0))
    full = F.col("_at") >= length - 1
    ends = placed.select(
        *[c for c in panel.columns if c not in features or c in ("code", "trade_date", "label")],
        F.when(full, F.col("block")).alias("block"),
        F.when(full, F.col("_at") - (length - 1) - begin).cast("int").alias("offset"),
    )
    # A row near the end of its block is context of the next one as well.
    next_too: Column = F.col("_at") % size > size - length
    here = F.when(next_too, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))
    row = F.struct("_at", F.array(*[F.col(f).cast("double") for f in features]).alias("values"))
    copies = placed.select("code", F.col("_at"), F.explode(here).alias("block"), row.alias("row"))
    grouped = copies.groupBy("code", "block").agg(F.sort_array(F.collect_list("row")).alias("r"), F.max("_at").alias("last"))
    # Context alone, behind the code's last row, is no block.
    blocks = grouped.where(F.col("last") >= F.col("block") * size).select("code", "block", F.col("r.values").alias("rows"))
    if staged:
        blocks, ends = stage(blocks, "blocks"), stage(ends, "ends")
    return SequenceStore(blocks, ends, length)
