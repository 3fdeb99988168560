"""Micro-batch form of the keep-last upsert.

A batch writes only its own rows, as a delta, and commits a manifest that names it;
readers take the newest row of each key over the base and the deltas of one manifest.
Every few batches the deltas fold into a new base, which is a commit as well: readers
of earlier manifests go on reading the folders they began with, until these expire. A
batch that is retried after a lost driver finds its number committed and writes
nothing, or commits it now; so each batch counts once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidepanel.schemas import DataContractError
from tidepanel.sources.ingest import upsert_keep_last
from tidepanel.streaming.commit_log import CommitLog, Manifest

FOLD_EVERY = 20
#: Seconds that replaced folders stay for readers that began before.
KEEP_SECONDS = 7 * 24 * 3600


def create_target(spark: SparkSession, target: str, schema) -> None:
    """An empty target with the schema of a DataFrame; one that is there stays as it is."""
    log = CommitLog(spark, target)
    if not log.numbers():
        log.commit(Manifest(), schema=schema.json())


def _newest(spark: SparkSession, target: str, manifest: Manifest, keys: Sequence[str], order: str | None) -> DataFrame:
    schema = StructType.fromJson(json.loads(manifest.schema))
    if not manifest.folders:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{target}/{p}").withColumn("_batch", F.lit(i)) for i, p in enumerate(manifest.folders)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    values = [c for c in schema.names if c not in keys]
    rank = F.struct("_batch", *([order] if order else []), *values)
    newest = whole.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values]).select(*schema.names)


def read_target(
    spark: SparkSession, target: str, keys: Sequence[str] = ("code", "trade_date"), order: str | None = None, upto: int | None = None
) -> DataFrame:
    """The newest row of each key, up to a batch if one is given.

    What is read is settled now: later batches and folds don't change it. A target
    without a batch is empty; a folder without a target is refused."""
    log = CommitLog(spark, target)
    found = log.last(upto)
    if found.schema is None:
        raise DataContractError(f"{target}: batch {upto} has expired" if log.numbers() else f"{target} holds no table")
    return _newest(spark, target, found, keys, order)


def fold(spark: SparkSession, target: str, keys: Sequence[str], order: str | None = None) -> Manifest:
    """Commit a base of everything so far in place of the deltas; nothing is deleted."""
    log = CommitLog(spark, target)
    before = log.last()
    if not before.deltas:
        return before
    folder = log.new_folder("base")
    _newest(spark, target, before, keys, order).write.parquet(f"{target}/{folder}")
    return log.commit(before, base=folder, deltas=())


def expire(spark: SparkSession, target: str, older_than: float = KEEP_SECONDS) -> list[str]:
    """Delete what no manifest of the last ``older_than`` seconds names."""
    return CommitLog(spark, target).expire(older_than)


def merge_batch(
    target: str, keys: Sequence[str], order: str | None = None, fold_every: int = FOLD_EVERY, keep_seconds: float = KEEP_SECONDS
) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        create_target(spark, target, batch.schema)
        log = CommitLog(spark, target)
        before = log.last()
        if batch_id > before.batch:  # otherwise retried after its commit
            folder = log.new_folder("delta")
            upsert_keep_last(batch.limit(0), batch, tuple(keys), order).write.parquet(f"{target}/{folder}")
            before = log.commit(before, batch=batch_id, deltas=(*before.deltas, folder))
        if len(before.deltas) >= fold_every:
            fold(spark, target, keys, order)
            log.expire(keep_seconds)

    return merge


def stream_upsert(
    source: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str] = ("code", "trade_date"),
    order: str | None = None,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Start the upsert over everything available and return the query."""
    create_target(source.sparkSession, target, source.schema)
    return (
        source.writeStream.foreachBatch(merge_batch(target, keys, order, fold_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
