"""Small helpers of the operators: measured sizes, shared tables, hashing of ids."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.words import mix

#: Text bytes that one task or group should hold at about.
GROUP_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; one of its own only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tidepanel-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def group_count(df: DataFrame, text: str, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups of about ``group_bytes`` the text column fills; one scan."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(4, -(-int(total) // group_bytes))


def spread(ids: np.ndarray, n: int) -> np.ndarray:
    """A group number below ``n`` for each 64-bit id."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def is_local_path(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")
