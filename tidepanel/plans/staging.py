"""Cut lineage by writing a table into the folder the cluster shares.

A staged table survives the loss of executors, keeps column pruning and filter
push-down, and carries exact file sizes, so Catalyst picks its join strategy
from a measured size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidepanel.schemas import DataContractError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Without one, local sessions get a temporary folder that goes with the process;
    on a cluster executors would each write to their own disk, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = _local_folder(spark.sparkContext.master, spark.sparkContext.applicationId)
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}


def _local_folder(master: str, app: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise DataContractError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidepanel-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def release(spark: SparkSession) -> None:
    """Delete all tables and files that this session staged."""
    app = spark.sparkContext.applicationId
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for kind in ("staged", "files"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{kind}/{app}")
        path.getFileSystem(conf).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/staged/{app}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
