"""Tables to files; Spark's committer makes every write all-or-nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.schemas import require_none


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet", by_year: bool = True) -> None:
    """The panel with the rows of a code together, partitioned by year."""
    laid_out = panel
    writer_keys = []
    if by_year:
        laid_out = laid_out.withColumn("year", F.year("trade_date"))
        writer_keys = ["year"]
    # A year is spread over tasks by code, so one large year is not one task.
    laid_out = laid_out.repartition(*writer_keys, "code").sortWithinPartitions(
        *writer_keys, "code", "trade_date"
    )
    writer = laid_out.write.mode("overwrite")
    if by_year:
        writer = writer.partitionBy("year")
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def json_lines(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json_report(report: DataFrame, path: str) -> None:
    """One JSON object per row of a small report table.

    The rows move to one task; the plan before them keeps its own tasks."""
    json_lines(report).repartition(1).write.mode("overwrite").text(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines audit folder."""
    rows.write.mode("append").json(path)


def write_ordered(rows: DataFrame, path: str, order: Sequence[str], overwrite: bool = False) -> None:
    """CSV part files that follow each other in ``order``, and beside them, in
    ``<path>.manifest``, a list of the files in this order with their numbers of rows.

    Every range of rows is written by a task of its own; equal keys stay together."""
    mode = "overwrite" if overwrite else "errorifexists"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).csv(path, header=True)
    written = rows.sparkSession.read.csv(path, header=True, schema=rows.schema).select(F.col("_metadata.file_name").alias("file"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = written.groupBy("file").agg(F.count("*").alias("rows")).select(number.alias("part"), "file", "rows")
    # A row for each file.
    json_lines(files.coalesce(1).sortWithinPartitions("part")).write.mode(mode).text(f"{path}.manifest")


def read_ordered(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows that write_ordered() wrote, with the ``part`` they stand in.

    Refused if a listed file has another number of rows now, or rows stand elsewhere."""
    manifest = spark.read.schema("part long, file string, rows long").json(f"{path}.manifest")
    found = spark.read.csv(path, header=True, schema=schema).select("*", F.col("_metadata.file_name").alias("file"))
    counts = found.groupBy("file").agg(F.count("*").alias("n"))
    both = manifest.join(counts, "file", "full").where(~F.col("rows").eqNullSafe(F.col("n")))
    require_none(both, F.lit(True), f"{path}: files differ from the manifest")
    return found.join(manifest.select("file", "part"), "file").drop("file")


def write_result(portfolio: DataFrame, path: str, overwrite: bool = False) -> None:
    """The selected names and weights by date; an existing target is kept by default."""
    write_ordered(portfolio, path, ["trade_date", "stock_id"], overwrite)


def write_ranking(ranking: DataFrame, path: str, overwrite: bool = False) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    ranking.write.mode(mode).csv(path, header=True)


def write_rerank_outputs(
    audit: DataFrame, manifest: DataFrame, path: str, k: int = 5, overwrite: bool = False
) -> None:
    """Original and final selection, the full audit by date and final rank, and the manifest."""
    for rank, name in (("original_rank", "original_result"), ("final_rank", "result")):
        picked = audit.where(F.col(rank) <= k).select(
            "trade_date", F.col("code").alias("stock_id"), F.lit(1.0 / k).alias("weight")
        )
        write_result(picked, f"{path}/{name}", overwrite)
    write_ordered(audit, f"{path}/ranking_audit", ["trade_date", "final_rank"], overwrite)
    mode = "overwrite" if overwrite else "errorifexists"
    json_lines(manifest).write.mode(mode).text(f"{path}/rerank_audit")


def write_evaluation(daily: DataFrame, summary: DataFrame, path: str) -> None:
    """Summary as JSON and the daily table as CSV."""
    write_json_report(summary, f"{path}/evaluation")
    daily.write.mode("overwrite").csv(f"{path}/evaluation_daily", header=True)
