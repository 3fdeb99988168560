"""Landed files to typed tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.codes import constituent_digits, constituent_symbol, zfill
from tidepanel.functions.numeric import to_numeric
from tidepanel.functions.text import parse_date, parse_flag
from tidepanel.schemas import FLAG_COLUMNS, PANEL_SCHEMA

# Column names of the published panel file.
PANEL_NAMES = {
    "股票代码": "code",
    "日期": "trade_date",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "volume",
    "成交额": "amount",
    "振幅": "amplitude",
    "涨跌额": "change_amt",
    "换手率": "turnover",
    "涨跌幅": "pct_chg",
}


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_csv(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """A headed CSV with every column as text, so nothing is guessed."""
    return spark.read.schema(text_schema(names)).csv(path, header=True, enforceSchema=False)


def csv_header(spark: SparkSession, path) -> list[str]:
    first = spark.read.text(path).limit(1).collect()[0][0]
    return [name.strip().strip('"') for name in first.lstrip("﻿").split(",")]


def type_panel(raw: DataFrame) -> DataFrame:
    """Text columns to the panel's types: padded code, date, numbers, flags."""
    for old, new in PANEL_NAMES.items():
        if old in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    typed = {}
    for field in PANEL_SCHEMA.fields:
        if field.name not in raw.columns:
            continue
        value = F.col(field.name)
        if field.name == "code":
            typed["code"] = zfill(value)
        elif field.name == "trade_date":
            typed["trade_date"] = parse_date(value)
        elif isinstance(field.dataType, T.DoubleType):
            typed[field.name] = to_numeric(value)
        elif field.name in FLAG_COLUMNS or isinstance(field.dataType, T.BooleanType):
            typed[field.name] = parse_flag(value)
    return raw.withColumns(typed)


def read_panel(spark: SparkSession, path, names: Sequence[str] | None = None) -> DataFrame:
    """The model panel from CSV. Codes and dates are never inferred."""
    return type_panel(read_text_csv(spark, path, names or csv_header(spark, path)))


def read_raw_responses(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """Many landed CSV files as one text table, each row with its file."""
    raw = read_text_csv(spark, path, names)
    return raw.select("*", F.col("_metadata.file_path").alias("file_path"))


def constituents(listed: DataFrame, arrival: str | None = None) -> DataFrame:
    """Constituent list with bare digits and a prefixed symbol, one row per code."""
    coded = listed.where(F.col("code").isNotNull()).select(
        constituent_digits(F.col("code")).alias("digits"),
        constituent_symbol(F.col("code")).alias("symbol"),
        F.col(arrival).alias("_at") if arrival else F.lit(0).alias("_at"),
    )
    first = Window.partitionBy("digits").orderBy("_at", "symbol")
    return (
        coded.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .select(F.col("digits").alias("code"), "symbol")
    )


def read_announcements(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Saved search responses to one row per announcement; one response a file, or a line."""
    schema = (
        "data array<struct<id:string,title:string,headline:string,itemType:string,"
        "itemDate:string,content:string>>"
    )
    return (
        spark.read.schema(schema)
        .json(path, multiLine=multi_line)
        .select(F.explode("data").alias("d"))
        .select(
            F.col("d.id").alias("announcement_id"),
            F.col("d.itemType").alias("item_type"),
            F.coalesce("d.headline", "d.title", F.lit("")).alias("title"),
            parse_date(F.col("d.itemDate")).alias("item_date"),
            F.coalesce("d.content", F.lit("")).alias("content"),
        )
    )


#: Files up to this size are hashed as one value.
WHOLE_BYTES = 256 << 20


def checksum_manifest(
    spark: SparkSession, path, pattern: str = "*", whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """SHA-256 and size of every file, each file hashed inside a task.

    Spark hands a file over as one value; files of WHOLE_BYTES and more are read
    in pieces instead, through a filesystem that the executors reach.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    whole = files.where(F.col("length") < whole_bytes).select("path", F.sha2("content", 256).alias("sha256"), "length")
    large = files.where(F.col("length") >= whole_bytes).select("path", "length")
    streamed = large.mapInPandas(_hash_files, "path string, sha256 string, length long")
    return whole.unionByName(streamed).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("path").alias("file_path"),
        "sha256",
        F.col("length").alias("bytes"),
    )


def _hash_files(frames):
    """Hash each file of a batch of paths, a few MB at a time."""
    import hashlib

    from pyarrow.fs import FileSystem

    for frame in frames:
        hashes = []
        for path in frame["path"]:
            files, place = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
            digest = hashlib.sha256()
            with files.open_input_stream(place) as source:
                while piece := source.read(4 << 20):
                    digest.update(piece)
            hashes.append(digest.hexdigest())
        yield frame.assign(sha256=hashes)[["path", "sha256", "length"]]


def csv_row_counts(spark: SparkSession, path) -> DataFrame:
    """Data rows per CSV file."""
    return (
        spark.read.csv(path, header=True, recursiveFileLookup=True)
        .groupBy(F.col("_metadata.file_path").alias("file_path"))
        .agg(F.count("*").alias("rows"))
    )
