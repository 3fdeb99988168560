"""Documents to token ids in five stages, each written and read again.

Toxic documents go; of each group of near-duplicates the one with the smallest id
stays (its exactly repeated rows with it); documents with passages of the benchmark
go; secrets are replaced by their kind, and ``n_chars`` follows; the last stage
returns token ids. Each stage takes all that the one before kept. Rows with a null
id or text pass through every stage: they can't be linked, and hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import byte_bpe, common, decontamination, minhash_dedup, secret_ledger, toxicity

#: Rejected ids are broadcast up to this many (8 MB), and shuffled beyond.
BROADCAST_IDS = 500_000


#: Columns that stages work with; all others wait under names of their own.
OWN = ("doc_id", "text", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with other columns renamed, so that no name can clash with a stage's."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in OWN else f"_aside_{i}") for i, c in enumerate(docs.columns)])


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, under their names."""
    return df.select(*[F.col(c if c in OWN else f"_aside_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = _aside(docs)
    scored = toxicity.score(own, toxicity.fit(own, labels))
    return _back(scored.where(F.col("score") < 0.5), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 and more."""
    found = minhash_dedup.near_duplicates(docs, percent=80)
    gone = common.written(found.where(~F.col("kept")).select("doc_id").distinct(), "duplicates")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that equals a benchmark item but for its error budget."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _back(decontamination.judge(_aside(docs), items).where(F.size("hits") == 0), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by ``[kind]``."""
    own = _aside(docs)
    ledger = secret_ledger.Ledger(spark, common.new_path(spark, "secrets"))
    paths = secret_ledger.spans_of_paths(ledger.scan(own), ledger.findings())
    clean = secret_ledger.redact(own, paths)
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
        clean = clean.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return _back(clean, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the offsets of the pre-tokens."""
    rows = byte_bpe.encode(docs)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "piece_offsets")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_ledger", redact_secrets),
    ("byte_bpe", encode),
]

#: Nearest examples, edit distances and merges aren't SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
