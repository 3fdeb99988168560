"""Fixed-length sequence samples that end on candidate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.crosssection import relevance
from tidepanel.plans.extent import Extent, attach
from tidepanel.plans.ordering import row_positions
from tidepanel.schemas import DataContractError, candidate, require_columns, require_none


def by_code():
    return Window.partitionBy("code").orderBy("trade_date")
PAD_CHUNK = 4096


def sliding_windows(panel: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """Add ``seq``, the last ``length`` feature rows of the code; NULL before.

    Rows are counted, so a missing day does not drop a window. One window of
    fixed length is held per row.
    """
    recent = by_code().rowsBetween(-(length - 1), 0)
    gathered = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(recent)
    return panel.withColumn("_w", gathered).withColumn(
        "seq", F.when(F.size("_w") == length, F.col("_w"))
    ).drop("_w")


def _samples(panel: DataFrame, features, length: int, ends: Column) -> DataFrame:
    keep = panel.withColumn("_end", ends)
    return (
        sliding_windows(keep, features, length)
        .where(F.col("_end") & F.col("seq").isNotNull())
        .select("trade_date", "code", "seq", "label")
    )


def labelled(label: str = "label") -> Column:
    return F.coalesce(F.abs(F.col(label)) < F.lit(float("inf")), F.lit(False))


def sliding_sequences(panel: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """Samples ending where the row is a candidate with a finite label.

    Rows outside the candidate set still serve as context.
    """
    require_columns(panel, ["code", "trade_date", "label", *features], "sequences")
    return _samples(panel, features, length, candidate(panel) & labelled())


def all_labelled_sequences(panel: DataFrame, features: Sequence[str], length: int, min_stocks: int = 10) -> DataFrame:
    """Per-date variant without membership: needs enough labelled rows before
    and after windows that are too short are dropped."""
    enough = (
        panel.where(F.col("label").isNotNull())
        .groupBy("trade_date")
        .agg(F.count("*").alias("_labelled"))
        .where(F.col("_labelled") >= min_stocks)
        .select("trade_date")
    )
    samples = _samples(panel, features, length, labelled())
    return samples.join(enough, "trade_date", "left_semi")


def by_date(
    samples: DataFrame,
    extent: Extent,
    start=None,
    end=None,
    min_stocks: int = 10,
) -> DataFrame:
    """Keep end dates in range that have enough samples; add the relevance."""
    if start is not None:
        samples = samples.where(F.col("trade_date") >= F.lit(start).cast("date"))
    if end is not None:
        samples = samples.where(F.col("trade_date") <= F.lit(end).cast("date"))
    sizes = samples.groupBy("trade_date").agg(F.count("*").alias("n_stocks"))
    kept = attach(samples, sizes, ["trade_date"], extent.dates, "inner").where(
        F.col("n_stocks") >= min_stocks
    )
    return relevance(kept, extent)


def inference_sequences(panel: DataFrame, features: Sequence[str], length: int, day, check: bool = True) -> DataFrame:
    """Sequences of the day's candidates, label or not.

    Only the rows of the day's candidates up to the day are windowed.
    """
    day = F.lit(day).cast("date")
    today = panel.where((F.col("trade_date") == day) & candidate(panel)).select("code")
    if check and not panel.where(F.col("trade_date") == day).limit(1).count():
        raise DataContractError("the prediction date is not in the data")
    history = panel.where(F.col("trade_date") <= day).join(today, "code", "left_semi")
    newest = Window.partitionBy("code").orderBy(F.desc("trade_date"))
    tail = history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= length)
    return (
        sliding_windows(tail, features, length)
        .where((F.col("trade_date") == day) & F.col("seq").isNotNull())
        .select("trade_date", "code", "seq")
    )


def predict_universe(
    panel: DataFrame,
    labels: DataFrame,
    features: Sequence[str],
    length: int,
    start,
    end,
    extent: Extent,
    min_stocks: int = 10,
    check: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Fix the scored universe first, join labels after it.

    A wholly unlabelled day is left out; a partly labelled one and a day with
    too few names are refused. Returns the samples and the per-day audit.
    """
    ranged = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    universe = sliding_windows(panel.drop("label"), features, length).where(
        ranged & candidate(panel)
    )
    known = labels.select(
        "trade_date", "code", F.when(labelled(), F.col("label")).alias("label")
    )
    joined = universe.join(known, ["trade_date", "code"], "left").select(
        "trade_date", "code", "seq", "label"
    )
    scored = F.col("seq").isNotNull()
    counts = joined.groupBy("trade_date").agg(
        F.count("*").alias("eligible_before_sequence"),
        F.count_if(scored).alias("scored_stocks"),
        F.count_if(scored & F.col("label").isNotNull()).alias("labelled_scored_stocks"),
    )
    usable = counts.where(F.col("labelled_scored_stocks") > 0)
    if check:
        require_none(
            usable,
            F.col("labelled_scored_stocks") < F.col("scored_stocks"),
            "scored names without a label",
        )
        require_none(usable, F.col("scored_stocks") < min_stocks, "too few scored names")
    samples = attach(
        joined.where(scored), usable.select("trade_date"), ["trade_date"], extent.dates, "inner"
    )
    return relevance(samples, extent), usable


def pad_and_mask(
    samples: DataFrame, length: int, width: int, extent: Extent, batch_days: int = 4
) -> DataFrame:
    """Rectangular batches in long form: every date of a batch has as many
    slots as its fullest date, empty slots hold zeros and mask 0.

    A slot is a row, so no date is ever gathered into one value. A sequence has
    ``length`` steps of ``width`` features.
    """
    placed = row_positions(samples, ["trade_date"], [F.col("code")], extent, "slot")
    sizes = placed.groupBy("trade_date").agg(F.count("*").alias("n"))
    # Date-level tables are as short as the calendar.
    batched = sizes.withColumn(
        "batch", F.floor((F.row_number().over(Window.orderBy("trade_date")) - 1) / batch_days)
    )
    target = batched.withColumn("slots", F.max("n").over(Window.partitionBy("batch")))
    real = attach(placed, target.select("trade_date", "batch"), ["trade_date"], extent.dates).select(
        "batch", "trade_date", "slot", "code", "seq",
        F.col("label").alias("target"), "relevance", F.lit(1).alias("mask"),
    )
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), width), length)
    missing = target.where(F.col("slots") > F.col("n"))
    # Empty slots are generated in chunks, so a wide batch is spread over tasks.
    chunks = missing.select(
        "batch", "trade_date", "n", "slots",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - F.col("n") - 1) / PAD_CHUNK).cast("int"))).alias("c"),
    )
    low = F.col("n") + F.col("c") * PAD_CHUNK + 1
    empty = chunks.select(
        "batch",
        "trade_date",
        F.explode(F.sequence(low, F.least(low + PAD_CHUNK - 1, F.col("slots")))).alias("slot"),
    ).select(
        "batch", "trade_date", F.col("slot").cast("int").alias("slot"), F.lit(None).cast("string").alias("code"), blank.alias("seq"),
        F.lit(0.0).alias("target"), F.lit(0.0).alias("relevance"), F.lit(0).alias("mask"),
    )
    return real.unionByName(empty)
