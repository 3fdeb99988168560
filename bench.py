"""Time the headline queries; prints one JSON line.

Stages are written tables every later query reads, timed once. Queries run
twice into a no-op sink: ``cold`` is the first run, ``queries`` the second.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidepanel.catalog import ENTRIES
from tidepanel.catalog.base import tables
from tidepanel.plans.staging import release

STAGES = ("plain_bars", "calendar", "snapshots", "events", "members", "panel", "market", "features", "ranked", "scores")
HEADLINE = (
    "weekly_bars",
    "dense_calendar_panel",
    "model_panel",
    "daily_membership",
    "membership_intervals",
    "all_24_features",
    "market_state",
    "pit_ranks",
    "pit_ranks_split",
    "blend_rerank",
    "sliding_sequences",
    "padded_batches",
    "standardized_features",
    "regime_labels",
    "gate_two_of_four",
    "defensive_blend",
    "daily_evaluation",
    "listwise_loss",
    "pairwise_losses",
    "quality_report",
    "upsert_keep_last",
    "notice_table_events",
    "selection_from_sales",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidepanel-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidepanel-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    t = tables(spark, folder)
    stages, cold, warm = {}, {}, {}
    for name in STAGES:
        start = time.perf_counter()
        getattr(t, name)
        stages[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        for into in (cold, warm):
            start = time.perf_counter()
            ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            into[name] = round(time.perf_counter() - start, 3)
    queries = {**stages, **warm}
    release(spark)
    print(
        json.dumps(
            {
                "metric": "panel_total_seconds",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
