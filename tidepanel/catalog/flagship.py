"""End to end on one folder: bars, dense panel, features, ranks, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.catalog.base import tables
from tidepanel.catalog.oracle import avg_rank, cte, sql
from tidepanel.catalog.registry import ENTRIES, Entry, shaped
from tidepanel.operators import crosssection as xs
from tidepanel.operators import evaluation as ev
from tidepanel.operators import features as ft
from tidepanel.operators import panel as pn
from tidepanel.operators.market import mean_of

INPUTS = ("STD5", "ROC5", "RANK5")
COLS = "trade_date n_names"
RESULT = "universe_return top5_return top5_excess_return"


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Daily top-5 of an average of three ranked features, and its excess return."""
    t = tables(spark, folder)
    dense = pn.densify(
        pn.causal_adjust(t.market_bars).withColumn("code", F.col("ts_code")), t.calendar
    ).withColumns({"volume": F.col("vol"), "turnover": F.col("turnover_rate"), "amplitude": F.lit(0.0)})
    featured = ft.baseline24(pn.contest_label(dense)).where(F.col("label").isNotNull())
    ranked = xs.average_rank(featured, INPUTS, t.extent)
    scores = ranked.select(
        "trade_date",
        "code",
        F.round(mean_of([F.col(c) for c in INPUTS]), 9).alias("score"),
        F.round("label", 9).alias("label"),
    )
    returns = ev.top_k_returns(scores, (5,))
    return shaped(returns, COLS, RESULT)


cte(
    "simple_scores",
    "features",
    "SELECT trade_date, code, round(("
    + " + ".join(
        f"""{avg_rank(f'"{c}"')} / count(*) OVER (PARTITION BY trade_date)""" for c in INPUTS
    )
    + ") / 3.0, 9) AS score, round(contest_label, 9) AS label FROM features WHERE contest_label IS NOT NULL",
)
ENTRIES["selection_from_sales"] = Entry(
    "selection_from_sales",
    "L1-L4, D2-D4, E, F2, D8, K3",
    flagship,
    sql(
        "simple_scores",
        """SELECT trade_date, count(*) AS n_names, avg(label) AS universe_return,
  avg(label) FILTER (WHERE k <= 5) AS top5_return, avg(label) FILTER (WHERE k <= 5) - avg(label) AS top5_excess_return
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS k FROM simple_scores) GROUP BY 1""",
        RESULT,
        COLS,
    ),
)
