"""The given tables as a weekly panel, staged once per session and folder.

Entity = supplier, period = week of shipping. Bars, panel, factors and scores
are each written once into the shared folder and read back by the queries that
need them, as a research job would do. Features and their ranks are plans over the
panel: a query computes the columns that it uses.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.codes import normalize_ts_code, zfill
from tidepanel.operators import calendar as cal
from tidepanel.operators import crosssection, features, market, panel, universe
from tidepanel.operators.rerank import FACTORS
from tidepanel.plans.extent import Extent, attach
from tidepanel.plans.ordering import row_positions
from tidepanel.plans.staging import stage

SIGNAL_START = date(1996, 7, 1)
SIGNAL_END = date(2001, 6, 25)
RESEARCH_START = date(1995, 7, 3)
TRAIN_END = date(1999, 6, 28)
SNAPSHOT_WEEKS = 13
#: What samples and ranks need of a row besides its features.
AUDITED = ("code", "trade_date", "is_member", "is_tradable", "in_signal_range", "contest_label")
RANKED_FACTORS = (*features.LOW_VOLATILITY, "turnover", "ROC60")


def weekly_bars(lineitem: DataFrame) -> DataFrame:
    """Sales lines to weekly bars; first and last price by a total order."""
    # Day, order and line in one long: a fixed-width buffer, so that the aggregation hashes.
    shipped = F.col("l_shipdate").cast("date")
    day = F.datediff(shipped, F.lit("1970-01-01")) + (1 << 16)
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    fits = day.between(0, (1 << 17) - 1) & key.between(0, (1 << 42) - 1) & line.between(0, 15)
    packed = (day.cast("long") * (1 << 42) + key.cast("long")) * 16 + line.cast("long")
    order = F.when(fits, packed).otherwise(F.raise_error(F.lit("a sales line doesn't fit the packed order")).cast("long"))
    price = F.col("l_extendedprice")
    grouped = lineitem.groupBy(
        "l_suppkey", F.date_sub(F.next_day(shipped, "MON"), 7).alias("trade_date")
    ).agg(
        F.min_by(price, order).alias("open"),
        F.max_by(price, order).alias("close"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.round(F.sum("l_quantity"), 4).alias("vol"),
        F.round(F.sum(price * (1 - F.col("l_discount"))), 4).alias("amount"),
    )
    # The number is the cheaper grouping key; the code is written once per bar.
    code = zfill(F.col("l_suppkey").cast("string")).alias("code")
    return grouped.select(code, *[c for c in grouped.columns if c != "l_suppkey"])


class Tables:
    """Lazily staged intermediate tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._featured: dict[tuple[str, ...], DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dealt(self, name: str) -> DataFrame:
        """A table whose rows are dear to work on: dealt over all cores where its files
        make few partitions, as a file of a few MB is one."""
        rows, parts = self.read(name), 2 * self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)

    @cached_property
    def plain_bars(self) -> DataFrame:
        return stage(weekly_bars(self.read("lineitem")), "bars")

    @cached_property
    def calendar(self) -> DataFrame:
        return stage(cal.trading_calendar(self.plain_bars.select("trade_date")), "calendar")

    @cached_property
    def market_bars(self) -> DataFrame:
        """Bars with a stepwise factor and the share of a year's volume traded."""
        year = Window.partitionBy("code").orderBy("trade_date").rowsBetween(-51, 0)
        dated = attach(self.plain_bars, self.calendar, ["trade_date"], self.calendar.count(), "inner")
        bars = dated.select(
            F.col("code").alias("ts_code"),
            "trade_date",
            "open",
            "close",
            "high",
            "low",
            "vol",
            "amount",
            (F.col("vol") / F.sum("vol").over(year)).alias("turnover_rate"),
            (F.lit(1.0) + F.lit(0.25) * F.floor(F.col("pos") / 52)).alias("adj_factor"),
        )
        return stage(bars, "market-bars")

    @cached_property
    def entities(self) -> int:
        return self.plain_bars.select("code").distinct().count()

    @cached_property
    def extent(self) -> Extent:
        return Extent(self.calendar.count(), self.entities)

    @cached_property
    def expected(self) -> int:
        return self.entities // 2

    @cached_property
    def snapshots(self) -> DataFrame:
        """Monthly: the busier half of the entities by trailing 13-week amount."""
        dense = panel.densify(
            self.plain_bars.withColumns(
                {"turnover_rate": F.lit(0.0), "adj_factor": F.lit(1.0)}
            ),
            self.calendar,
        )
        recent = (
            Window.partitionBy("code").orderBy("trade_date").rowsBetween(-(SNAPSHOT_WEEKS - 1), 0)
        )
        month_starts = (
            self.calendar.withColumn(
                "_first",
                F.row_number().over(
                    Window.partitionBy(F.trunc("trade_date", "month")).orderBy("trade_date")
                ),
            )
            .where((F.col("_first") == 1) & (F.col("pos") >= SNAPSHOT_WEEKS - 1))
            .select("trade_date")
        )
        summed = dense.withColumn("_sum", F.sum("amount").over(recent))
        starting = attach(summed, month_starts, ["trade_date"], self.extent.dates, "inner")
        ranked = row_positions(
            # Rounding is dear, so only the months' first weeks are rounded.
            starting.withColumn("trailing", F.round("_sum", 4)),
            ["trade_date"],
            [F.desc("trailing"), F.col("code")],
            self.extent,
            "place",
        ).where(F.col("place") <= self.expected)
        return stage(
            ranked.select(
                "trade_date",
                normalize_ts_code(F.col("code")).alias("con_code"),
                F.col("trailing").alias("weight"),
            ),
            "snapshots",
        )

    @cached_property
    def events(self) -> DataFrame:
        return stage(universe.diff_events(self.snapshots), "events")

    @cached_property
    def membership(self) -> universe.Membership:
        return universe.build_membership(
            self.snapshots,
            self.events,
            self.calendar,
            RESEARCH_START,
            SIGNAL_END,
            self.expected,
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.membership.daily

    @cached_property
    def panel(self) -> DataFrame:
        built = panel.build_panel(
            self.market_bars, self.members, self.calendar, SIGNAL_START, SIGNAL_END
        )
        return stage(built, "panel")

    @cached_property
    def market_panel(self) -> DataFrame:
        """The panel with moves against the mean of both closes.

        The given prices are independent draws, whose plain moves drift upwards
        so strongly that the market never falls; these moves have no drift.
        """
        move = F.col("pct_chg") / 100.0
        return self.panel.withColumn("pct_chg", 200.0 * move / (2.0 + move))

    @cached_property
    def market(self) -> DataFrame:
        return stage(market.market4(self.market_panel), "market")

    @cached_property
    def features(self) -> DataFrame:
        """Panel with market state and the 24 features, each computed where it is used."""
        fed = features.baseline24(panel.contest_label(self.panel, "contest_label"))
        return features.fill_market(market.add_market4(fed, self.market, self.extent.dates))

    def featured(self, *names: str) -> DataFrame:
        """Some of the features, with keys, flags and label, staged for several passes."""
        if names not in self._featured:
            self._featured[names] = stage(self.features.select(*AUDITED, *names), "features")
        return self._featured[names]

    @property
    def market_filled(self) -> DataFrame:
        """The market state as the features carry it: 0 in its warm-up."""
        return features.fill_market(self.market)

    @cached_property
    def ranked(self) -> DataFrame:
        """The 24 features as point-in-time ranks, each computed where it is used."""
        return crosssection.pit_rank(self.features, features.BASE24, self.extent)

    @cached_property
    def factors(self) -> DataFrame:
        """The factors of scores and re-ranking, of the rows that can be scored."""
        rows = self.features.where(F.col("is_member") & F.col("is_tradable") & F.col("in_signal_range"))
        return stage(rows.select("code", "trade_date", "contest_label", *FACTORS), "factors")

    @cached_property
    def ranked_factors(self) -> DataFrame:
        """Point-in-time ranks of the factors that scores and their audits use.

        Only candidates count in these ranks, so ranking candidates alone gives theirs."""
        rows = self.factors.select("code", "trade_date", "contest_label", *RANKED_FACTORS)
        return stage(crosssection.pit_rank(rows, RANKED_FACTORS, self.extent), "ranked")

    @cached_property
    def scores(self) -> DataFrame:
        """A deterministic linear score, standing in for an external ranker."""
        low = market.mean_of([F.col(c) for c in features.LOW_VOLATILITY])
        rows = self.ranked_factors.where(F.col("contest_label").isNotNull())
        return stage(
            rows.select(
                "trade_date",
                "code",
                F.round(0.5 * F.col("ROC60") - low, 9).alias("score"),
                F.round("contest_label", 9).alias("label"),
            ),
            "scores",
        )


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, folder)
    return _OPEN[key]
