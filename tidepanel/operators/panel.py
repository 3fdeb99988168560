"""Adjusted, dense, labelled panel on the trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.codes import normalize_ts_code, zfill
from tidepanel.functions.numeric import EPS, round_half_even_scaled, to_numeric
from tidepanel.operators.calendar import calendar_bounds, snap_positions
from tidepanel.plans.extent import Extent, attach
from tidepanel.plans.ordering import row_positions
from tidepanel.schemas import PANEL_SCHEMA, PRICES, require_columns, require_none


def by_code():
    return Window.partitionBy("code").orderBy("trade_date")


def causal_adjust(bars: DataFrame, key: str = "ts_code", check: bool = True) -> DataFrame:
    """Scale prices by the factor relative to the first one of the code.

    Only past rows are read, so later rows never change an adjusted price.
    """
    require_columns(bars, [key, "trade_date", *PRICES, "adj_factor"], "price adjustment")
    numbers = bars.withColumns({c: to_numeric(F.col(c)) for c in (*PRICES, "adj_factor")})
    if check:
        # One pass finds a value that cannot be parsed and a factor that is not positive.
        broken = F.col("adj_factor") <= 0
        for c in (*PRICES, "adj_factor"):
            broken = broken | F.col(c).isNull()
        require_none(numbers, broken, "unparsable price or non-positive adj_factor")
    base = F.first("adj_factor").over(
        Window.partitionBy(key)
        .orderBy("trade_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return numbers.withColumn("_scale", F.col("adj_factor") / base).withColumns(
        {c: F.col(c) * F.col("_scale") for c in PRICES}
    ).drop("_scale")


def densify(adjusted: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per trading day from a code's first bar to the calendar's end.

    Each bar is expanded over the days until the code's next bar, so filling
    forward needs no join and no second pass: the added days take the bar's
    close as all four prices, its factor, and zero trading. A code whose bars all
    lie off the calendar is listed from its first bar on, suspended and without
    prices.
    """
    edge = calendar_bounds(calendar)
    last_pos = edge["last_pos"]
    # Window order must be the date: a bar off the calendar snaps onto a later day.
    on_calendar = attach(
        snap_positions(adjusted, "trade_date", calendar, "_snapped", edge),
        calendar,
        ["trade_date"],
        last_pos + 1,
    )
    listed = on_calendar.withColumn(
        "_listed",
        F.first("_snapped").over(
            by_code().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    never = F.max("pos").over(Window.partitionBy("code")).isNull()
    listed = (
        listed.withColumn("_never", never & (F.row_number().over(by_code()) == 1))
        .where(F.col("pos").isNotNull() | F.col("_never"))
        .drop("_never")
    )
    following = F.coalesce(F.lead("pos").over(by_code()) - 1, F.lit(last_pos))
    first_bar = F.lag("pos").over(by_code()).isNull()
    spread = listed.withColumn(
        "_days",
        F.sequence(
            F.when(first_bar, F.least("_listed", "pos")).otherwise(F.col("pos")), following
        ),
    ).withColumn("_day", F.explode("_days"))
    traded = F.coalesce(F.col("_day") == F.col("pos"), F.lit(False))
    unlisted = F.coalesce(F.col("_day") < F.col("pos"), F.lit(True))
    filled = {
        c: F.when(traded, F.col(c)).when(~unlisted, F.col("close")) for c in PRICES
    }
    filled |= {
        c: F.when(traded, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0))
        for c in ("vol", "amount", "turnover_rate")
    }
    filled["adj_factor"] = F.when(~unlisted, F.col("adj_factor"))
    filled["is_suspended"] = ~traded
    dense = spread.withColumns(filled).drop("_snapped", "_listed", "_days", "pos", "trade_date")
    return attach(dense.withColumnRenamed("_day", "pos"), calendar, ["pos"], last_pos + 1)


def mark_members(panel: DataFrame, members: DataFrame) -> DataFrame:
    """Flags from the daily membership relation; tradable = member, not suspended.

    A code's member days, as many as the calendar has at most, are one row. So the join
    goes by the code alone, as the windows around it, and the panel is not shuffled for it.
    """
    days = (
        members.select(
            zfill(F.col("code").cast("string")).alias("code"),
            F.col("trade_date").cast("date").alias("_day"),
        )
        .groupBy("code")
        .agg(F.collect_set("_day").alias("_member_days"))
    )
    others = [c for c in panel.columns if c not in ("code", "trade_date")]
    is_member = F.coalesce(F.array_contains("_member_days", F.col("trade_date")), F.lit(False))
    return (
        panel.join(days, "code", "left")
        .select("code", "trade_date", *others, is_member.alias("is_member"))
        .withColumn("is_tradable", F.col("is_member") & ~F.col("is_suspended"))
    )


def derive(panel: DataFrame) -> DataFrame:
    """Volume in units, amount in currency, and moves against the prior close."""
    prior = F.lag("close").over(by_code())
    moved = panel.withColumn("_prior", prior)
    return (
        moved.withColumns(
            {
                "volume": F.col("vol") * 100.0,
                "amount": F.col("amount") * 1000.0,
                "turnover": F.col("turnover_rate"),
                "amplitude": round_half_even_scaled(
                    F.try_divide(F.col("high") - F.col("low"), F.col("_prior")) * 100.0, 2
                ),
                "change_amt": round_half_even_scaled(F.col("close") - F.col("_prior"), 6),
                "pct_chg": round_half_even_scaled(
                    (F.try_divide(F.col("close"), F.col("_prior")) - 1.0) * 100.0, 6
                ),
            }
        )
        .drop("_prior", "vol", "turnover_rate")
    )


def pit_label(panel: DataFrame, entry: int = 1, exit_: int = 5) -> DataFrame:
    """Return from the open of the next day to the close five days on.

    Rows are dense, so counting rows is counting calendar positions. An entry
    that cannot trade earns 0.0 and is flagged; no exit day leaves NULL.
    """
    entry_open = F.lead("open", entry).over(by_code())
    entry_halted = F.lead("is_suspended", entry).over(by_code())
    exit_close = F.lead("close", exit_).over(by_code())
    in_reach = F.lead("pos", exit_).over(by_code()).isNotNull()
    failed = F.coalesce(entry_halted, F.lit(False)) | entry_open.isNull() | (entry_open <= 0)
    return panel.withColumns(
        {
            "label": F.when(
                in_reach,
                F.when(failed, F.lit(0.0)).otherwise((exit_close - entry_open) / entry_open),
            ),
            "label_entry_failed": in_reach & failed,
        }
    )


def contest_label(panel: DataFrame, out: str = "label") -> DataFrame:
    """Return from the open of a code's next record to that of its fifth."""
    entry_open = F.lead("open", 1).over(by_code())
    exit_open = F.lead("open", 5).over(by_code())
    return panel.withColumn(
        out, F.when(entry_open > 0, (exit_open - entry_open) / entry_open)
    )


def legacy_label(panel: DataFrame, drop_small_open: bool = True) -> DataFrame:
    """As above with a shifted denominator; an existing label is kept."""
    if "label" in panel.columns:
        return panel.withColumn("label", to_numeric(F.col("label")))
    leads = panel.withColumns(
        {
            "_entry": F.lead("open", 1).over(by_code()),
            "_exit": F.lead("open", 5).over(by_code()),
        }
    )
    if drop_small_open:
        leads = leads.where(F.col("_entry") > 1e-4)
    return leads.withColumn(
        "label",
        F.try_divide(F.col("_exit") - F.col("_entry"), F.col("_entry") + F.lit(EPS)),
    ).drop("_entry", "_exit")


def in_signal_range(panel: DataFrame, start, end) -> DataFrame:
    inside = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return panel.withColumn("in_signal_range", inside)


def instrument_index(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Dense 0-based index of the sorted distinct codes; unmapped rows drop.

    The index of the universe is one row per code. It is numbered by ranges of
    the code, so no task sorts all codes.
    """
    codes = universe.select("code").distinct()
    return panel.join(dense_index(codes, "code", "instrument"), "code")


def dense_index(keys: DataFrame, key: str, out: str) -> DataFrame:
    rows = keys.count()
    numbered = row_positions(
        keys.withColumn("_all", F.lit(0)), ["_all"], [F.col(key)], Extent(1, rows), "_n"
    )
    return numbered.select(key, (F.col("_n") - 1).cast("long").alias(out))


def build_panel(
    bars: DataFrame,
    members: DataFrame,
    calendar: DataFrame,
    signal_start,
    signal_end,
    source: str = "pit",
    check: bool = True,
) -> DataFrame:
    """Bars and daily membership to the model panel, in one pass per code."""
    require_columns(
        bars,
        ["ts_code", "trade_date", *PRICES, "vol", "amount", "turnover_rate", "adj_factor"],
        "market bars",
    )
    # Adjusting and densifying share one shuffle by the code that both go by.
    coded = bars.withColumn("ts_code", normalize_ts_code(F.col("ts_code"))).withColumn(
        "code", F.substring_index("ts_code", ".", 1)
    )
    dense = mark_members(densify(causal_adjust(coded, "code", check), calendar), members)
    labelled = pit_label(derive(dense))
    ranged = in_signal_range(labelled, signal_start, signal_end)
    return ranged.withColumn("source", F.lit(source)).select(
        *PANEL_SCHEMA.fieldNames(), "pos"
    )
