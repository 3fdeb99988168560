"""Rolling features, market state and interactions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidepanel.catalog import oracle as o
from tidepanel.catalog.base import TRAIN_END, Tables
from tidepanel.catalog.registry import checked
from tidepanel.operators import features as ft
from tidepanel.operators import market as mk
from tidepanel.operators import scaling
from tidepanel.operators.panel import contest_label

KEYS = "code trade_date"


def labelled_panel(t: Tables):
    return contest_label(t.panel, "contest_label")


def _feature(name: str, rows: str, columns: str) -> None:
    @checked(name, rows, "features", "SELECT * FROM features", KEYS, columns)
    def run(t: Tables):
        return ft.baseline24(t.panel)


_feature("close_deviation", "E1-E4", "STD5 STD10 STD20 STD60")
_feature("close_lag_ratio", "E5-E7", "ROC5 ROC20 ROC60")
_feature("close_window_rank", "E8-E10", "RANK5 RANK20 RANK60")
_feature("close_mean_ratio", "E11", "MA20")
_feature("close_range_place", "E12", "RSV20")
_feature("volume_mean_ratio", "E13, E14", "VMA5 VMA20")
_feature("volume_deviation", "E15", "VSTD20")
_feature("volume_weighted_moves", "E16", "WVMA20")
_feature("volume_trend", "E17, E18", "volume_ratio volume_change")
_feature("return_volatility", "E19, E20", "volatility_10 volatility_20")
_feature("average_true_range", "E21", "atr_14")
_feature("passthrough_features", "E22-E24", "amplitude amount turnover")
_feature("all_24_features", "E1-E24, B13", " ".join(ft.BASE24))


@checked(
    "restored_audit_columns",
    "D12",
    "featm",
    """SELECT code, trade_date, "ROC5", is_member, is_suspended, is_tradable, in_signal_range, contest_label FROM featm""",
    f"{KEYS} is_member is_suspended is_tradable in_signal_range",
    "ROC5 contest_label",
)
def restored_audit_columns(t: Tables):
    """Features whose label and flags were filled like features, then taken from the panel again."""
    panel = labelled_panel(t)
    spoilt = panel.withColumn("contest_label", F.coalesce("contest_label", F.lit(0.0))).withColumn("is_member", F.lit(True))
    return ft.restore_audit_columns(ft.baseline24(spoilt), panel, (*ft.AUDIT, "contest_label"))


@checked(
    "warmup_gating",
    "E25, B12",
    "feat1",
    f"""SELECT code, trade_date, ({o.roll_list('stddev_pop', 'close', 60)}) / (close + 1e-12) AS "STD60",
  ({o.roll('avg', 'close', 20)}) / (close + 1e-12) AS "MA20",
  CASE WHEN step >= 14 THEN sum(atr_term) {o.WINDOW} * pow(13.0 / 14.0, step) END AS atr_14,
  volume_change FROM feat1""",
    KEYS,
    "STD60 MA20 atr_14 volume_change",
)
def warmup_gating(t: Tables):
    return ft.baseline24(t.panel, zero_fill=False)


@checked("market_daily", "E26", "daily", "SELECT * FROM daily", "trade_date", "market_return breadth_positive")
def market_daily(t: Tables):
    return mk.market_daily(t.market_panel)


@checked("market_state", "E27", "market", "SELECT * FROM market", "trade_date", " ".join(o.MARKET4))
def market_state(t: Tables):
    return mk.market4(t.market_panel)


@checked(
    "panel_with_market_state",
    "E28",
    "panel market",
    "SELECT p.code, p.trade_date, " + ", ".join(f"coalesce(m.{c}, 0.0) AS {c}" for c in o.MARKET4)
    + " FROM panel p LEFT JOIN market m USING (trade_date)",
    KEYS,
    " ".join(o.MARKET4),
)
def panel_with_market_state(t: Tables):
    return ft.fill_market(mk.add_market4(t.market_panel, dates=t.extent.dates))


def train(t: Tables):
    return scaling.train_rows(t.ranked, date(1900, 1, 1), TRAIN_END)


@checked(
    "market_stress_fit",
    "E29",
    "stress_fit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, c_{c} AS center, s_{c} AS scale FROM stress_fit" for c in o.MARKET4
    ),
    "feature",
    "center scale",
)
def market_stress_fit(t: Tables):
    center, scale = mk.fit_market_stress(t.ranked, train(t))
    return t.spark.createDataFrame(
        [(c, center[c], scale[c]) for c in o.MARKET4], "feature string, center double, scale double"
    )


@checked(
    "market_cross_features",
    "E30",
    "ranked stress_fit",
    f"""SELECT code, trade_date, s * "ROC60" AS "stress_x_ROC60", s * calm AS stress_x_low_vol,
  s * "RANK20" AS "stress_x_RANK20", s * volume_change AS stress_x_volume_change
FROM (SELECT *, {o.mean([o.component(i) for i in range(4)])} AS s,
        {o.mean([f'(1.0 - "{c}")' for c in o.LOW_VOL])} AS calm FROM ranked, stress_fit)""",
    KEYS,
    " ".join(ft.CROSS4),
)
def market_cross_features(t: Tables):
    return mk.cross4(t.ranked, *mk.fit_market_stress(t.ranked, train(t)))


@checked(
    "market_component_features",
    "E31",
    "ranked stress_fit",
    f"""SELECT code, trade_date, {o.component(1)} * "ROC20" AS "volatility_stress_x_ROC20",
  {o.component(2)} * "STD20" AS "drawdown_stress_x_STD20" FROM ranked, stress_fit""",
    KEYS,
    " ".join(ft.COMPONENT2),
)
def market_component_features(t: Tables):
    return mk.component2(t.ranked, *mk.fit_market_stress(t.ranked, train(t)))


@checked(
    "selected_feature_set",
    "E32",
    "featm",
    "SELECT * FROM featm",
    KEYS,
    " ".join(c for c in (*ft.BASE24, *ft.MARKET4) if c != "MA20"),
)
def selected_feature_set(t: Tables):
    names = ft.select_features("baseline24_market4", exclude=("instrument", "MA20"))
    return t.features.select("code", "trade_date", *names)
