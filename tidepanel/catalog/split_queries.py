"""Splits, standardisation, regimes, sampling and the gate."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidepanel.catalog import oracle as o
from tidepanel.catalog.base import SIGNAL_END, TRAIN_END, Tables
from tidepanel.catalog.feature_queries import train
from tidepanel.catalog.registry import checked, query
from tidepanel.operators import gate as gt
from tidepanel.operators import regime as rg
from tidepanel.operators import scaling as sc
from tidepanel.operators import splits as sp
from tidepanel.plans.permutation import ROUNDS

KEYS = "code trade_date"
SEG = "segment start_date end_date n_days"
DAY = timedelta(days=1)


def signal(t: Tables):
    return t.panel.where("in_signal_range")


def seg_sql(ranges: list[tuple[str, str, str]]) -> str:
    """Segments as ordinal ranges [low, high) in SQL."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS segment, min(trade_date) AS start_date, max(trade_date) AS end_date,"
        f" count(*) AS n_days FROM signal_days WHERE ordinal >= {a} AND ordinal < {b}"
        for n, a, b in ranges
    )


@checked(
    "date_range_split",
    "H1",
    "panel",
    f"""SELECT 'train' AS part, count(*) AS n, min(trade_date) AS a, max(trade_date) AS b FROM panel
  WHERE in_signal_range AND trade_date <= DATE '{TRAIN_END}'
UNION ALL SELECT 'test', count(*), min(trade_date), max(trade_date) FROM panel
  WHERE in_signal_range AND trade_date > DATE '{TRAIN_END}'""",
    "part n a b",
)
def date_range_split(t: Tables):
    parts = sp.date_range_split(t.panel, (date(1990, 1, 1), TRAIN_END), (TRAIN_END + DAY, SIGNAL_END))
    out = [
        p.agg(
            F.lit(name).alias("part"),
            F.count("*").alias("n"),
            F.min("trade_date").alias("a"),
            F.max("trade_date").alias("b"),
        )
        for name, p in zip(("train", "test"), parts)
    ]
    return out[0].unionByName(out[1])


@checked(
    "last_two_months_split",
    "H2",
    "panel",
    """SELECT part, count(*) AS n, min(trade_date) AS a, max(trade_date) AS b FROM (
SELECT 'train' AS part, trade_date FROM panel, (SELECT max(trade_date) - INTERVAL 2 MONTH AS v FROM panel) WHERE trade_date < v
UNION ALL
SELECT 'validation', trade_date FROM panel, (SELECT max(trade_date) - INTERVAL 2 MONTH AS v FROM panel)
 WHERE trade_date >= (SELECT min(d) FROM (SELECT CAST(v - to_days(CAST(i AS INTEGER)) AS DATE) AS d,
     row_number() OVER (ORDER BY i) AS k FROM range(1, 40) t(i)
     WHERE isodow(v - to_days(CAST(i AS INTEGER))) <= 5) WHERE k <= 9)) GROUP BY 1""",
    "part n a b",
)
def last_two_months_split(t: Tables):
    tr, va, _ = sp.last_two_months_split(t.panel, 10)
    tag = lambda df, n: df.select(F.lit(n).alias("part"), "trade_date")
    return (
        tag(tr, "train").unionByName(tag(va, "validation")).groupBy("part").agg(
            F.count("*").alias("n"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b")
        )
    )


@checked(
    "purged_split",
    "H3",
    "signal_days",
    seg_sql([("train", "0", "150"), ("gap1", "150", "155"), ("validation", "155", "185"),
             ("gap2", "185", "192"), ("test", "192", "232")]),
    SEG,
)
def purged_split(t: Tables):
    return sp.purged_split(signal(t), 150, 30, 40, gap_days=5, gap2_days=7)


@checked(
    "recent_years",
    "H4",
    "panel",
    "SELECT code, trade_date FROM panel WHERE trade_date >= (SELECT max(trade_date) - INTERVAL 3 YEAR FROM panel)",
    KEYS,
)
def recent_years(t: Tables):
    return sp.recent_years(t.panel, 3)


@checked(
    "ratio_split",
    "H5",
    "signal_days",
    "WITH u AS (SELECT count(*) - 10 AS n FROM signal_days), r AS (SELECT CAST(round_even(n * 0.7, 0) AS BIGINT) AS tr,"
    " CAST(round_even(n * 0.15, 0) AS BIGINT) AS va, n FROM u)\n"
    "SELECT tr AS train_days, va AS val_days, n - tr - va AS test_days FROM r",
    "train_days val_days test_days",
)
def ratio_split(t: Tables):
    n = signal(t).select("trade_date").distinct().count()
    return t.spark.createDataFrame(
        [sp.ratio_day_counts(n)], "train_days long, val_days long, test_days long"
    )


_N = "(SELECT count(*) FROM signal_days)"


@checked(
    "single_signal_split",
    "H6",
    "signal_days",
    seg_sql([("train", f"{_N} - 130", f"{_N} - 10"), ("embargo_context", f"{_N} - 10", f"{_N} - 5"),
             ("test", f"{_N} - 5", _N), ("signal", f"{_N} - 6", f"{_N} - 5")]),
    SEG,
)
def single_signal_split(t: Tables):
    return sp.single_signal_split(signal(t), train_days=120)


@checked(
    "narrowed_window",
    "H7",
    "panel",
    f"SELECT code, trade_date FROM panel WHERE in_signal_range AND trade_date BETWEEN DATE '1998-01-01' AND DATE '{TRAIN_END}'",
    KEYS,
)
def narrowed_window(t: Tables):
    return sp.narrow_window(t.panel, date(1998, 1, 1), TRAIN_END)


SCALED = ("STD20", "ROC60", "turnover", "market_return_20")
_rows = f"is_tradable AND in_signal_range AND trade_date <= DATE '{TRAIN_END}'"
o.cte(
    "scaler",
    "featm",
    "SELECT " + ", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in SCALED)
    + f" FROM featm WHERE {_rows}",
)


@checked(
    "standardizer",
    "H8",
    "scaler",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, \"m_{c}\" AS mean, \"s_{c}\" AS scale FROM scaler" for c in SCALED),
    "feature",
    "mean scale",
)
def standardizer(t: Tables):
    return sc.fit_standardizer(t.featured(*SCALED), SCALED, train(t))


@checked(
    "standardized_features",
    "H9",
    "featm scaler",
    "SELECT code, trade_date, "
    + ", ".join(f'("{c}" - "m_{c}") / "s_{c}" AS "{c}"' for c in SCALED)
    + " FROM featm, scaler",
    KEYS,
    " ".join(SCALED),
)
def standardized_features(t: Tables):
    fitted = sc.parameters(standardizer(t), SCALED)
    return sc.apply_standardizer(t.featured(*SCALED), fitted)


@checked(
    "refit_rows",
    "H10",
    "panel signal_days",
    """SELECT p.code, p.trade_date, CASE WHEN s.ordinal >= 150 AND s.ordinal < 155 THEN NULL ELSE p.label END AS label,
  coalesce(s.ordinal < 150 OR (s.ordinal >= 155 AND s.ordinal < 185), false) AS is_refit_row
FROM panel p LEFT JOIN signal_days s USING (trade_date)""",
    f"{KEYS} is_refit_row",
    "label",
)
def refit_rows(t: Tables):
    return sp.refit_rows(t.panel, purged_split(t))


o.cte(
    "state",
    "panel",
    f"""SELECT trade_date, market_return, breadth_positive, stocks_observed,
  {o.day_roll('product', 'g', 20)} - 1 AS market_return_20,
  {o.day_roll('stddev_pop', 'market_return', 20)} AS market_volatility_20,
  wealth / ({o.day_roll('max', 'wealth', 60)}) - 1 AS market_drawdown_60,
  {o.day_roll('avg', 'breadth_positive', 20)} AS breadth_20
FROM (SELECT *, 1 + market_return AS g, product(1 + coalesce(market_return, 0)) OVER (ORDER BY trade_date) AS wealth
  FROM (SELECT trade_date, avg(200.0 * (pct_chg / 100.0) / (2.0 + pct_chg / 100.0) / 100.0) AS market_return, count(pct_chg) AS stocks_observed,
    avg(CASE WHEN pct_chg > 0 THEN 1.0 ELSE 0.0 END) AS breadth_positive
    FROM panel WHERE is_member GROUP BY 1))""",
)
IND = rg.INDICATORS
o.cte(
    "limits",
    "state",
    "SELECT "
    + ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for c in IND for q, n in ((0.3, "q30"), (0.7, "q70")))
    + f" FROM state WHERE trade_date <= DATE '{TRAIN_END}' AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in IND),
)
# Fixed values, written out here so that the SQL doesn't take them from the operator.
TESTS = {
    "weak_low_return": ("market_return_20", "q30", "<="),
    "weak_high_volatility": ("market_volatility_20", "q70", ">="),
    "weak_deep_drawdown": ("market_drawdown_60", "q30", "<="),
    "weak_low_breadth": ("breadth_20", "q30", "<="),
    "strong_high_return": ("market_return_20", "q70", ">="),
    "strong_low_volatility": ("market_volatility_20", "q30", "<="),
    "strong_shallow_drawdown": ("market_drawdown_60", "q70", ">="),
    "strong_high_breadth": ("breadth_20", "q70", ">="),
}
_tests = {n: f"coalesce({c} {s} {c}_{q}, false)" for n, (c, q, s) in TESTS.items()}
_score = lambda kind: " + ".join(f"CAST({n} AS INTEGER)" for n in TESTS if n.startswith(kind))
o.cte(
    "labelled_state",
    "state limits",
    f"""SELECT *, CASE WHEN weak_score >= 3 THEN 'weak' WHEN strong_score >= 3 THEN 'strong' ELSE 'normal' END AS market_state
FROM (SELECT *, {_score('weak')} AS weak_score, {_score('strong')} AS strong_score
FROM (SELECT trade_date, {', '.join(f'{e} AS {n}' for n, e in _tests.items())} FROM state, limits))""",
)


def state(t: Tables):
    return rg.state_table(t.market_panel.where("is_member"))


def train_dates(t: Tables):
    return state(t).where(F.col("trade_date") <= F.lit(TRAIN_END)).select("trade_date")


@checked(
    "regime_state_table",
    "I1",
    "state",
    "SELECT * FROM state",
    "trade_date stocks_observed",
    "market_return breadth_positive market_return_20 market_volatility_20 market_drawdown_60 breadth_20",
)
def regime_state_table(t: Tables):
    return state(t)


@checked(
    "regime_thresholds",
    "I2",
    "limits",
    " UNION ALL ".join(f"SELECT '{c}' AS indicator, {c}_q30 AS q30, {c}_q70 AS q70 FROM limits" for c in IND),
    "indicator",
    "q30 q70",
)
def regime_thresholds(t: Tables):
    limits = rg.fit_thresholds(state(t), train_dates(t))
    return t.spark.createDataFrame(
        [(c, limits[f"{c}_q30"], limits[f"{c}_q70"]) for c in IND],
        "indicator string, q30 double, q70 double",
    )


def labelled_states(t: Tables):
    return rg.label_states(state(t), rg.fit_thresholds(state(t), train_dates(t)))


@checked(
    "regime_labels",
    "I3",
    "labelled_state",
    "SELECT * FROM labelled_state",
    "trade_date market_state weak_score strong_score " + " ".join(TESTS),
)
def regime_labels(t: Tables):
    return labelled_states(t)


def _hashed(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


def _shuffled(place: str, n: str, key: str) -> str:
    """Rounds of the keyed permutation, one after the other; null where n is 0."""
    other = f"((({_hashed(key, 'i')} % {n}) - x + {n}) % {n})"
    swap = f"{_hashed(key, 'i', f'greatest(x, {other})')} % 2 = 1"
    return f"list_reduce(list_prepend({place}, range(1, {ROUNDS + 1})), lambda x, i: CASE WHEN {swap} THEN {other} ELSE x END)"


# Places of dates within their state, slots of draws, and the dates that they name.
DRAWS = f"""WITH d AS (SELECT trade_date, market_state, row_number() OVER (PARTITION BY market_state ORDER BY trade_date) - 1 AS place
  FROM labelled_state WHERE trade_date <= DATE '{TRAIN_END}'),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE market_state = 'weak') AS w, count(*) FILTER (WHERE market_state = 'normal') AS a,
  count(*) FILTER (WHERE market_state = 'strong') AS b FROM d),
x AS (SELECT *, CAST(round_even(n * 0.3, 0) AS BIGINT) AS weak FROM n),
y AS (SELECT *, CAST(round_even((n - weak) * a / (a + b), 0) AS BIGINT) AS normal FROM x),
s AS (SELECT *, {_shuffled("k", "n", "'42:draws'")} AS slot FROM (SELECT *, unnest(range(n)) AS k FROM y)),
t AS (SELECT k, CASE WHEN slot < weak THEN 'weak' WHEN slot < weak + normal THEN 'normal' ELSE 'strong' END AS market_state,
  CASE WHEN slot < weak THEN w WHEN slot < weak + normal THEN a ELSE b END AS have,
  slot - CASE WHEN slot < weak THEN 0 WHEN slot < weak + normal THEN weak ELSE weak + normal END AS j FROM s),
u AS (SELECT *, '42:' || market_state AS own FROM t),
v AS (SELECT k, market_state, CASE WHEN j < have THEN {_shuffled("j", "have", "own")} ELSE {_hashed("own", "'again'", "j")} % have END AS place FROM u)
SELECT v.k + 1 AS draw, d.trade_date, v.market_state FROM v JOIN d USING (market_state, place)"""


@checked("stratified_dates", "I4", "labelled_state", DRAWS, "draw trade_date market_state")
def stratified_dates(t: Tables):
    fit = labelled_states(t).join(train_dates(t), "trade_date", "left_semi")
    return rg.stratified_sample(fit, 0.30, seed=42)[0]


@checked(
    "stratified_draw_counts",
    "I4",
    "labelled_state",
    f"""WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE market_state = 'normal') AS a,
  count(*) FILTER (WHERE market_state = 'strong') AS b FROM labelled_state WHERE trade_date <= DATE '{TRAIN_END}'),
w AS (SELECT *, CAST(round_even(n * 0.3, 0) AS BIGINT) AS weak FROM n),
x AS (SELECT *, CAST(round_even((n - weak) * a / (a + b), 0) AS BIGINT) AS normal FROM w)
SELECT n AS sample_count, weak AS weak_draws, normal AS normal_draws, n - weak - normal AS strong_draws FROM x""",
    "sample_count weak_draws normal_draws strong_draws",
)
def stratified_draw_counts(t: Tables):
    fit = labelled_states(t).join(train_dates(t), "trade_date", "left_semi")
    return rg.stratified_sample(fit, 0.30, seed=42)[1]


@checked(
    "regime_counts",
    "I5",
    "labelled_state",
    f"SELECT market_state, count(*) AS n_dates FROM labelled_state WHERE trade_date <= DATE '{TRAIN_END}' GROUP BY 1",
    "market_state n_dates",
)
def regime_counts(t: Tables):
    return rg.state_counts(labelled_states(t), train_dates(t))[0]


@checked(
    "threshold_fit_dates",
    "I5",
    "labelled_state",
    f"SELECT trade_date, trade_date <= DATE '{TRAIN_END}' AS is_threshold_fit_train_date FROM labelled_state",
    "trade_date is_threshold_fit_train_date",
)
def threshold_fit_dates(t: Tables):
    return rg.state_counts(labelled_states(t), train_dates(t))[1]


def rule(t: Tables) -> gt.GateRule:
    return gt.fit_gate_rule(t.ranked, train(t))


@checked(
    "gate_rule",
    "J1",
    "stress_fit gate_fit",
    "SELECT 'mean_pressure' AS part, NULL::DOUBLE AS center, NULL::DOUBLE AS scale, stress_lo AS low, stress_hi AS high FROM gate_fit"
    + "".join(
        f" UNION ALL SELECT '{c}', c_{c}, s_{c}, stress_{i}_lo, stress_{i}_hi FROM gate_fit, stress_fit"
        for i, c in enumerate(o.MARKET4)
    ),
    "part",
    "center scale low high",
)
def gate_rule(t: Tables):
    return gt.rule_table(t.spark, rule(t))


_p = lambda i: (
    f"CASE WHEN stress_{i}_hi = stress_{i}_lo THEN CAST(stress_{i} >= stress_{i}_lo AS DOUBLE)"
    f" ELSE least(greatest((stress_{i} - stress_{i}_lo) / (stress_{i}_hi - stress_{i}_lo), 0), 1) END"
)
_smooth = "k * k * (3 - 2 * k)"
o.cte(
    "gate24",
    "stressed gate_fit",
    f"""SELECT trade_date, abnormal_components,
  least(greatest((CASE WHEN abnormal_components >= 2 THEN 0.3 + 0.2 * {_smooth} ELSE 0.0 END) * 1.1, 0), 0.6) AS gate
FROM (SELECT trade_date, {' + '.join(f'CAST(stress_{i} >= stress_{i}_lo AS INTEGER)' for i in range(4))} AS abnormal_components,
  list_sort([{', '.join(_p(i) for i in range(4))}], 'DESC')[2] AS k
  FROM stressed, gate_fit)""",
)


@checked("gate_two_of_four", "J2, B14", "gate24", "SELECT * FROM gate24", "trade_date abnormal_components", "gate")
def gate_two_of_four(t: Tables):
    return gt.gate_two_of_four(t.market_filled, gt.load_rule(gate_rule_table(t)))


def gate_rule_table(t: Tables):
    return gt.rule_table(t.spark, rule(t))


@checked(
    "gate_aggregate",
    "J3",
    "stressed gate_fit",
    f"""SELECT trade_date, 0.5 * {_smooth} AS gate FROM (SELECT trade_date,
  least(greatest((stress - stress_lo) / (stress_hi - stress_lo), 0), 1) AS k FROM stressed, gate_fit)""",
    "trade_date",
    "gate",
)
def gate_aggregate(t: Tables):
    return gt.gate_aggregate(t.market_filled, rule(t))


@checked(
    "gate_logistic",
    "J4",
    "stressed",
    """SELECT trade_date, 1.0 / (1.0 + exp(-(-1.5 + 1.25 * (0.75 * stress + 0.25 *
  avg(stress) OVER (ORDER BY trade_date ROWS 59 PRECEDING))))) AS gate FROM stressed""",
    "trade_date",
    "gate",
)
def gate_logistic(t: Tables):
    return gt.gate_logistic(t.market_filled, rule(t), 60)


@checked(
    "gate_override",
    "J5",
    "market",
    "SELECT trade_date, 0.25 AS gate FROM market",
    "trade_date",
    "gate",
)
def gate_override(t: Tables):
    return gt.gate_override(t.market_filled, 0.25)


@checked(
    "defensive_blend",
    "J6",
    "ranked scores gate24",
    f"""SELECT trade_date, code, d2 AS defensive_score, (1 - g) * score + g * d2 AS gated_score FROM (
SELECT *, (d - avg(d) OVER w) / sqrt(greatest(var_pop(d) OVER w, 1e-8)) * sqrt(greatest(var_pop(score) OVER w, 1e-8))
  + avg(score) OVER w AS d2 FROM (
SELECT s.trade_date, s.code, s.score, g.gate AS g, 0.5 * -({o.mean([f'"{c}"' for c in o.LOW_VOL])}) + 0.5 * "ROC60" AS d
FROM scores s JOIN ranked r USING (code, trade_date) JOIN gate24 g USING (trade_date))
WINDOW w AS (PARTITION BY trade_date))""",
    KEYS,
    "defensive_score gated_score",
)
def defensive_blend(t: Tables):
    gates = gt.gate_two_of_four(t.market_filled, rule(t))
    scored = t.scores.join(t.ranked_factors, ["code", "trade_date"])
    return gt.defensive_blend(scored, gates, t.extent).where(F.col("gate").isNotNull())
