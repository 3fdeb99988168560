"""Evaluation, audit losses and scoring."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.catalog import oracle as o
from tidepanel.catalog.base import Tables
from tidepanel.catalog.rank_queries import split_extent
from tidepanel.catalog.registry import checked
from tidepanel.operators import crosssection as xs
from tidepanel.operators import evaluation as ev
from tidepanel.operators import losses as ls
from tidepanel.operators import scoring as so
from tidepanel.operators import splits as sp
from tidepanel.plans.extent import attach

KEYS = "code trade_date"
MIN = 10

o.cte(
    "ic",
    "scores",
    f"""SELECT trade_date, CASE WHEN stddev_pop(rs) = 0 OR stddev_pop(rl) = 0 THEN 0.0
  ELSE covar_pop(rs, rl) / (stddev_pop(rs) * stddev_pop(rl)) END AS rank_ic
FROM (SELECT trade_date, {o.avg_rank('score')} AS rs, {o.avg_rank('label')} AS rl FROM scores)
GROUP BY 1 HAVING count(*) >= {MIN}""",
)
o.cte(
    "placed",
    "scores",
    """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS place,
  row_number() OVER (PARTITION BY trade_date ORDER BY label DESC, code) AS best,
  row_number() OVER (PARTITION BY trade_date ORDER BY label, code) - 1 AS below,
  count(*) OVER (PARTITION BY trade_date) AS n FROM scores""",
)
_top = lambda k: f"avg(label) FILTER (WHERE place <= {k})"
o.cte(
    "returns",
    "placed",
    "SELECT trade_date, count(*) AS n_names, avg(label) AS universe_return, "
    + ", ".join(f"{_top(k)} AS top{k}_return, {_top(k)} - avg(label) AS top{k}_excess_return" for k in (5, 10, 20))
    + " FROM placed GROUP BY 1",
)
o.cte(
    "quality",
    "placed",
    """SELECT trade_date, sum(g / log2(place + 1)) / greatest(sum((n - place) * 1.0 / s / log2(place + 1)), 1e-12) AS ndcg_at_5,
  avg(g) AS top5_true_percentile
FROM (SELECT *, greatest(n - 1, 1) AS s, below * 1.0 / greatest(n - 1, 1) AS g FROM placed WHERE place <= 5) GROUP BY 1""",
)
o.cte(
    "evaluated",
    "returns ic quality",
    f"SELECT * FROM returns JOIN ic USING (trade_date) JOIN quality USING (trade_date) WHERE n_names >= {MIN}",
)
RETURNS = "universe_return " + " ".join(f"top{k}_return top{k}_excess_return" for k in (5, 10, 20))


@checked("daily_rank_ic", "K1", "ic", "SELECT * FROM ic", "trade_date", "rank_ic")
def daily_rank_ic(t: Tables):
    return ev.daily_rank_ic(t.scores, t.extent)


@checked("daily_rank_ic_split", "K1", "ic", "SELECT * FROM ic", "trade_date", "rank_ic")
def daily_rank_ic_split(t: Tables):
    return ev.daily_rank_ic(t.scores, split_extent(t))


@checked(
    "ic_summary",
    "K2",
    "ic",
    """SELECT count(*) AS n_dates, avg(rank_ic) AS mean_ic, stddev_pop(rank_ic) AS std_ic,
  avg(rank_ic) / stddev_pop(rank_ic) AS icir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio FROM ic""",
    "n_dates",
    "mean_ic std_ic icir positive_ratio",
)
def ic_summary(t: Tables):
    return ev.ic_summary(ev.daily_rank_ic(t.scores, t.extent))


@checked("top_k_returns", "K3", "returns", "SELECT * FROM returns", "trade_date n_names", RETURNS)
def top_k_returns(t: Tables):
    return ev.top_k_returns(t.scores)


@checked(
    "head_quality",
    "K4, K5",
    "quality",
    "SELECT * FROM quality",
    "trade_date",
    "ndcg_at_5 top5_true_percentile",
)
def head_quality(t: Tables):
    return ev.head_quality(t.scores, t.extent)


@checked(
    "return_capture",
    "K6",
    "placed",
    """SELECT trade_date, p AS pred_return_sum, m AS max_return_sum, r AS random_return_sum,
  CASE WHEN abs(m) > 1e-9 THEN p / (m + 1e-12) ELSE 0 END AS ratio_pred,
  CASE WHEN abs(m) > 1e-9 THEN r / (m + 1e-12) ELSE 0 END AS ratio_random,
  CASE WHEN abs(m - r) > 1e-6 THEN (p - r) / (m - r + 1e-12) ELSE 0 END AS final_score
FROM (SELECT trade_date, sum(label) FILTER (WHERE place <= 5) AS p, sum(label) FILTER (WHERE best <= 5) AS m,
  5 * avg(label) AS r FROM placed GROUP BY 1 HAVING count(*) >= 5)""",
    "trade_date",
    "pred_return_sum max_return_sum random_return_sum ratio_pred ratio_random final_score",
)
def return_capture(t: Tables):
    return ev.capture(t.scores)


@checked(
    "daily_evaluation",
    "K1, K3-K5, K9",
    "evaluated",
    "SELECT * FROM evaluated",
    "trade_date n_names",
    f"{RETURNS} rank_ic ndcg_at_5 top5_true_percentile",
)
def daily_evaluation(t: Tables):
    return ev.evaluate_daily(t.scores, t.extent)


SUMMARY = (
    "mean_ic std_ic icir positive_ratio "
    + " ".join(f"top{k}_{m}_mean" for k in (5, 10, 20) for m in ("return", "excess_return"))
    + " worst_daily_top5_excess_return positive_top5_excess_day_ratio ndcg_at_5_mean top5_true_percentile_mean"
)


def summary_sql(where: str = "true") -> str:
    means = ", ".join(
        f"avg(top{k}_{m}) AS top{k}_{m}_mean" for k in (5, 10, 20) for m in ("return", "excess_return")
    )
    return f"""SELECT count(*) AS n_dates, avg(rank_ic) AS mean_ic, stddev_pop(rank_ic) AS std_ic,
  avg(rank_ic) / stddev_pop(rank_ic) AS icir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio,
  {means}, min(top5_excess_return) AS worst_daily_top5_excess_return,
  avg(CASE WHEN top5_excess_return > 0 THEN 1.0 ELSE 0.0 END) AS positive_top5_excess_day_ratio,
  avg(ndcg_at_5) AS ndcg_at_5_mean, avg(top5_true_percentile) AS top5_true_percentile_mean
FROM evaluated WHERE {where}"""


@checked("evaluation_summary", "K7", "evaluated", summary_sql(), "n_dates", SUMMARY)
def evaluation_summary(t: Tables):
    return ev.evaluation_summary(ev.evaluate_daily(t.scores, t.extent))


@checked(
    "evaluation_of_test_part",
    "K8",
    "evaluated signal_days",
    summary_sql("trade_date IN (SELECT trade_date FROM signal_days WHERE ordinal >= 192 AND ordinal < 232)"),
    "n_dates",
    SUMMARY,
)
def evaluation_of_test_part(t: Tables):
    signal = t.panel.where("in_signal_range")
    split = sp.purged_split(signal, 150, 30, 40, gap_days=5, gap2_days=7)
    part = ev.scope_to_split(t.scores, split, "test")
    return ev.evaluation_summary(ev.evaluate_daily(part, t.extent))


def relevance(t: Tables):
    return xs.relevance(t.scores, t.extent)


_W = "OVER (PARTITION BY trade_date)"
_unit = f"(relevance - min(relevance) {_W}) / greatest(max(relevance) {_W} - min(relevance) {_W}, 1e-12)"
_mass = {
    "ordinal_softmax": f"exp(relevance - max(relevance) {_W})",
    "normalized_rank_softmax": f"exp({_unit})",
    "percentile_target": f"CASE WHEN max(relevance) {_W} = min(relevance) {_W} THEN 1.0 ELSE {_unit} END",
}


def _target(kind: str) -> str:
    return f"SELECT *, m / sum(m) {_W} AS target_prob FROM (SELECT *, {_mass[kind]} AS m FROM weighted)"


# Fixed values, written out here so that the SQL doesn't take them from the operators.
_TARGETS = ("ordinal_softmax", "normalized_rank_softmax", "percentile_target")
_SHORTCUT = (*o.LOW_VOL, "turnover")

for _kind in _TARGETS:

    @checked(f"target_{_kind}", "K10", "weighted", _target(_kind), KEYS, "target_prob")
    def target(t: Tables, kind: str = _kind):
        return ls.target_distribution(relevance(t), t.extent, kind)


o.cte("targets", "weighted", _target("normalized_rank_softmax"))
o.cte(
    "concentration",
    "targets",
    """SELECT trade_date, count(*) AS num_stocks, sum(target_prob) FILTER (WHERE k <= 1) AS top1_mass,
  sum(target_prob) FILTER (WHERE k <= 5) AS top5_mass, sum(target_prob) FILTER (WHERE k <= 10) AS top10_mass,
  -sum(target_prob * ln(greatest(target_prob, 1e-30))) AS entropy
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY target_prob DESC, code) AS k FROM targets) GROUP BY 1""",
)


def targets(t: Tables):
    return ls.target_distribution(relevance(t), t.extent)


@checked(
    "target_concentration",
    "K11",
    "concentration",
    "SELECT * FROM concentration",
    "trade_date num_stocks",
    "top1_mass top5_mass top10_mass entropy",
)
def target_concentration(t: Tables):
    return ls.target_concentration(targets(t))


@checked(
    "target_concentration_summary",
    "K11",
    "concentration",
    "SELECT count(*) AS num_cross_sections, "
    + ", ".join(
        f"{f}({c}) AS {c}_{n}"
        for c in ("top1_mass", "top5_mass", "entropy")
        for f, n in (("min", "min"), ("avg", "mean"), ("max", "max"))
    )
    + " FROM concentration",
    "num_cross_sections",
    " ".join(f"{c}_{n}" for c in ("top1_mass", "top5_mass", "entropy") for n in ("min", "mean", "max")),
)
def target_concentration_summary(t: Tables):
    return ls.concentration_summary(ls.target_concentration(targets(t)))


@checked("top_weights", "K12", "weighted", "SELECT * FROM weighted", f"{KEYS} is_head", "pair_weight")
def top_weights(t: Tables):
    return ls.top_weights(relevance(t), t.extent)


@checked(
    "listwise_loss",
    "K13",
    "targets",
    """SELECT trade_date, sum(-(t / (ts + 1e-12)) * (score - lse)) AS listwise_loss FROM (
SELECT *, target_prob * pair_weight AS t, sum(target_prob * pair_weight) OVER (PARTITION BY trade_date) AS ts,
  ln(sum(exp(score)) OVER (PARTITION BY trade_date)) AS lse FROM targets) GROUP BY 1""",
    "trade_date",
    "listwise_loss",
)
def listwise_loss(t: Tables):
    return ls.listwise_loss(ls.top_weights(targets(t), t.extent), t.extent)


_SP = "CASE WHEN x > 0 THEN x + ln(1 + exp(-x)) ELSE ln(1 + exp(x)) END"
o.cte(
    "pairs",
    "weighted",
    f"""SELECT trade_date, hh, w, {_SP} AS loss FROM (
SELECT a.trade_date, a.is_head AND NOT b.is_head AS hh, a.pair_weight + b.pair_weight AS w, b.score - a.score AS x
FROM weighted a JOIN weighted b ON a.trade_date = b.trade_date AND a.relevance > b.relevance)""",
)
o.cte(
    "pair_losses",
    "pairs",
    """SELECT trade_date, count(*) AS n_pairs, avg(loss * w) AS pairwise_loss, avg(loss) AS global_loss,
  avg(loss) FILTER (WHERE hh) AS head_loss FROM pairs GROUP BY 1""",
)


def weighted(t: Tables):
    return ls.top_weights(relevance(t), t.extent)


@checked(
    "pairwise_losses",
    "K14, K15, K16",
    "pair_losses",
    "SELECT * FROM pair_losses",
    "trade_date n_pairs",
    "pairwise_loss global_loss head_loss",
)
def pairwise_losses(t: Tables):
    return ls.pairwise_losses(weighted(t), t.extent)


@checked(
    "pairwise_losses_split",
    "K14, K15, K16",
    "pair_losses",
    "SELECT * FROM pair_losses",
    "trade_date n_pairs",
    "pairwise_loss global_loss head_loss",
)
def pairwise_losses_split(t: Tables):
    return ls.pairwise_losses(weighted(t), split_extent(t))


# Scores fifty times as wide, and one date with an outlier far beyond.
_WIDE_DAY, _FAR = "2000-03-06", 1e5
o.cte(
    "wide",
    "weighted",
    f"""SELECT * REPLACE (CASE WHEN first_code = 1 AND trade_date = DATE '{_WIDE_DAY}' THEN {_FAR} ELSE score * 50 END AS score)
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY code) AS first_code FROM weighted)""",
)
o.cte(
    "wide_pairs",
    "wide",
    f"""SELECT trade_date, hh, w, {_SP} AS loss FROM (
SELECT a.trade_date, a.is_head AND NOT b.is_head AS hh, a.pair_weight + b.pair_weight AS w, b.score - a.score AS x
FROM wide a JOIN wide b ON a.trade_date = b.trade_date AND a.relevance > b.relevance)""",
)


def wide_scores(t: Tables):
    rows = weighted(t)
    first = rows.groupBy("trade_date").agg(F.min("code").alias("_first"))
    far = (F.col("code") == F.col("_first")) & (F.col("trade_date") == F.lit(_WIDE_DAY).cast("date"))
    marked = attach(rows, first, ["trade_date"], t.extent.dates)
    return marked.withColumn("score", F.when(far, F.lit(_FAR)).otherwise(F.col("score") * 50)).drop("_first")


@checked(
    "pairwise_losses_wide",
    "K14, K15, K16",
    "wide_pairs",
    """SELECT trade_date, count(*) AS n_pairs, avg(loss * w) AS pairwise_loss, avg(loss) AS global_loss,
  avg(loss) FILTER (WHERE hh) AS head_loss FROM wide_pairs GROUP BY 1""",
    "trade_date n_pairs",
    "pairwise_loss global_loss head_loss",
)
def pairwise_losses_wide(t: Tables):
    return ls.pairwise_losses(wide_scores(t), t.extent)


_corr = lambda x, y, eps: f"count(*) * covar_pop({x}, {y}) / greatest(count(*) * stddev_pop({x}) * stddev_pop({y}), {eps})"
o.cte(
    "stability",
    "rel",
    f"SELECT trade_date, pow(greatest(-({_corr('score', 'relevance', '1e-8')}), 0), 2) AS stability_penalty FROM rel GROUP BY 1",
)
_z = lambda c: (
    f'CASE WHEN stddev_pop("{c}") {_W} > 1e-8 THEN ("{c}" - avg("{c}") {_W}) / nullif(stddev_pop("{c}") {_W}, 0) ELSE 0 END'
)
o.cte(
    "shortcut",
    "rel ranked",
    f"""SELECT trade_date, {_corr('score', 'idx', '1e-8')} AS shortcut_correlation FROM (
SELECT r.trade_date, r.score, {o.mean([_z(c) for c in _SHORTCUT])} AS idx
FROM rel r JOIN ranked x USING (code, trade_date)) GROUP BY 1""",
)


@checked("stability_penalty", "K17", "stability", "SELECT * FROM stability", "trade_date", "stability_penalty")
def stability_penalty(t: Tables):
    return ls.stability_penalty(relevance(t))


def shortcuts(t: Tables):
    rows = t.scores.join(t.ranked_factors, ["code", "trade_date"])
    return ls.shortcut_penalty(ls.volatility_index(rows, t.extent))


@checked(
    "shortcut_penalty",
    "K18",
    "shortcut",
    "SELECT *, abs(shortcut_correlation) AS shortcut_penalty FROM shortcut",
    "trade_date",
    "shortcut_correlation shortcut_penalty",
)
def shortcut_penalty(t: Tables):
    return shortcuts(t)


@checked(
    "loss_components",
    "K15-K18",
    "pair_losses stability shortcut",
    """SELECT trade_date, head_loss + 0.2 * global_loss + 0.05 * stability_penalty
  + 0.05 * abs(shortcut_correlation) AS total_loss
FROM pair_losses JOIN stability USING (trade_date) JOIN shortcut USING (trade_date)""",
    "trade_date",
    "total_loss",
)
def loss_components(t: Tables):
    pairs = ls.pairwise_losses(weighted(t), t.extent)
    return ls.component_total(pairs, ls.stability_penalty(relevance(t)), shortcuts(t), short=0.05)


@checked(
    "auxiliary_regression",
    "K19",
    "scores",
    """SELECT trade_date, 0.5 * avg((score - y) * (score - y)) + 0.5 * avg(abs(score - y)) AS aux_loss FROM (
SELECT *, (label - min(label) OVER (PARTITION BY trade_date)) / (max(label) OVER (PARTITION BY trade_date)
  - min(label) OVER (PARTITION BY trade_date) + 1e-8) AS y FROM scores) GROUP BY 1""",
    "trade_date",
    "aux_loss",
)
def auxiliary_regression(t: Tables):
    return ls.auxiliary_regression(t.scores, t.extent)


def picks(t: Tables):
    day = t.scores.agg(F.max("trade_date").alias("trade_date"))
    last = t.scores.join(F.broadcast(day), "trade_date")
    return xs.top_k_portfolio(last).select("stock_id", "weight")


o.cte(
    "picked",
    "placed",
    "SELECT code FROM placed WHERE place <= 5 AND trade_date = (SELECT max(trade_date) FROM placed)",
)
SCORE = """SELECT sum(0.2 * (last_open - first_open) / first_open) AS final_score FROM (
SELECT code, first(open ORDER BY trade_date) AS first_open, last(open ORDER BY trade_date) AS last_open FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM panel
  WHERE code IN (SELECT code FROM picked)) WHERE k <= 5 GROUP BY 1)"""


@checked("portfolio_score", "K20", "picked panel", SCORE, "", "final_score")
def portfolio_score(t: Tables):
    return so.score_submission(picks(t), t.panel)


@checked(
    "submission_check",
    "K21",
    "picked panel",
    f"SELECT 'valid' AS submission, final_score FROM ({SCORE}) UNION ALL SELECT 'overweight', -999.0",
    "submission",
    "final_score",
)
def submission_check(t: Tables):
    good = so.score_submission(picks(t), t.panel)
    heavy = so.score_submission(picks(t).withColumn("weight", F.lit(0.5)), t.panel)
    return good.withColumn("submission", F.lit("valid")).unionByName(
        heavy.withColumn("submission", F.lit("overweight"))
    )


def trials(t: Tables):
    """Daily rank IC, months cycling through three configurations as their trials."""
    return ev.daily_rank_ic(t.scores, t.extent).select(
        F.concat(F.lit("c"), F.month("trade_date") % 3).alias("config"),
        F.col("rank_ic").alias("score"),
    )


@checked(
    "stability_score",
    "K23",
    "ic",
    """SELECT 'c' || (month(trade_date) % 3) AS config, avg(rank_ic) - 0.5 * stddev_pop(rank_ic) AS stability_score
FROM ic GROUP BY 1""",
    "config",
    "stability_score",
)
def stability_score(t: Tables):
    return ev.stability_score(trials(t))


@checked(
    "best_config",
    "K23",
    "ic",
    """SELECT config, s AS stability_score FROM (SELECT 'c' || (month(trade_date) % 3) AS config,
  avg(rank_ic) - 0.5 * stddev_pop(rank_ic) AS s FROM ic GROUP BY 1) ORDER BY s DESC, config DESC LIMIT 1""",
    "config",
    "stability_score",
)
def best_config(t: Tables):
    return ev.best_config(ev.stability_score(trials(t)), require_positive=False)


def metric_log(t: Tables):
    """Weekly top-5 returns by year, read as the epochs of a run."""
    epochs = Window.partitionBy("run").orderBy("trade_date")
    return (
        ev.top_k_returns(t.scores)
        .withColumn("run", F.year("trade_date").cast("long"))
        .select(
            "run",
            F.row_number().over(epochs).cast("long").alias("epoch"),
            F.round("top5_return", 9).alias("metric"),
        )
    )


o.cte(
    "log",
    "returns",
    """SELECT year(trade_date) AS run, row_number() OVER (PARTITION BY year(trade_date) ORDER BY trade_date) AS epoch,
  round(top5_return, 9) AS metric FROM returns""",
)


@checked(
    "early_stop",
    "K24",
    "log",
    """SELECT run, arg_max(epoch, CASE WHEN up THEN epoch END) AS best_epoch, max(metric) FILTER (WHERE up) AS best_metric,
  max(epoch) AS last_epoch, bool_or(stop) AS stopped_early
FROM (SELECT *, min(CASE WHEN stop THEN epoch END) OVER (PARTITION BY run) AS stop_at FROM (
  SELECT *, epoch - coalesce(max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) >= 10 AS stop FROM (
    SELECT *, metric > coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS up
    FROM log)))
WHERE stop_at IS NULL OR epoch <= stop_at GROUP BY run""",
    "run best_epoch last_epoch stopped_early",
    "best_metric",
)
def early_stop(t: Tables):
    return ev.early_stop(metric_log(t))
