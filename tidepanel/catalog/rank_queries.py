"""Cross-sectional ranks, re-ranking and sequence samples."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from tidepanel.catalog import oracle as o
from tidepanel.catalog.base import SIGNAL_END, TRAIN_END, Tables
from tidepanel.catalog.registry import checked
from tidepanel.operators import crosssection as xs
from tidepanel.operators import rerank as rr
from tidepanel.operators import sequences as sq
from tidepanel.operators.sequence_store import store_sequences
from tidepanel.operators.features import BASE24
from tidepanel.plans import extent as ex
from tidepanel.plans.staging import shared_dir, stage
from tidepanel.sources import writers as wr

KEYS = "code trade_date"
SEQ = ("ROC5", "STD5", "RSV20")
LENGTH = 10


def split_extent(t: Tables) -> ex.Extent:
    """An extent under which every date is too large for one task."""
    per_bucket = -(-t.extent.dates * t.extent.per_date // 6)
    # Six buckets of a small panel; those of a large one are as the plan has them.
    return replace(t.extent, task_rows=1, bucket_rows=min(per_bucket, ex.DIRECT_WINDOW_ROWS))


@checked("pit_ranks", "F1", "ranked", "SELECT * FROM ranked", KEYS, " ".join(BASE24))
def pit_ranks(t: Tables):
    return xs.pit_rank(t.features, BASE24, t.extent)


@checked("pit_ranks_split", "F1", "ranked", "SELECT * FROM ranked", KEYS, "STD20 ROC60 RANK5 turnover")
def pit_ranks_split(t: Tables):
    """The plan for dates that do not fit one task."""
    names = ("STD20", "ROC60", "RANK5", "turnover")
    return xs.pit_rank(t.featured(*names), names, split_extent(t))


AVG = ("amplitude", "turnover", "RANK5")


@checked(
    "average_ranks",
    "F2",
    "features",
    "SELECT code, trade_date, "
    + ", ".join(
        f"""{o.avg_rank(f'"{c}"')} / count(*) OVER (PARTITION BY trade_date) AS "{c}\"""" for c in AVG
    )
    + " FROM features",
    KEYS,
    " ".join(AVG),
)
def average_ranks(t: Tables):
    return xs.average_rank(t.features, AVG, t.extent)


@checked(
    "average_ranks_split",
    "F2",
    "features",
    f"SELECT code, trade_date, {o.avg_rank('turnover')} / count(*) OVER (PARTITION BY trade_date) AS turnover FROM features",
    KEYS,
    "turnover",
)
def average_ranks_split(t: Tables):
    return xs.average_rank(t.featured("turnover"), ["turnover"], split_extent(t))


@checked(
    "average_ranks_hot_split",
    "F2",
    "features",
    f"""SELECT code, trade_date, {o.avg_rank('turnover')} / count(*) OVER (PARTITION BY trade_date) AS turnover
FROM (SELECT code, trade_date, CASE WHEN CAST(right(code, 1) AS INTEGER) % 2 = 0 THEN 0.0 ELSE turnover END AS turnover FROM features)""",
    KEYS,
    "turnover",
)
def average_ranks_hot_split(t: Tables):
    """Half of every date on one value."""
    half = F.substring("code", -1, 1).cast("int") % 2 == 0
    hot = t.featured("turnover").withColumn("turnover", F.when(half, F.lit(0.0)).otherwise(F.col("turnover")))
    return xs.average_rank(hot, ["turnover"], split_extent(t))


@checked("label_relevance", "F3", "rel", "SELECT * FROM rel", KEYS, "relevance")
def label_relevance(t: Tables):
    return xs.relevance(t.scores, t.extent, check=True)


@checked(
    "directional_rank",
    "F4",
    "features",
    f"SELECT code, trade_date, {o.avg_rank('turnover', desc=True)} / count(*) OVER (PARTITION BY trade_date) AS turnover FROM features",
    KEYS,
    "turnover",
)
def directional_rank(t: Tables):
    return xs.directional_rank(t.features, "turnover", higher_is_better=False, extent=t.extent)


def candidates(t: Tables):
    """Scored rows with the unranked factors the families use."""
    factors = t.factors.select("code", "trade_date", *rr.FACTORS)
    return t.scores.join(factors, ["code", "trade_date"])


_PCT = "count(*) OVER (PARTITION BY trade_date)"


def _dir(col: str, desc: bool) -> str:
    return f'{o.avg_rank(chr(34) + col + chr(34), desc=desc)} / {_PCT}'


o.cte(
    "cand",
    "scores features",
    "SELECT s.trade_date, s.code, s.score, s.label, "
    + ", ".join(f'f."{c}"' for c in rr.FACTORS)
    + " FROM scores s JOIN features f USING (code, trade_date)",
)
o.cte(
    "fam",
    "cand",
    f"""SELECT trade_date, code, score, label,
  {o.mean([_dir(c, True) for c in o.LOW_VOL])} AS low_volatility,
  {o.mean([_dir(c, True) for c in ('amount', 'turnover')])} AS low_activity,
  {_dir('ROC60', False)} AS long_term_reversal,
  {_dir('score', False)} AS model_rank_pct,
  row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS original_rank
FROM cand""",
)
o.cte(
    "styled",
    "fam",
    f"""SELECT *, {o.avg_rank('comp9')} / {_PCT} AS family_rank_pct FROM (
SELECT *, (low_volatility + low_activity + long_term_reversal) / 3.0 AS reversal_style_composite,
  round((low_volatility + low_activity + long_term_reversal) / 3.0, 9) AS comp9 FROM fam)""",
)
o.cte(
    "metrics",
    "daily",
    """SELECT trade_date, breadth_positive AS breadth_today, b5 - b20 AS breadth_change_5_20,
  len(list_filter(past, lambda x: x <= vol)) * 1.0 / len(past) AS vol20_hist_percentile
FROM (SELECT *, list(vol) FILTER (WHERE vol IS NOT NULL) OVER (ORDER BY trade_date) AS past FROM (
SELECT *, avg(breadth_positive) OVER (ORDER BY trade_date ROWS 4 PRECEDING) AS b5,
  avg(breadth_positive) OVER (ORDER BY trade_date ROWS 19 PRECEDING) AS b20,
  CASE WHEN count(*) OVER (ORDER BY trade_date ROWS 19 PRECEDING) = 20 THEN
    stddev_pop(market_return) OVER (ORDER BY trade_date ROWS 19 PRECEDING) END AS vol FROM daily))
WHERE vol IS NOT NULL""",
)
o.cte(
    "regime",
    "metrics",
    """SELECT *, breadth_today >= 0.5 AND breadth_change_5_20 >= -0.01 AND vol20_hist_percentile >= 1.0 / 3.0 AS triggered,
  least((breadth_today - 0.5) / 0.05, (breadth_change_5_20 + 0.01) / 0.05,
    (vol20_hist_percentile - 1.0 / 3.0) / 0.1) AS trigger_margin FROM metrics""",
)


@checked(
    "family_overlay",
    "F5",
    "styled",
    "SELECT * FROM styled",
    KEYS,
    "low_volatility low_activity long_term_reversal reversal_style_composite family_rank_pct",
)
def family_overlay(t: Tables):
    return rr.family_overlay(candidates(t), t.extent)


def regime(t: Tables):
    from tidepanel.operators import market

    metrics = rr.regime_metrics(market.market_daily(t.market_panel))
    return rr.regime_rule(metrics.where(F.col("vol20_hist_percentile").isNotNull()))


@checked(
    "regime_rule",
    "F6",
    "regime",
    "SELECT * FROM regime",
    "trade_date triggered",
    "breadth_today breadth_change_5_20 vol20_hist_percentile trigger_margin",
)
def regime_rule(t: Tables):
    return regime(t)


def with_regime(t: Tables):
    rule = regime(t).select("trade_date", "triggered")
    return ex.attach(candidates(t), rule, ["trade_date"], t.extent.dates)


@checked(
    "original_order",
    "F8, F14",
    "scores",
    """SELECT trade_date AS signal_date, code AS stock_id, score AS raw_score, rn AS raw_rank,
  label AS future_return, rn <= 5 AS selected_top5, CASE WHEN rn <= 5 THEN 0.2 ELSE 0.0 END AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS rn FROM scores)""",
    "signal_date stock_id raw_score raw_rank future_return selected_top5",
    "weight",
)
def original_order(t: Tables):
    return xs.full_ranking(t.scores, t.extent)


@checked(
    "original_order_split",
    "F8, F14",
    "scores",
    """SELECT trade_date AS signal_date, code AS stock_id,
  row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS raw_rank FROM scores""",
    "signal_date stock_id raw_rank",
)
def original_order_split(t: Tables):
    return xs.full_ranking(t.scores, split_extent(t))


AUDIT = "code trade_date original_rank final_rank rank_change in_original_top5 in_final_top5"
o.cte(
    "blended",
    "styled regime",
    """SELECT *, original_rank - final_rank AS rank_change, original_rank <= 5 AS in_original_top5,
  final_rank <= 5 AS in_final_top5 FROM (
SELECT *, CASE WHEN a = 0 THEN original_rank ELSE row_number() OVER (PARTITION BY trade_date, a > 0
    ORDER BY round(final_score, 12) DESC, model_rank_pct DESC, family_rank_pct DESC, code) END AS final_rank
FROM (SELECT *, (1.0 - a) * model_rank_pct + a * family_rank_pct AS final_score
FROM (SELECT s.*, CASE WHEN r.triggered THEN 0.4 ELSE 0.0 END AS a
      FROM styled s LEFT JOIN regime r USING (trade_date))))""",
)


@checked("blend_rerank", "F7, F9, F11", "blended", "SELECT * FROM blended", AUDIT, "final_score")
def blend_rerank(t: Tables):
    return rr.blend_rerank(with_regime(t), F.col("triggered"), 0.4, t.extent)


@checked("blend_rerank_split", "F9", "blended", "SELECT * FROM blended", AUDIT, "final_score")
def blend_rerank_split(t: Tables):
    return rr.blend_rerank(with_regime(t), F.col("triggered"), 0.4, split_extent(t))


@checked(
    "pool_rerank",
    "F10",
    "styled regime",
    """SELECT *, original_rank - final_rank AS rank_change, original_rank <= 5 AS in_original_top5,
  final_rank <= 5 AS in_final_top5 FROM (
SELECT *, CASE WHEN NOT act OR original_rank > 15 THEN original_rank ELSE row_number() OVER (
    PARTITION BY trade_date, act AND original_rank <= 15
    ORDER BY round(low_volatility, 9) DESC, model_rank_pct DESC, code) END AS final_rank
FROM (SELECT s.*, coalesce(r.triggered, false) AS act FROM styled s LEFT JOIN regime r USING (trade_date)))""",
    AUDIT,
)
def pool_rerank(t: Tables):
    return rr.pool_rerank(with_regime(t), F.col("triggered"), t.extent)


@checked(
    "selection_manifest",
    "F12",
    "blended",
    """SELECT trade_date, count(*) AS candidate_count,
  list(code ORDER BY original_rank) FILTER (WHERE original_rank <= 5) AS original_top5,
  list(code ORDER BY final_rank) FILTER (WHERE final_rank <= 5) AS final_top5,
  count(*) FILTER (WHERE original_rank <= 5 AND final_rank <= 5) AS top5_overlap,
  5 - count(*) FILTER (WHERE original_rank <= 5 AND final_rank <= 5) AS top5_changed_count,
  max(a) = 0 AS rollback_active FROM blended GROUP BY 1""",
    "trade_date candidate_count original_top5 final_top5 top5_overlap top5_changed_count rollback_active",
)
def selection_manifest(t: Tables):
    return rr.selection_manifest(blend_rerank(t))


@checked(
    "rerank_files",
    "A12",
    "blended",
    """SELECT 'original_result' AS kind, trade_date, code AS stock_id, 0.2 AS value FROM blended WHERE original_rank <= 5
UNION ALL SELECT 'result', trade_date, code, 0.2 FROM blended WHERE final_rank <= 5
UNION ALL SELECT 'ranking_audit', trade_date, code, final_rank FROM blended
UNION ALL SELECT 'rerank_audit', trade_date, NULL, count(*) FROM blended GROUP BY trade_date""",
    "kind trade_date stock_id",
    "value",
)
def rerank_files(t: Tables):
    """The four outputs of a re-ranking, written and read again by their manifests."""
    audit = stage(blend_rerank(t).select("trade_date", "code", *AUDIT.split()[2:], "effective_alpha"), "audit")
    path = f"{shared_dir(t.spark)}/files/{t.spark.sparkContext.applicationId}/rerank-{uuid.uuid4().hex}"
    wr.write_rerank_outputs(audit, rr.selection_manifest(audit), path)
    picks = "trade_date date, stock_id string, weight double"
    found = [
        wr.read_ordered(t.spark, f"{path}/{n}", picks).select(F.lit(n).alias("kind"), "trade_date", "stock_id", F.col("weight").alias("value"))
        for n in ("original_result", "result")
    ]
    ranks = wr.read_ordered(t.spark, f"{path}/ranking_audit", audit.schema)
    found.append(ranks.select(F.lit("ranking_audit"), "trade_date", "code", F.col("final_rank").cast("double")))
    told = t.spark.read.schema("trade_date date, candidate_count long").json(f"{path}/rerank_audit")
    found.append(told.select(F.lit("rerank_audit"), "trade_date", F.lit(None).cast("string"), F.col("candidate_count").cast("double")))
    return found[0].union(found[1]).union(found[2]).union(found[3])


@checked(
    "top5_portfolio",
    "F13",
    "scores",
    """SELECT trade_date, code AS stock_id, 0.2 AS weight FROM (SELECT *, row_number() OVER
  (PARTITION BY trade_date ORDER BY score DESC, code) AS rn FROM scores) WHERE rn <= 5""",
    "trade_date stock_id",
    "weight",
)
def top5_portfolio(t: Tables):
    return xs.top_k_portfolio(t.scores)


def _last(n: int, cond: str, label: str = "contest_label") -> str:
    lists = ", ".join(
        f'list("{c}") OVER (PARTITION BY code ORDER BY trade_date ROWS {n - 1} PRECEDING) AS l{i}'
        for i, c in enumerate(SEQ)
    )
    return (
        f"SELECT code, trade_date, label, l0, l1, l2 FROM (SELECT code, trade_date, {label} AS label,"
        f" {cond} AS ok, {lists} FROM featm) WHERE ok AND len(l0) = {n}"
    )


def column_of(seq: str, i: int):
    return F.transform(seq, lambda s: s[i])


def flat(samples):
    """First, last and mean of every feature of a sequence, for comparison."""
    parts = []
    for i in range(len(SEQ)):
        step = column_of("seq", i)
        parts += [
            step[0].alias(f"first_{i}"),
            F.element_at(step, -1).alias(f"last_{i}"),
            (F.aggregate(step, F.lit(0.0), lambda a, x: a + x) / LENGTH).alias(f"mean_{i}"),
        ]
    return samples.select("*", F.size("seq").alias("steps"), *parts)


FLAT = ", ".join(
    f"l{i}[1] AS first_{i}, l{i}[-1] AS last_{i}, list_sum(l{i}) / {LENGTH} AS mean_{i}" for i in range(3)
)
FLAT_COLS = " ".join(f"{p}_{i}" for i in range(3) for p in ("first", "last", "mean"))


def labelled(t: Tables):
    return t.featured(*SEQ).withColumn("label", F.col("contest_label"))


MEMBER = "is_tradable AND contest_label IS NOT NULL"
o.cte("seqs", "featm", _last(LENGTH, MEMBER))


@checked(
    "sliding_sequences",
    "G1",
    "seqs",
    f"SELECT code, trade_date, len(l0) AS steps, {FLAT} FROM seqs",
    f"{KEYS} steps",
    FLAT_COLS,
)
def sliding_sequences(t: Tables):
    return flat(sq.sliding_sequences(labelled(t), SEQ, LENGTH))


GROUPED = f"""SELECT code, trade_date, n AS n_stocks, {o.avg_rank('label')} AS relevance, {FLAT}
FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n FROM seqs WHERE trade_date <= DATE '{TRAIN_END}')
WHERE n >= 10"""


@checked(
    "samples_by_date",
    "G2, G3",
    "seqs",
    GROUPED,
    f"{KEYS} n_stocks",
    f"relevance {FLAT_COLS}",
)
def samples_by_date(t: Tables):
    samples = sq.sliding_sequences(labelled(t), SEQ, LENGTH)
    return flat(sq.by_date(samples, t.extent, end=TRAIN_END))


@checked(
    "inference_sequences",
    "G4",
    "featm",
    f"SELECT code, trade_date, {FLAT} FROM ({_last(LENGTH, 'is_tradable')}) WHERE trade_date = DATE '{SIGNAL_END}'",
    KEYS,
    FLAT_COLS,
)
def inference_sequences(t: Tables):
    return flat(sq.inference_sequences(t.featured(*SEQ), SEQ, LENGTH, SIGNAL_END))


@checked(
    "predict_universe",
    "G5",
    "featm",
    f"""SELECT trade_date, count(*) AS eligible_before_sequence, count(*) FILTER (WHERE len(w) = {LENGTH}) AS scored_stocks,
  count(*) FILTER (WHERE len(w) = {LENGTH} AND contest_label IS NOT NULL) AS labelled_scored_stocks
FROM (SELECT *, list(1) OVER (PARTITION BY code ORDER BY trade_date ROWS {LENGTH - 1} PRECEDING) AS w FROM featm)
WHERE is_tradable AND trade_date > DATE '{TRAIN_END}'
GROUP BY 1 HAVING count(*) FILTER (WHERE len(w) = {LENGTH} AND contest_label IS NOT NULL) > 0""",
    "trade_date eligible_before_sequence scored_stocks labelled_scored_stocks",
)
def predict_universe(t: Tables):
    from datetime import timedelta

    _, audit = sq.predict_universe(
        t.featured(*SEQ),
        labelled(t).select("code", "trade_date", "label"),
        SEQ,
        LENGTH,
        TRAIN_END + timedelta(days=1),
        SIGNAL_END,
        t.extent,
        min_stocks=2,
    )
    return audit


@checked(
    "padded_batches",
    "G6",
    "seqs",
    """SELECT batch, trade_date, slot, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS mask, code,
  coalesce(label, 0.0) AS target, coalesce(relevance, 0.0) AS relevance, coalesce(l0[1], 0.0) AS first_0
FROM (SELECT d.trade_date, d.batch, u.slot, s.* EXCLUDE (trade_date, slot)
  FROM (SELECT trade_date, (row_number() OVER (ORDER BY trade_date) - 1) // 4 AS batch, n FROM (
      SELECT trade_date, count(*) AS n FROM seqs GROUP BY 1 HAVING count(*) >= 10)) d
  JOIN (SELECT batch, max(n) AS slots FROM (SELECT trade_date, (row_number() OVER (ORDER BY trade_date) - 1) // 4 AS batch, n
      FROM (SELECT trade_date, count(*) AS n FROM seqs GROUP BY 1 HAVING count(*) >= 10)) GROUP BY 1) b USING (batch),
    LATERAL (SELECT unnest(range(1, b.slots + 1)) AS slot) u
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY code) AS slot, """
    + o.avg_rank("label")
    + """ AS relevance FROM seqs) s ON s.trade_date = d.trade_date AND s.slot = u.slot)""",
    "batch trade_date slot mask code",
    "target relevance first_0",
)
def padded_batches(t: Tables):
    samples = sq.by_date(sq.sliding_sequences(labelled(t), SEQ, LENGTH), t.extent)
    padded = sq.pad_and_mask(samples, LENGTH, len(SEQ), t.extent)
    return padded.withColumn("first_0", F.col("seq")[0][0])


@checked(
    "all_labelled_sequences",
    "G7",
    "featm",
    f"""SELECT code, trade_date, {FLAT} FROM ({_last(LENGTH, 'contest_label IS NOT NULL')}) WHERE trade_date IN (
  SELECT trade_date FROM featm WHERE contest_label IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)""",
    KEYS,
    FLAT_COLS,
)
def all_labelled_sequences(t: Tables):
    return flat(sq.all_labelled_sequences(labelled(t), SEQ, LENGTH))


def store(t: Tables):
    return store_sequences(labelled(t), SEQ, LENGTH, staged=True)


@checked(
    "sliding_sequences_from_blocks",
    "G1",
    "seqs",
    f"SELECT code, trade_date, len(l0) AS steps, {FLAT} FROM seqs",
    f"{KEYS} steps",
    FLAT_COLS,
)
def sliding_sequences_from_blocks(t: Tables):
    """Samples as block and offset, expanded when they are read."""
    return flat(store(t).sliding_sequences())


@checked(
    "inference_sequences_from_blocks",
    "G4",
    "featm",
    f"SELECT code, trade_date, {FLAT} FROM ({_last(LENGTH, 'is_tradable')}) WHERE trade_date = DATE '{SIGNAL_END}'",
    KEYS,
    FLAT_COLS,
)
def inference_sequences_from_blocks(t: Tables):
    return flat(store(t).inference_sequences(SIGNAL_END))


@checked(
    "all_labelled_sequences_from_blocks",
    "G7",
    "featm",
    f"""SELECT code, trade_date, {FLAT} FROM ({_last(LENGTH, 'contest_label IS NOT NULL')}) WHERE trade_date IN (
  SELECT trade_date FROM featm WHERE contest_label IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)""",
    KEYS,
    FLAT_COLS,
)
def all_labelled_sequences_from_blocks(t: Tables):
    return flat(store(t).all_labelled_sequences())
