"""Reference SQL for the registered queries, as shared named sub-queries.

The SQL is written independently of the Spark plans: joins where Spark expands,
lists where Spark slides, brute-force pairs where Spark sums.
"""

from __future__ import annotations

from tidepanel.catalog.base import (
    RESEARCH_START,
    SIGNAL_END,
    SIGNAL_START,
    TRAIN_END,
)

LOW_VOL = ("amplitude", "STD5", "STD10", "STD20", "STD60", "volatility_10", "volatility_20", "atr_14")
BASE24 = (
    *LOW_VOL, "amount", "turnover", "volume_ratio", "volume_change", "VMA5", "VMA20", "VSTD20",
    "WVMA20", "ROC5", "ROC20", "ROC60", "RANK5", "RANK20", "RANK60", "RSV20", "MA20",
)
MARKET4 = ("market_return_20", "market_volatility_20", "market_drawdown_60", "market_breadth_20")
SIGNS = (-1.0, 1.0, -1.0, -1.0)


def lst(col: str, n: int) -> str:
    return f"list({col}) OVER (PARTITION BY code ORDER BY trade_date ROWS {n - 1} PRECEDING)"


def full(expr: str, col: str, n: int) -> str:
    return (
        f"CASE WHEN count({col}) OVER (PARTITION BY code ORDER BY trade_date ROWS {n - 1} PRECEDING)"
        f" = {n} THEN {expr} END"
    )


def roll(fn: str, col: str, n: int) -> str:
    return full(
        f"{fn}({col}) OVER (PARTITION BY code ORDER BY trade_date ROWS {n - 1} PRECEDING)", col, n
    )


def roll_list(fn: str, col: str, n: int) -> str:
    return full(f"list_aggregate({lst(col, n)}, '{fn}')", col, n)


def day_roll(fn: str, col: str, n: int) -> str:
    w = f"OVER (ORDER BY trade_date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {fn}({col}) {w} END"


def pct_rank(n: int) -> str:
    below = f"len(list_filter(w{n}, lambda x: x < close))"
    equal = f"len(list_filter(w{n}, lambda x: x = close))"
    return f"CASE WHEN len(w{n}) = {n} THEN ({below} + ({equal} + 1) / 2.0) / {n} END"


def mean(cols) -> str:
    return "(" + " + ".join(cols) + f") / {float(len(cols))}"


def avg_rank(col: str, by: str = "trade_date", desc: bool = False) -> str:
    order = f"{col} DESC" if desc else col
    return (
        f"(rank() OVER (PARTITION BY {by} ORDER BY {order})"
        f" + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0)"
    )


PRIOR = "lag(close) OVER (PARTITION BY code ORDER BY trade_date)"
WINDOW = "OVER (PARTITION BY code ORDER BY trade_date)"

CTES: dict[str, tuple[str, str]] = {}


def cte(name: str, deps: str, body: str) -> None:
    CTES[name] = (deps, body)


cte(
    "b0",
    "",
    """SELECT lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(l_suppkey AS VARCHAR))) AS INTEGER), '0') AS code,
  CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
  first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS open,
  last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS close,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  round(sum(l_quantity), 4) AS vol,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS amount
FROM lineitem GROUP BY 1, 2""",
)
cte(
    "cal",
    "b0",
    """SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS pos
FROM (SELECT DISTINCT trade_date FROM b0)""",
)
cte(
    "bars",
    "b0 cal",
    """SELECT b0.*, pos, vol / sum(vol) OVER (PARTITION BY code ORDER BY trade_date ROWS 51 PRECEDING) AS turnover_rate,
  1.0 + 0.25 * floor(pos / 52) AS adj_factor
FROM b0 JOIN cal USING (trade_date)""",
)
cte("expected", "b0", "SELECT count(DISTINCT code) // 2 AS n FROM b0")
cte(
    "spine",
    "b0 cal",
    """SELECT f.code, cal.trade_date, cal.pos
FROM (SELECT code, min(trade_date) AS d FROM b0 GROUP BY code) f JOIN cal ON cal.trade_date >= f.d""",
)
cte(
    "snap",
    "spine b0 cal expected",
    """SELECT trade_date, code, recent_amt FROM (
  SELECT t.trade_date, code, recent_amt,
    row_number() OVER (PARTITION BY t.trade_date ORDER BY recent_amt DESC, code) AS place
  FROM (SELECT s.code, s.trade_date, round(sum(coalesce(b.amount, 0)) OVER
          (PARTITION BY s.code ORDER BY s.trade_date ROWS 12 PRECEDING), 4) AS recent_amt
        FROM spine s LEFT JOIN b0 b ON s.code = b.code AND s.trade_date = b.trade_date) t
  JOIN (SELECT min(trade_date) AS trade_date FROM cal GROUP BY date_trunc('month', trade_date)) m
    ON m.trade_date = t.trade_date
  JOIN cal c ON c.trade_date = t.trade_date AND c.pos >= 12)
WHERE place <= (SELECT n FROM expected)""",
)
cte(
    "members",
    "snap cal",
    f"""SELECT d.trade_date, s.code, s.recent_amt AS weight, d.source_date
FROM (SELECT c.trade_date, max(x.trade_date) AS source_date
      FROM cal c JOIN (SELECT DISTINCT trade_date FROM snap) x ON x.trade_date <= c.trade_date
      WHERE c.trade_date BETWEEN DATE '{RESEARCH_START}' AND DATE '{SIGNAL_END}'
      GROUP BY c.trade_date) d
JOIN snap s ON s.trade_date = d.source_date""",
)
cte(
    "dense",
    "spine bars members",
    """SELECT s.code, s.trade_date, s.pos,
  b.close IS NULL AS is_suspended,
  b.open * sc AS o, b.close * sc AS c, b.high * sc AS h, b.low * sc AS l,
  coalesce(b.vol, 0) * 100.0 AS volume, coalesce(b.amount, 0) * 1000.0 AS amount,
  coalesce(b.turnover_rate, 0) AS turnover, b.adj_factor AS f,
  m.code IS NOT NULL AS is_member
FROM spine s
LEFT JOIN (SELECT *, adj_factor / first_value(adj_factor) OVER (PARTITION BY code ORDER BY trade_date) AS sc FROM bars) b
  ON s.code = b.code AND s.trade_date = b.trade_date
LEFT JOIN members m ON m.code = s.code AND m.trade_date = s.trade_date""",
)
_ffill = "last_value({} IGNORE NULLS) OVER (PARTITION BY code ORDER BY trade_date)"
cte(
    "filled",
    "dense",
    f"""SELECT code, trade_date, pos, is_suspended, is_member, is_member AND NOT is_suspended AS is_tradable,
  coalesce(o, {_ffill.format('c')}) AS open, coalesce(c, {_ffill.format('c')}) AS close,
  coalesce(h, {_ffill.format('c')}) AS high, coalesce(l, {_ffill.format('c')}) AS low,
  volume, amount, turnover, {_ffill.format('f')} AS adj_factor
FROM dense""",
)
cte(
    "panel",
    "filled",
    f"""SELECT *, round_even((high - low) / pc * 100.0 * 100.0, 0) / 100.0 AS amplitude,
  round_even((close - pc) * 1000000.0, 0) / 1000000.0 AS change_amt,
  round_even((close / pc - 1.0) * 100.0 * 1000000.0, 0) / 1000000.0 AS pct_chg,
  CASE WHEN x5 IS NULL THEN NULL WHEN s1 OR o1 <= 0 THEN 0.0 ELSE (x5 - o1) / o1 END AS label,
  x5 IS NOT NULL AND (s1 OR o1 <= 0) AS label_entry_failed,
  trade_date BETWEEN DATE '{SIGNAL_START}' AND DATE '{SIGNAL_END}' AS in_signal_range,
  CASE WHEN o1 > 0 THEN (o5 - o1) / o1 END AS contest_label
FROM (SELECT *, {PRIOR} AS pc,
    lead(open, 1) {WINDOW} AS o1, lead(is_suspended, 1) {WINDOW} AS s1,
    lead(close, 5) {WINDOW} AS x5, lead(open, 5) {WINDOW} AS o5 FROM filled)""",
)
cte(
    "daily",
    "panel",
    """SELECT trade_date, avg(200.0 * (pct_chg / 100.0) / (2.0 + pct_chg / 100.0) / 100.0) AS market_return,
  avg(CASE WHEN pct_chg > 0 THEN 1.0 ELSE 0.0 END) AS breadth_positive
FROM panel WHERE is_tradable AND pct_chg IS NOT NULL GROUP BY trade_date""",
)
cte(
    "market",
    "daily",
    f"""SELECT trade_date, {day_roll('product', 'g', 20)} - 1 AS market_return_20,
  {day_roll('stddev_pop', 'market_return', 20)} AS market_volatility_20,
  wealth / ({day_roll('max', 'wealth', 60)}) - 1 AS market_drawdown_60,
  {day_roll('avg', 'breadth_positive', 20)} AS market_breadth_20
FROM (SELECT *, 1 + market_return AS g, product(1 + market_return) OVER (ORDER BY trade_date) AS wealth FROM daily)""",
)
cte(
    "feat0",
    "panel",
    f"""SELECT *, close / pc - 1 AS ret, abs(close / pc - 1) * volume AS wret,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  row_number() {WINDOW} - 1 AS step,
  {lst('close', 5)} AS w5, {lst('close', 20)} AS w20, {lst('close', 60)} AS w60,
  volume / nullif(lag(volume) {WINDOW}, 0) - 1 AS volume_change
FROM panel""",
)
cte(
    "feat1",
    "feat0",
    f"""SELECT *,
  CASE WHEN step > 14 THEN tr / 14.0 WHEN step = 14 THEN {roll('avg', 'tr', 14)} ELSE 0 END * pow(14.0 / 13.0, step) AS atr_term
FROM feat0""",
)
_z = lambda e, name: f'coalesce({e}, 0.0) AS "{name}"'
cte(
    "features",
    "feat1",
    "SELECT code, trade_date, pos, open, close, high, low, volume, is_suspended, is_member, is_tradable,"
    " label, label_entry_failed, in_signal_range, contest_label, pct_chg,\n  "
    + ",\n  ".join(
        [
            _z("amplitude", "amplitude"),
            *[_z(f"({roll_list('stddev_pop', 'close', n)}) / (close + 1e-12)", f"STD{n}") for n in (5, 10, 20, 60)],
            *[_z(roll_list("stddev_samp", "ret", n), f"volatility_{n}") for n in (10, 20)],
            _z(f"CASE WHEN step >= 14 THEN sum(atr_term) {WINDOW} * pow(13.0 / 14.0, step) END", "atr_14"),
            _z("amount", "amount"),
            _z("turnover", "turnover"),
            _z(f"({roll('avg', 'volume', 5)}) / nullif({roll('avg', 'volume', 20)}, 0)", "volume_ratio"),
            _z("volume_change", "volume_change"),
            *[_z(f"({roll('avg', 'volume', n)}) / (volume + 1e-12)", f"VMA{n}") for n in (5, 20)],
            _z(f"({roll_list('stddev_pop', 'volume', 20)}) / (volume + 1e-12)", "VSTD20"),
            _z(f"({roll_list('stddev_samp', 'wret', 20)}) / (({roll('avg', 'wret', 20)}) + 1e-12)", "WVMA20"),
            *[_z(f"lag(close, {n}) {WINDOW} / (close + 1e-12)", f"ROC{n}") for n in (5, 20, 60)],
            *[_z(pct_rank(n), f"RANK{n}") for n in (5, 20, 60)],
            _z(f"(close - ({roll('min', 'low', 20)})) / (({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}) + 1e-12)", "RSV20"),
            _z(f"({roll('avg', 'close', 20)}) / (close + 1e-12)", "MA20"),
        ]
    )
    + "\nFROM feat1",
)
cte(
    "featm",
    "features market",
    "SELECT f.*, " + ", ".join(f"coalesce(m.{c}, 0.0) AS {c}" for c in MARKET4) + " FROM features f LEFT JOIN market m USING (trade_date)",
)


def pit(col: str) -> str:
    le = (
        f"sum(CASE WHEN is_tradable THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date ORDER BY \"{col}\""
        " RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return f"{le} / nullif(sum(CASE WHEN is_tradable THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY trade_date), 0)"


cte(
    "ranked",
    "featm",
    "SELECT * REPLACE (" + ", ".join(f'{pit(c)} AS "{c}"' for c in BASE24) + ") FROM featm",
)
cte(
    "scores",
    "ranked",
    f"""SELECT trade_date, code, round(0.5 * "ROC60" - ({mean([f'"{c}"' for c in LOW_VOL])}), 9) AS score,
  round(contest_label, 9) AS label
FROM ranked WHERE is_tradable AND in_signal_range AND contest_label IS NOT NULL""",
)
_train = f"trade_date <= DATE '{TRAIN_END}' AND is_tradable AND in_signal_range"
cte(
    "train_daily",
    "ranked",
    "SELECT trade_date, " + ", ".join(f"avg({c}) AS {c}" for c in MARKET4)
    + f" FROM ranked WHERE {_train} GROUP BY trade_date",
)
cte(
    "stress_fit",
    "train_daily",
    "SELECT " + ", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in MARKET4) + " FROM train_daily",
)


def component(i: int) -> str:
    c = MARKET4[i]
    return f"({c} - c_{c}) / s_{c} * {SIGNS[i]}"


cte(
    "marketf",
    "market",
    "SELECT trade_date, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in MARKET4) + " FROM market",
)
cte(
    "stressed",
    "marketf stress_fit",
    "SELECT trade_date, " + ", ".join(f"{component(i)} AS stress_{i}" for i in range(4))
    + ", " + mean([component(i) for i in range(4)])
    + " AS stress FROM marketf, stress_fit",
)
cte(
    "train_stressed",
    "train_daily stress_fit",
    "SELECT trade_date, " + ", ".join(f"{component(i)} AS stress_{i}" for i in range(4))
    + ", " + mean([component(i) for i in range(4)])
    + " AS stress FROM train_daily, stress_fit",
)
cte(
    "gate_fit",
    "train_stressed",
    "SELECT "
    + ", ".join(
        f"quantile_cont({c}, {q}) AS {c}_{n}"
        for c in ("stress", "stress_0", "stress_1", "stress_2", "stress_3")
        for q, n in ((0.7, "lo"), (0.9, "hi"))
    )
    + " FROM train_stressed",
)
cte(
    "rel",
    "scores",
    f"SELECT *, {avg_rank('label')} AS relevance FROM scores",
)
cte(
    "weighted",
    "rel",
    """SELECT *, CASE WHEN relevance >= thr THEN 2.0 ELSE 1.0 END AS pair_weight, relevance >= thr AS is_head
FROM (SELECT *, min(CASE WHEN rn <= 5 THEN relevance END) OVER (PARTITION BY trade_date) AS thr
      FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY relevance DESC, code) AS rn FROM rel))""",
)
cte("days", "cal", "SELECT trade_date, pos FROM cal")
cte(
    "signal_days",
    "panel",
    "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS ordinal"
    " FROM (SELECT DISTINCT trade_date FROM panel WHERE in_signal_range)",
)


def rounded(col: str) -> str:
    q = f'"{col}"'
    return (
        f"CASE WHEN abs({q}) < 100 THEN round({q} + 1.7e-9, 6) + 0.0"
        f" WHEN abs({q}) < 1e6 THEN round({q} + 1.7e-6, 3) + 0.0"
        f" ELSE round({q} / 1e6 + 1.7e-3, 0) * 1e6 END AS {q}"
    )


# Read by several others: evaluated once.
SHARED = {"bars", "panel", "market", "features", "featm", "ranked", "scores", "rel", "weighted"}


def sql(deps: str, body: str, dbl: str = "", cols: str = "") -> str:
    """Compose the named sub-queries ``deps`` needs with ``body``.

    ``cols`` are passed on as they are; ``dbl`` are rounded by magnitude.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0].split():
            visit(dep)
        order.append(name)

    for name in deps.split():
        visit(name)
    kept = lambda n: " MATERIALIZED" if n in SHARED else ""
    parts = [f"{n} AS{kept(n)} ({CTES[n][1]})" for n in order]
    parts.append(f"result AS ({body})")
    picks = ", ".join([f'"{c}"' for c in cols.split()] + [rounded(c) for c in dbl.split()]) or "*"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {picks} FROM result"
