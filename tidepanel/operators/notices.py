"""Membership change events out of announcements.

Every notice is parsed over its whole text, so notices spread over tasks row by
row. Tables are read by Arrow functions: nested expressions of Spark over rows, cells
and spans are interpreted and take some milliseconds a notice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import text as tx
from tidepanel.functions.codes import normalize_ts_code, zfill
from tidepanel.operators.calendar import snap_to_trading_day
from tidepanel.plans.extent import BROADCAST_ROWS
from tidepanel.plans.staging import stage
from tidepanel.schemas import require_none

# Table and sheet wording, headings, and index codes.
ADDED, REMOVED = "调入", "调出"
LIST_HEADING = r"沪深\s*300\s*指数样本调整名单[：:]?"
NEXT_HEADING = r"中证\s*500\s*指数样本调整名单"
INDEX_CODES = ("000300", "399300")

# The spans that HTML allows at most.
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000
CODES = "array<struct<code:string,action:string>>"

OVERRIDE_SCHEMA = "listed_code string, day date, remove string, add string, source string"


def select_announcements(items: DataFrame, start, end) -> DataFrame:
    """Index announcements around the research range; an unknown date passes."""
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    title = F.coalesce("headline", "title", F.lit("")) if "headline" in items.columns else F.coalesce(
        "title", F.lit("")
    )
    kind = F.col("item_type").isNull() | (F.col("item_type") == "announcement")
    timely = F.col("item_date").isNull() | F.col("item_date").between(
        F.add_months(start, -6), F.add_months(end, 1)
    )
    return items.where(kind & F.contains(title, F.lit("300")) & timely)


def effective_dates(notices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stated date, after-close wording, and the trading day it takes effect."""
    read = notices.withColumn("plain", tx.plain_text(F.col("content"))).withColumns(
        {"stated_date": tx.stated_date(F.col("plain")), "after_close": tx.after_close(F.col("plain"))}
    )
    return snap_to_trading_day(read, "stated_date", "after_close", calendar)


def _reached(start, end) -> Column:
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.col("effective_date").between(F.add_months(start, -3), end)


def in_reach(notices: DataFrame, start, end) -> DataFrame:
    """Effective no earlier than three months before the range, nor after it."""
    return notices.where(_reached(start, end))


def _delisted() -> Column:
    """Without a date of its own, and referring to a delisting day."""
    return F.coalesce(F.col("effective_date").isNull() & F.contains("plain", F.lit(tx.DELISTING)), F.lit(False))


# Java's expressions know ASCII alone in classes and cases, so these do as well.
_FLAGS = re.IGNORECASE | re.DOTALL | re.ASCII
_TABLE, _ROW, _TAG, _CODE = (
    re.compile(x, _FLAGS) for x in (r"<table.*?</table>", r"<tr[^>]*>.*?</tr>", r"<[^>]+>", tx.SIX_DIGITS)
)
_CELL, _DATA, _SPANNED = (
    re.compile(x, _FLAGS) for x in (r"<t[dh](?:\s[^>]*)?>.*?</t[dh]>", r"<td", r"\s(?:row|col)span\s*=")
)
_DOWN, _ACROSS = (
    re.compile(rf"<[^>]*?\s{name}\s*=\s*[\"']?\s*(\d+)", _FLAGS) for name in ("rowspan", "colspan")
)


def _span(cell: str, pattern: re.Pattern, most: int) -> int:
    """A span attribute of a cell's opening tag; 1 where there is none or no number."""
    told = pattern.match(cell)
    if told is None:
        return 1
    digits = told[1].lstrip("0")
    return most if len(digits) > 9 else min(int(digits or 0), most)


def _text(cell: str) -> str:
    return _TAG.sub(" ", cell).strip(" ")


def _grid(rows: Iterable[Iterable[tuple[str, int, int]]]) -> Iterator[list[str]]:
    """Rows of texts of cells (text, rows it reaches down, columns it takes).

    A claim from above takes its column as soon as a cell would start at or behind it,
    then the cell takes its own. Rows that only claims make stand beneath the last."""
    claims: list[tuple[int, str, int]] = []
    for cells in rows:
        line, below, used = [], [], 0

        def claim() -> None:
            _, text, left = claims[used]
            if left > 1:
                below.append((len(line), text, left - 1))
            line.append(text)

        for text, down, across in cells:
            while used < len(claims) and claims[used][0] <= len(line):
                claim()
                used += 1
            if down > 1:
                below += [(len(line) + i, text, down - 1) for i in range(across)]
            line += [text] * across
        while used < len(claims):
            claim()
            used += 1
        claims = below
        yield line
    while claims:
        yield [text for _, text, _ in claims]
        claims = [(at, text, left - 1) for at, text, left in claims if left > 1]


def spanned_grid(rows: Column) -> Column:
    """Texts by row and column of cells ``array<array<struct<text, down, across>>>``,
    spans repeated in every place."""

    @F.arrow_udf("array<array<string>>")
    def grids(tables: pa.Array) -> pa.Array:
        cells = ([[(c["text"], c["down"], c["across"]) for c in row] for row in t] for t in tables.to_pylist())
        return pa.array([list(_grid(t)) for t in cells], pa.list_(pa.list_(pa.string())))

    return grids(rows)


def _table_rows(table: str) -> Iterator[list[str]]:
    """Rows of cell texts. Rows of header cells only name columns and are left out."""
    rows = (_CELL.findall(r) for r in _ROW.findall(table) if _DATA.search(r))
    if not _SPANNED.search(table):
        return ([_text(c) for c in r] for r in rows)
    return _grid([(_text(c), _span(c, _DOWN, MOST_ROWS), _span(c, _ACROSS, MOST_COLUMNS)) for c in r] for r in rows)


def _table_codes(table: str) -> list[dict[str, str]]:
    """Code and action of each change in one table; none unless it is a change table."""
    width, words, found = 0, set(), {0: [], 2: []}
    for line in _table_rows(table):
        width = max(width, len(line))
        words.update(w for w in (ADDED, REMOVED) if any(w in text for text in line))
        for at, codes in found.items():
            code = _CODE.search(line[at]) if at < len(line) else None
            if code:
                codes.append(code[1])
    if width < 4 or len(words) < 2:
        return []
    return [{"code": c, "action": a} for at, a in ((0, "remove"), (2, "add")) for c in found[at]]


def _content_codes(content: str) -> list[dict[str, str]]:
    # Wording that a tag cuts in two counts nowhere, so plain search rules tables out.
    tables = (t for t in _TABLE.findall(content) if ADDED in t and REMOVED in t)
    return next(filter(None, map(_table_codes, tables)), [])


def change_codes(content: Column) -> Column:
    """Codes and actions of the first table that lists removals and additions, each
    notice read once and row by row, so a table is never held as a grid."""

    @F.arrow_udf(CODES)
    def codes(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("code", pa.string()), ("action", pa.string())]))
        return pa.array([None if x is None else _content_codes(x) for x in texts.to_pylist()], kind)

    return codes(content)


def _as_events(found: DataFrame, source: str) -> DataFrame:
    return found.select(
        "announcement_id",
        "effective_date",
        normalize_ts_code(F.col("e.code")).alias("con_code"),
        F.col("e.action").alias("action"),
        F.col(source).alias("source_announcement"),
    )


def html_table_events(notices: DataFrame, source: str = "announcement_id") -> DataFrame:
    """Codes of the first table that lists removals and additions."""
    return _as_events(notices.withColumn("e", F.explode(change_codes(F.col("content")))), source)


def text_section_events(notices: DataFrame, body: str = "body", source: str = "announcement_id") -> DataFrame:
    """Lines of the named section with two codes: the first leaves, the second joins."""
    section = F.regexp_extract(
        body, rf"(?s){LIST_HEADING}(.*?)(?={NEXT_HEADING}|\z)", 1
    )
    lines = notices.withColumn("_line", F.explode(F.split(section, r"\r\n|\n|\r")))
    codes = lines.withColumn("_codes", tx.six_digit_codes(F.col("_line"))).where(
        F.size("_codes") >= 2
    )
    pair = F.array(
        F.struct(F.get("_codes", F.lit(0)).alias("code"), F.lit("remove").alias("action")),
        F.struct(F.get("_codes", F.lit(1)).alias("code"), F.lit("add").alias("action")),
    )
    return _as_events(codes.withColumn("e", F.explode(pair)), source)


def sheet_events(rows: DataFrame, source: str = "announcement_id") -> DataFrame:
    """Rows of the removal and addition sheets, of the index where it is named.

    Columns: announcement_id, effective_date, sheet_name, index_code (optional), code.
    """
    if "index_code" in rows.columns:
        digits = zfill(F.regexp_extract(F.col("index_code").cast("string"), r"(\d+)", 1))
        # A sheet without an index column has no index code in any row.
        rows = rows.where(F.col("index_code").isNull() | digits.isin(*INDEX_CODES))
    kinds = F.filter(
        F.array(
            F.when(F.contains("sheet_name", F.lit(ADDED)), F.lit("add")),
            F.when(F.contains("sheet_name", F.lit(REMOVED)), F.lit("remove")),
        ),
        lambda k: k.isNotNull(),
    )
    acted = rows.where(F.col("code").isNotNull()).withColumn("_action", F.explode(kinds))
    return _as_events(
        acted.withColumn("e", F.struct("code", F.col("_action").alias("action"))), source
    )


def _listed_in(plain: Column, sizes: Sequence[int], digits: Sequence[int]) -> Column:
    """All substrings of a text that could be a listed code, by the codes' lengths."""
    runs = [F.regexp_extract_all(plain, F.lit(rf"(?=(\d{{{n}}}))"), F.lit(1)) for n in digits]
    others = [
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - n + 1, F.lit(1))), lambda i, n=n: F.substr(plain, i, F.lit(n)))
        for n in sizes
    ]
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *runs, *others))


def delisting_overrides(
    notices: DataFrame, overrides: DataFrame, calendar: DataFrame, check: bool = True
) -> DataFrame:
    """Fixed dates for notices that only refer to a delisting day.

    ``overrides`` lists codes with a day each, any number of them; the first listed
    code found anywhere in the text applies (by ``position`` if there is such a
    column, else as the rows stand), and its day must be a trading day. Codes are
    met by a join on the substrings of the text that have their length.
    """
    if check:
        require_none(
            overrides.join(calendar, overrides["day"] == calendar["trade_date"], "left_anti"),
            F.lit(True),
            "override day is not a trading day",
        )
        require_none(overrides, F.col("listed_code") == "", "override without a code")
    order = F.col("position") if "position" in overrides.columns else F.monotonically_increasing_id()
    entry = F.struct("day", "remove", "add", "source").alias("override")
    ordered = overrides.where(F.length("listed_code") > 0).select(F.col("listed_code").alias("_code"), order.alias("_order"), entry)
    listed = stage(ordered.groupBy("_code").agg(F.min_by("override", "_order").alias("override"), F.min("_order").alias("_order")), "overrides")
    shapes = listed.select(F.length("_code").alias("n"), F.col("_code").rlike(r"^\d+$").alias("d")).distinct().collect()
    digits, sizes = ([r["n"] for r in shapes if r["d"] == x] for x in (True, False))
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)

    applies = _delisted()
    # Equal texts share their answer, so texts are told apart by hash and need no key.
    asked = notices.where(applies).withColumn("_text", F.sha2("plain", 256))
    found = asked.select("_text", F.explode(_listed_in(F.col("plain"), sizes, digits)).alias("_code")).join(listed, "_code")
    first = found.groupBy("_text").agg(F.min_by("override", "_order").alias("override"))
    answered = asked.join(first, "_text", "left").drop("_text")
    answered = answered.withColumn("effective_date", F.col("override.day"))
    return answered.unionByName(notices.where(~applies), allowMissingColumns=True)


def override_events(notices: DataFrame, source: str = "announcement_id") -> DataFrame:
    pair = F.array(
        F.struct(F.col("override.remove").alias("code"), F.lit("remove").alias("action")),
        F.struct(F.col("override.add").alias("code"), F.lit("add").alias("action")),
    )
    sourced = notices.where(F.col("override").isNotNull()).withColumn(
        "_src", F.concat(F.col(source), F.lit(";"), F.col("override.source"))
    )
    return _as_events(sourced.withColumn("e", F.explode(pair)), "_src")


def parse_errors(notices: DataFrame, events: DataFrame) -> DataFrame:
    """Notices without a date, and dated ones that gave no code."""
    undated = notices.where(F.col("effective_date").isNull()).select(
        "announcement_id", F.lit("no effective date").alias("error")
    )
    silent = (
        notices.where(F.col("effective_date").isNotNull())
        .join(events.select("announcement_id").distinct(), "announcement_id", "left_anti")
        .select("announcement_id", F.lit("no codes").alias("error"))
    )
    return undated.unionByName(silent)


def announcement_events(
    notices: DataFrame,
    calendar: DataFrame,
    start,
    end,
    overrides: DataFrame | None = None,
    attachments: Sequence[DataFrame] = (),
) -> tuple[DataFrame, DataFrame]:
    """All events of the notices, and the notices that could not be read.

    Attachment events win over the notice's own table, which wins over an
    override. Texts are read once: dates and codes are staged, and the plain text only
    of notices that may have an override.
    """
    read = effective_dates(notices, calendar)
    wanted = _reached(start, end) | _delisted()
    dated = stage(
        read.select(
            "announcement_id",
            "effective_date",
            F.when(_delisted(), F.col("plain")).alias("plain"),
            change_codes(F.when(wanted, F.col("content"))).alias("codes"),
        ),
        "notices",
    )
    if overrides is not None:
        dated = delisting_overrides(dated, overrides, calendar)
    usable = in_reach(dated, start, end)
    levels = [*attachments, _as_events(usable.withColumn("e", F.explode("codes")), "announcement_id")]
    if overrides is not None:
        levels.append(override_events(usable))
    events = None
    for level in levels:
        if events is None:
            events = level
        else:
            seen = events.select("announcement_id").distinct()
            events = events.unionByName(level.join(seen, "announcement_id", "left_anti"))
    events = stage(events, "notice-events")
    unread = parse_errors(
        dated.where(F.col("effective_date").isNull()).unionByName(usable, allowMissingColumns=True),
        events,
    )
    return events, unread
