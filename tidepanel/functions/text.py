"""Notice text: markup removal, dates, wording flags and embedded codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that official notices use.
DATE_FIRST = (
    r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日[^。]{0,30}(?:生效|实施)"
)
VERB_FIRST = (
    r"(?:生效|实施)[^。]{0,30}(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
)
AFTER_CLOSE = r"(?:收市|盘后|市后)[^。]{0,12}(?:生效|实施)"
DELISTING = "退市日起"
SIX_DIGITS = r"(?<!\d)(\d{6})(?!\d)"


def plain_text(html: Column) -> Column:
    """Drop tags, then close the gaps some notices put inside numbers."""
    return F.regexp_replace(
        F.regexp_replace(html, r"<[^>]+>", " "), r"(?<=\d)\s+(?=\d)", ""
    )


def _date_by(plain: Column, pattern: str) -> Column:
    part = [F.regexp_extract(plain, pattern, i).try_cast("int") for i in (1, 2, 3)]
    text = F.format_string("%04d-%02d-%02d", *part)
    return F.when(plain.rlike(pattern), text.try_cast("date"))


def stated_date(plain: Column) -> Column:
    """The first pattern that matches decides; NULL is a parse error."""
    return F.when(plain.rlike(DATE_FIRST), _date_by(plain, DATE_FIRST)).otherwise(
        _date_by(plain, VERB_FIRST)
    )


def after_close(plain: Column) -> Column:
    return plain.rlike(AFTER_CLOSE)


def six_digit_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIX_DIGITS), F.lit(1))


def parse_date(text: Column) -> Column:
    """``2026/2/7``, ``2026-02-07`` or ``20260207``; anything else is NULL."""
    head = F.trim(F.split(F.trim(text), " ")[0])
    return F.coalesce(
        F.when(head.rlike(r"^\d{8}$"), F.try_to_timestamp(head, F.lit("yyyyMMdd"))),
        F.when(head.rlike(r"^\d{4}/"), F.try_to_timestamp(head, F.lit("y/M/d"))),
        F.when(head.rlike(r"^\d{4}-"), F.try_to_timestamp(head, F.lit("y-M-d"))),
    ).cast("date")


def parse_flag(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")).isin("true", "1"), F.lit(False))
