"""Instrument codes: bare digits, exchange-qualified, and their prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zfill(text: Column, width: int = 6) -> Column:
    """Left-pad with zeros; longer text is kept whole (``lpad`` would cut it)."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def exchange_of(digits: Column, upper: bool = True) -> Column:
    sh, sz = ("SH", "SZ") if upper else ("sh", "sz")
    return F.when(digits.rlike("^[569]"), F.lit(sh)).otherwise(F.lit(sz))


def normalize_ts_code(value: Column) -> Column:
    """``600000.0`` -> ``600000.SH``; a missing code becomes ``000000.SZ``."""
    text = F.upper(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    numeric = zfill(F.regexp_replace(text, r"\.0+$", ""))
    digits = zfill(F.regexp_replace(text, r"[^0-9]", ""))
    qualified = F.concat(digits, F.lit("."), exchange_of(digits))
    # Plain digits, the usual case, need no pattern.
    plain = F.length(text).between(1, 6) & (F.translate(text, "0123456789", "") == "")
    padded = F.lpad(text, 6, "0")
    shanghai = F.substring(padded, 1, 1).isin("5", "6", "9")
    return (
        F.when(plain, F.concat(padded, F.when(shanghai, F.lit(".SH")).otherwise(F.lit(".SZ"))))
        .when(
            text.rlike(r"^\d{1,6}(\.0+)?$"),
            F.concat(numeric, F.lit("."), exchange_of(numeric)),
        )
        .when(text.rlike(r"^\d{6}\.(SH|SZ)$"), text)
        .otherwise(qualified)
    )


def pure_code(value: Column) -> Column:
    return F.substring_index(normalize_ts_code(value), ".", 1)


def strip_market_prefix(value: Column) -> Column:
    """``sh.600000`` -> ``600000``."""
    return zfill(F.regexp_replace(value, r"(sh|sz)\.", ""))


def constituent_digits(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    # Only the first dot splits the prefix off.
    tail = F.when(
        F.contains(text, F.lit(".")), F.regexp_replace(text, r"^[^.]*\.", "")
    ).otherwise(text)
    return zfill(F.regexp_replace(tail, r"[^0-9]", ""))


def constituent_symbol(raw: Column) -> Column:
    """``sh.600000`` or bare digits -> ``sh600000``."""
    text = F.lower(F.trim(raw))
    prefix = F.when(
        F.contains(text, F.lit(".")), F.substring_index(text, ".", 1)
    ).otherwise(exchange_of(text, upper=False))
    return F.concat(prefix, constituent_digits(raw))
