"""Numeric column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12  # fixed value


def finite_or_null(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_numeric(text: Column) -> Column:
    """Unparsable text, NaN and infinities become NULL."""
    return finite_or_null(text.try_cast("double"))


def eps_divide(x: Column, y: Column) -> Column:
    """x / (y + 1e-12); NULL where the shifted denominator is exactly zero."""
    return F.try_divide(x, y + F.lit(EPS))


def clean(x: Column) -> Column:
    """Missing or non-finite features become zero."""
    return F.coalesce(finite_or_null(x), F.lit(0.0))


def round_half_even_scaled(x: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothstep(p: Column) -> Column:
    q = clamp(p)
    return q * q * (F.lit(3.0) - F.lit(2.0) * q)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def safe_ratio(x: Column, y: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(otherwise))
