"""Keyed permutations of 0..n-1 as column expressions.

Swap-or-not shuffle: in each round a place has one partner, and a keyed bit that both
agree on says whether they change places. Every round is its own inverse, so the
whole is a permutation for every n, without sorting and without retries, and any row
finds its place alone. The numbers come from MD5, which other engines compute alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 32


def keyed_number(*parts: Column) -> Column:
    """A number below 2**32 that depends on the parts alone."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _round(at: Column, n: Column, key: Column, i: Column) -> Column:
    other = F.pmod(keyed_number(key, i) % n - at, n)
    swap = keyed_number(key, i, F.greatest(at, other)) % 2 == 1
    return F.when(swap, other).otherwise(at)


def permuted(place: Column, n: Column, key: Column) -> Column:
    """Where the keyed permutation of 0..n-1 takes ``place``."""
    steps = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(steps, place.cast("long"), lambda at, i: _round(at, n.cast("long"), key, i))


def unpermuted(place: Column, n: Column, key: Column) -> Column:
    """The place that permuted() takes to ``place``: the rounds from the last to the first."""
    steps = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
    return F.aggregate(steps, place.cast("long"), lambda at, i: _round(at, n.cast("long"), key, i))
