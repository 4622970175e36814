"""Small column expressions used in several operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges of the count bins.
COUNT_EDGES = (1, 2, 4, 8, 16, 32)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def count_bin_labels(edges: Sequence[int] = COUNT_EDGES) -> list[str]:
    """``1, 2-3, 4-7, 8-15, 16-31, >=32``."""
    inner = [str(a) if b - a == 1 else f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])]
    return [*inner, f">={edges[-1]}"]


def count_bin(x: Column, edges: Sequence[int] = COUNT_EDGES) -> Column:
    """Label of the bin a count (or mean count) falls in; NULL below the first edge."""
    pairs = list(zip(edges, count_bin_labels(edges)))
    last = F.when(x >= pairs[-1][0], pairs[-1][1])
    return reduce(lambda acc, p: acc.when(x >= p[0], p[1]), reversed(pairs[:-1]), last)


def masked_sum(cond: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0))


def order_free_sum(value: Column) -> Column:
    """Aggregate: sum of doubles that is the same for any order of the rows, as the last bit of a plain sum is not.

    Each value is cut into two whole numbers, 2^-20 and 2^-52 a unit, whose sums are exact. Groups whose sum
    could reach 2^42, or that hold NaN or infinity, are summed plainly.
    """
    scaled = value * F.lit(2.0**20)
    whole = F.floor(scaled)
    rest = F.floor((scaled - whole) * F.lit(2.0**32))
    exact = (F.try_sum(whole) + F.try_sum(rest) / F.lit(2.0**32)) / F.lit(2.0**20)
    return F.when(F.count(value) * F.max(F.abs(value)) < F.lit(2.0**42), exact).otherwise(F.sum(value))
