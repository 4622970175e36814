"""Guarded correlation from mergeable central moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.operators.ranks import average_ranks, bounded_average_ranks


def pearson(x: str | Column, y: str | Column, min_n: int = 3) -> Column:
    """Aggregate: Pearson r over rows where both are present; constant or n < 3 is NULL.

    ``covar_pop`` and ``var_pop`` merge centred moments, so one pass is stable, and unlike
    ``corr`` a constant column does not raise.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    vx, vy = F.var_pop(xs), F.var_pop(ys)
    # A spread at rounding level around a common value counts as constant.
    flat = (vx <= 1e-30 * F.avg(xs * xs)) | (vy <= 1e-30 * F.avg(ys * ys))
    r = F.try_divide(F.covar_pop(xs, ys), F.sqrt(vx) * F.sqrt(vy))
    r = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    return F.when((F.count(F.when(both, 1)) >= min_n) & ~flat, r)


def correlate(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), method: str = "pearson", bounded: bool = False
) -> DataFrame:
    """Per-group correlation ``n, r``; Spearman ranks with ties averaged.

    ``bounded`` says a group is limited by the number of samples, so a plain window ranks it.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).alias("_x"), F.col(y).alias("_y")
    )
    if method == "spearman":
        rank = bounded_average_ranks if bounded else average_ranks
        both = rank(rank(both, by, "_x", "_rx"), by, "_y", "_ry").select(
            *by, F.col("_rx").alias("_x"), F.col("_ry").alias("_y")
        )
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("r"))


def average_rank_moments(x: str, y: str, weight: str) -> Column:
    """Aggregate: Pearson r of two rank columns, rows counted by weight."""
    w = F.col(weight)
    n, sx, sy = F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(y))
    sxx, syy, sxy = (F.sum(w * F.col(a) * F.col(b)) for a, b in ((x, x), (y, y), (x, y)))
    return F.try_divide(sxy - sx * sy / n, F.sqrt(sxx - sx * sx / n) * F.sqrt(syy - sy * sy / n))
