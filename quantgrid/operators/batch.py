"""Empirical-Bayes batch correction (location and scale, batch label only)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.model import CELL_KEY, FEATURE, LOG_SCALES, SAMPLE, STUDY, VALUE, require_scale, scale_of, tag_scale
from quantgrid.operators.checks import assert_empty
from quantgrid.session import materialise

FEATURE_KEY = [STUDY, FEATURE]


def combat(
    cells: DataFrame,
    samples: DataFrame,
    batch: str = "batch",
    min_variance: float = 1e-12,
    sample_mask: Column | None = None,
    tol: float = 1e-6,
) -> DataFrame:
    """Corrected cells with ``corrected`` telling which cells were touched.

    No covariate is protected. Features whose pooled variance is at most ``min_variance``
    pass through. With ``sample_mask`` only the masked samples are corrected, among
    themselves.
    """
    require_scale(cells, LOG_SCALES)
    samples = materialise(samples)  # its true size lets the joins with all cells broadcast it
    chosen = samples if sample_mask is None else samples.where(sample_mask)
    sizes = chosen.groupBy(STUDY, batch).agg(F.count(F.lit(1)).alias("n"))
    assert_empty(sizes.where(F.col("n") < 2), "batches with fewer than 2 samples")
    assert_empty(sizes.groupBy(STUDY).agg(F.count(F.lit(1)).alias("k")).where("k < 2"), "studies with one batch")

    labels = chosen.select(STUDY, SAMPLE, F.col(batch).alias("_batch"))
    known = cells.join(labels, [STUDY, SAMPLE])
    moments = known.groupBy(*FEATURE_KEY, "_batch").agg(
        F.count(VALUE).alias("n"), F.avg(VALUE).alias("mean"), F.var_samp(VALUE).alias("var")
    )
    pooled = moments.groupBy(*FEATURE_KEY).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        (F.sum(F.col("var") * (F.col("n") - 1)) / F.sum("n")).alias("pooled"),
        F.sum("n").alias("total"),
        # Variance over all samples decides what counts as constant.
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_m2"),
    ).withColumn(
        "spread",
        F.col("pooled") + F.greatest(F.col("_m2") / F.col("total") - F.col("grand") * F.col("grand"), F.lit(0.0)),
    )
    usable = (F.col("spread") > min_variance) & (F.col("pooled") > 0)
    stats = (
        moments.join(pooled, FEATURE_KEY)
        .where(usable)
        .withColumn("gamma", (F.col("mean") - F.col("grand")) / F.sqrt("pooled"))
        .withColumn("delta", F.col("var") / F.col("pooled"))
    )
    mean, var = F.avg("delta"), F.var_samp("delta")
    priors = materialise(
        stats.groupBy(STUDY, "_batch").agg(
            F.avg("gamma").alias("gamma_bar"),
            F.var_samp("gamma").alias("tau2"),
            F.try_divide(2 * var + mean * mean, var).alias("prior_a"),
            F.try_divide(mean * var + mean * mean * mean, var).alias("prior_b"),
        )
    )
    posterior = stats.join(priors, [STUDY, "_batch"]).withColumn(
        "_eb", _posterior(tol)(*[F.col(c) for c in ("n", "gamma", "delta", "gamma_bar", "tau2", "prior_a", "prior_b")])
    )
    adjust = posterior.select(*FEATURE_KEY, "_batch", "grand", "pooled", "_eb.gamma_star", "_eb.delta_star")
    z = (F.col(VALUE) - F.col("grand")) / F.sqrt("pooled")
    fixed = F.sqrt("pooled") * (z - F.col("gamma_star")) / F.sqrt("delta_star") + F.col("grand")
    out = (
        cells.join(labels, [STUDY, SAMPLE], "left")
        .join(adjust, [*FEATURE_KEY, "_batch"], "left")
        .withColumn("corrected", F.col("gamma_star").isNotNull() & F.col(VALUE).isNotNull())
        .withColumn(VALUE, F.when(F.col("corrected"), fixed).otherwise(F.col(VALUE)))
        .select(*CELL_KEY, VALUE, "corrected")
    )
    return tag_scale(out, scale_of(cells))


def passed_through(corrected: DataFrame) -> DataFrame:
    """Features that no cell of was corrected."""
    return corrected.groupBy(*FEATURE_KEY).agg(F.max("corrected").alias("c")).where("not c").drop("c")


def _posterior(tol: float):
    @F.pandas_udf("gamma_star double, delta_star double")
    def solve(
        n: pd.Series, g: pd.Series, d: pd.Series, bar: pd.Series, tau2: pd.Series, a: pd.Series, b: pd.Series
    ) -> pd.DataFrame:
        n, g, d, bar, tau2, a, b = (v.to_numpy(float) for v in (n, g, d, bar, tau2, a, b))
        g_star, d_star = g.copy(), d.copy()
        # A batch whose scale does not vary between features has no scale prior.
        fixed = ~np.isfinite(a)
        live = np.ones(len(g), bool)  # each row goes on until it has converged itself, whatever rows came with it
        for _ in range(10_000):
            g_new = (n * tau2 * g + d_star * bar) / (n * tau2 + d_star)
            around = (n - 1) * d + n * (g - g_new) ** 2
            with np.errstate(invalid="ignore"):
                d_new = (b + 0.5 * around) / (n / 2 + a - 1)
            d_new = np.where(fixed, d, d_new)
            with np.errstate(invalid="ignore", divide="ignore"):
                change = np.fmax(np.abs(g_new - g_star) / np.maximum(np.abs(g_star), 1e-12), np.abs(d_new - d_star) / np.maximum(d_star, 1e-12))
            g_star, d_star = np.where(live, g_new, g_star), np.where(live, d_new, d_star)
            live &= change >= tol
            if not live.any():
                break
        else:
            raise ValueError("a batch effect did not converge")
        return pd.DataFrame({"gamma_star": g_star, "delta_star": d_star})

    return solve
