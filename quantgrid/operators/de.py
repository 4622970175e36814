"""Differential abundance: linear models, moderated statistics, two-group tests."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.functions import pairwise, special, tails
from quantgrid.model import CELL_KEY, CheckFailed, FEATURE, LOG_SCALES, SAMPLE, STUDY, VALUE, require_scale
from quantgrid.operators.checks import assert_empty, check_unique
from quantgrid.operators.correlation import correlate
from quantgrid.operators.ranks import (
    benjamini_hochberg,
    equal_count_bins,
    group_median,
    group_quantiles,
    ks_uniform,
    top_per_group,
)
from quantgrid.session import materialise

FEATURE_KEY = [STUDY, FEATURE]
SAMPLE_KEY = [STUDY, SAMPLE]
MIN_FEATURES = 50
MIN_PAIRED_FEATURES = 3
VARIANCE_FLOOR = 1e-5
NEGATIVE_TOLERANCE = 1e-12
LOW_CARDINALITY = 5
D0_MAX = 1e6
SPLINE_STEPS = (3, 6, 30)


# --- design -------------------------------------------------------------------------

_DESIGN = (
    f"{STUDY} string, design_id string, {SAMPLE} string, "
    "proj array<double>, x array<double>"
)
_TERMS = (
    f"{STUDY} string, design_id string, term_index int, term string, column string, "
    "is_contrast boolean, inv_diag double, df int, low_cardinality boolean"
)


def _columns_of(sheet: pd.DataFrame, column: str, reference: Mapping[str, str], categorical: frozenset[str]):
    series = sheet[column]
    if column not in categorical and pd.api.types.is_numeric_dtype(series):
        values = series.to_numpy(float)
        if not np.isfinite(values).all():
            raise CheckFailed(f"{column!r} has missing or non-finite values")
        levels = np.unique(values).size
        if levels < 2:
            raise CheckFailed(f"{column!r} is constant")
        return [(column, values, levels <= LOW_CARDINALITY)]
    labels = series.astype(str).to_numpy()
    levels = sorted(set(labels))
    base = reference.get(column, levels[0])
    if len(levels) < 2 or base not in levels:
        raise CheckFailed(f"{column!r} needs two levels that include {base!r}; has {levels}")
    return [(f"{column}[{lv} vs {base}]", (labels == lv).astype(float), False) for lv in levels if lv != base]


def _solve(sheet: pd.DataFrame, contrast: str, covariates, reference, categorical):
    """Model matrix of one study, its projection and the terms."""
    named = [("intercept", "", False, np.ones(len(sheet)), False)]
    for column in (contrast, *covariates):
        for name, values, low in _columns_of(sheet, column, reference, categorical):
            named.append((name, column, column == contrast, values, low))
    x = np.column_stack([n[3] for n in named])
    df = len(x) - x.shape[1]
    if df <= 0:
        raise CheckFailed(f"{len(x)} samples cannot fit {x.shape[1]} parameters")
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise CheckFailed("the design is singular: drop a redundant term")
    inv = np.linalg.inv(x.T @ x)
    return x, x @ inv, np.diag(inv), df, named


def design(
    samples: DataFrame,
    contrast: str,
    covariates: Sequence[str] = (),
    reference: Mapping[str, str] | None = None,
    categorical: Sequence[str] = (),
    design_id: str = "design",
) -> tuple[DataFrame, DataFrame]:
    """Projection rows per sample and the term table per study.

    One small least-squares problem per study is solved by ``applyInPandas`` over that
    study's sample sheet. ``proj`` holds a sample's weight in each coefficient, ``x`` its
    model-matrix row. A sheet that already has a ``design_id`` column holds several
    designs, each solved on its own.
    """
    ref, cats, covs = dict(reference or {}), frozenset(categorical), tuple(covariates)
    if "design_id" not in samples.columns:
        samples = samples.withColumn("design_id", F.lit(design_id))
    sheet = samples.select(STUDY, "design_id", SAMPLE, *dict.fromkeys((contrast, *covs)))

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SAMPLE)
        x, proj, *_ = _solve(pdf, contrast, covs, ref, cats)
        return pd.DataFrame({STUDY: pdf[STUDY], "design_id": pdf["design_id"], SAMPLE: pdf[SAMPLE], "proj": list(proj), "x": list(x)})

    def terms(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, inv, df, named = _solve(pdf.sort_values(SAMPLE), contrast, covs, ref, cats)
        return pd.DataFrame({
            STUDY: pdf[STUDY].iloc[0], "design_id": pdf["design_id"].iloc[0], "term_index": range(len(named)),
            "term": [n[0] for n in named], "column": [n[1] for n in named], "is_contrast": [n[2] for n in named],
            "inv_diag": inv, "df": df, "low_cardinality": [n[4] for n in named],
        })

    grouped = sheet.groupBy(STUDY, "design_id")
    return materialise(grouped.applyInPandas(rows, _DESIGN)), materialise(grouped.applyInPandas(terms, _TERMS))


def design_within(
    samples: DataFrame,
    contrast: str,
    absorb: str,
    covariates: Sequence[str] = (),
    reference: Mapping[str, str] | None = None,
    categorical: Sequence[str] = (),
    design_id: str = "design",
) -> tuple[DataFrame, DataFrame]:
    """As ``design``, with the levels of ``absorb`` (pairs, say) swept out instead of given a column each.

    All other columns are centred within the levels; by the Frisch-Waugh-Lovell theorem their coefficients, standard errors and
    residuals are those of the full model. The projection has a column ``block`` with the level, and only as many
    weights as there are other terms, however many levels. A term that is constant within the levels fails the job.
    The intercept and the levels have no row among the terms; ``block_effects`` gives the levels' own means.
    """
    ref, cats, covs = dict(reference or {}), frozenset(categorical), tuple(c for c in covariates if c != absorb)
    if "design_id" not in samples.columns:
        samples = samples.withColumn("design_id", F.lit(design_id))
    sheet = samples.select(STUDY, "design_id", SAMPLE, F.col(absorb).cast("string").alias("block"), *dict.fromkeys((contrast, *covs)))

    def solve(pdf: pd.DataFrame):
        pdf = pdf.sort_values(SAMPLE)
        if pdf["block"].isna().any():
            raise CheckFailed(f"{absorb!r} has missing values")
        named = [(name, column, column == contrast, values, low) for column in (contrast, *covs) for name, values, low in _columns_of(pdf, column, ref, cats)]
        x = np.column_stack([n[3] for n in named])
        codes, levels = pd.factorize(pdf["block"])
        sizes = np.bincount(codes)
        within = x - np.stack([np.bincount(codes, x[:, j]) / sizes for j in range(x.shape[1])], axis=1)[codes]
        df = len(x) - len(levels) - x.shape[1]
        if df <= 0:
            raise CheckFailed(f"{len(x)} samples cannot fit {x.shape[1]} terms and {len(levels)} levels of {absorb!r}")
        normal = within.T @ within
        scale = np.sqrt(np.maximum(np.diag(normal), 1e-300))
        if (np.diag(normal) <= 1e-20 * np.maximum((x * x).sum(0), 1e-300)).any() or np.linalg.matrix_rank(normal / np.outer(scale, scale), tol=1e-10) < x.shape[1]:
            raise CheckFailed("the design is singular: drop a redundant term")
        inv = np.linalg.inv(normal)
        pad = np.zeros((len(x), 1))  # the place of the intercept
        return pdf, np.hstack([pad, within]), np.hstack([pad, within @ inv]), np.diag(inv), df, named

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, proj, *_ = solve(pdf)
        return pd.DataFrame({STUDY: pdf[STUDY], "design_id": pdf["design_id"], SAMPLE: pdf[SAMPLE], "proj": list(proj), "x": list(x), "block": pdf["block"]})

    def terms(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, _, inv, df, named = solve(pdf)
        return pd.DataFrame({
            STUDY: pdf[STUDY].iloc[0], "design_id": pdf["design_id"].iloc[0], "term_index": range(1, len(named) + 1),
            "term": [n[0] for n in named], "column": [n[1] for n in named], "is_contrast": [n[2] for n in named],
            "inv_diag": inv, "df": df, "low_cardinality": [n[4] for n in named],
        })

    grouped = sheet.groupBy(STUDY, "design_id")
    return materialise(grouped.applyInPandas(rows, f"{_DESIGN}, block string")), materialise(grouped.applyInPandas(terms, _TERMS))


def block_effects(cells: DataFrame, projection: DataFrame, fits: DataFrame) -> DataFrame:
    """``level_mean`` of each absorbed level, a row per feature and level: its mean value less the terms' part there.

    Terms are centred within the level, so that is the plain mean; the differences between levels of equal make-up are the full model's.
    """
    keys = [STUDY, "design_id", FEATURE]
    rows = cells.select(*CELL_KEY, VALUE).join(projection.select(STUDY, "design_id", SAMPLE, "block"), SAMPLE_KEY)
    means = rows.groupBy(*keys, "block").agg(F.avg(VALUE).alias("level_mean"), F.count(VALUE).alias("n"))
    return means.join(fits.select(*keys), keys, "left_semi")


def ols(cells: DataFrame, projection: DataFrame, n_terms: int | None = None) -> DataFrame:
    """Least squares per (study, design, feature): ``coef ARRAY, rss, mean_abundance, n``.

    With a ``block`` column in the projection (``design_within``), values are centred within its levels for the residuals.

    Cells are shuffled once, by feature: the coefficients are window sums over the
    feature's samples, the residuals are formed next to them, and the final aggregation
    keeps that partitioning. ``n_incomplete`` counts designs' samples without a value.
    """
    if n_terms is None:
        n_terms = projection.agg(F.max(F.size("proj"))).first()[0]
    rows = cells.select(*CELL_KEY, VALUE).join(projection, SAMPLE_KEY)
    keys = [STUDY, "design_id", FEATURE]
    w = Window.partitionBy(*keys)
    part = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    rows = rows.select("*", *[F.sum(part("proj", i) * F.col(VALUE)).over(w).alias(f"_b{i}") for i in range(n_terms)])
    fitted = reduce(Column.__add__, [part("x", i) * F.col(f"_b{i}") for i in range(n_terms)])
    level = F.avg(VALUE).over(Window.partitionBy(*keys, "block")) if "block" in projection.columns else F.lit(0.0)
    rows = rows.withColumn("_r", F.col(VALUE) - level - fitted)
    return rows.groupBy(*keys).agg(
        F.array(*[F.first(f"_b{i}") for i in range(n_terms)]).alias("coef"),
        F.sum(F.col("_r") * F.col("_r")).alias("rss"),
        F.avg(VALUE).alias("mean_abundance"),
        F.count(VALUE).alias("n"),
        F.count_if(F.col(VALUE).isNull()).alias("n_missing"),
    )


# --- empirical-Bayes prior ----------------------------------------------------------


def _prior_df(variance: str, df: str) -> Column:
    """Struct ``d0, log_shift`` from the spread of log variances, one row per group."""
    solve = F.pandas_udf(_solve_prior, "d0 double, log_shift double")
    return solve(F.col(variance), F.col(df).cast("double"))


def _solve_prior(variance: pd.Series, df: pd.Series) -> pd.DataFrame:
    v, df = variance.to_numpy(float), df.to_numpy(float)
    target = v - special.trigamma(df / 2)
    shift = np.log(df / 2) - special.digamma(df / 2)
    d0 = np.full(len(v), np.inf)
    some = (target > 0) & (special.trigamma(np.full(len(v), D0_MAX / 2)) <= target)
    if some.any():
        d0[some] = 2 * special.trigamma_inverse(target[some])
        shift[some] += special.digamma(d0[some] / 2) - np.log(d0[some] / 2)
    return pd.DataFrame({"d0": d0, "log_shift": shift})


def _log_variances(fits: DataFrame, by: Sequence[str], minimum: int) -> DataFrame:
    """Usable variances with ``_z = log(max(sigma2, floor))``; too few features fail the job."""
    usable = fits.where(F.col("sigma2").isNotNull() & ~F.isnan("sigma2") & (F.col("sigma2") > -NEGATIVE_TOLERANCE))
    usable = usable.withColumn("_s", F.greatest(F.col("sigma2"), F.lit(0.0)))
    stats = group_median(usable, by, "_s", "_med").join(usable.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")), list(by))
    small = materialise(stats)
    assert_empty(small.where(F.col("_m") < minimum), f"fewer than {minimum} features with a residual variance")
    assert_empty(small.where(F.col("_med") <= 0), "more than half of the residual variances are zero")
    joined = usable.join(small, list(by))
    floor = VARIANCE_FLOOR * F.col("_med")
    return joined.withColumn("_z", F.log(F.greatest("_s", floor))).withColumn("_floored", F.col("_s") < floor)


def eb_prior(fits: DataFrame, by: Sequence[str] = (STUDY, "design_id"), minimum: int = MIN_FEATURES) -> DataFrame:
    """``d0, s0_sq, n_features, n_floored`` per group, from ``sigma2`` and ``df``."""
    z = _log_variances(fits, by, minimum)
    moments = z.groupBy(*by).agg(
        F.avg("_z").alias("m"), F.var_samp("_z").alias("v"), F.first("df").alias("df"),
        F.count(F.lit(1)).alias("n_features"), F.count_if("_floored").alias("n_floored"),
    )
    solved = moments.withColumn("_p", _prior_df("v", "df"))
    return materialise(
        solved.select(*by, F.col("_p.d0").alias("d0"), F.exp(F.col("m") + F.col("_p.log_shift")).alias("s0_sq"), "n_features", "n_floored")
    )


def _spline_columns(u: Column, knots: Column, k: int) -> list[Column]:
    """Natural cubic basis 1, u, d_j - d_{K-1} with u and the knots on [0, 1].

    ``knots`` is an array of K values; studies with fewer knots give zero columns.
    """
    size = F.size(knots)
    cube = lambda v: F.when(v > 0, v * v * v).otherwise(0.0)
    last = F.get(knots, size - 1)

    def d(j: Column) -> Column:
        at = F.get(knots, j)
        return F.try_divide(cube(u - at) - cube(u - last), last - at)

    tail = d(size - 2)
    return [
        F.lit(1.0), u, *[F.when(size - 2 > j, d(F.lit(j)) - tail).otherwise(0.0) for j in range(k)]
    ]


def eb_prior_trend(fits: DataFrame, by: Sequence[str] = (STUDY, "design_id"), minimum: int = MIN_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Prior variance as a natural spline of mean abundance.

    Returns fits with ``s0_sq`` and ``d0`` and the per-group fit table. The normal
    equations are one aggregation; the small systems are solved per group.
    """
    by = list(by)
    z = _log_variances(fits, by, minimum)
    quant = group_quantiles(z, by, "mean_abundance", [0, 1 / 3, 0.5, 2 / 3, 1], ["k0", "k13", "k12", "k23", "k1"])
    distinct = z.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min("mean_abundance").alias("_a"), F.max("mean_abundance").alias("_b"),
                                  F.approx_count_distinct("mean_abundance", 0.05).alias("_dc"), F.first("df").alias("df"),
                                  F.count_if("_floored").alias("n_floored"))
    steps = reduce(Column.__add__, [(F.col("m") >= t).cast("int") for t in SPLINE_STEPS]) + 1
    # The sketch only has to tell 1, 2 and 3 distinct covariates from more.
    spline_df = F.least(steps, F.col("_dc").cast("int"))
    raw_knots = F.when(spline_df >= 4, F.array("k0", "k13", "k23", "k1")).when(spline_df == 3, F.array("k0", "k12", "k1")).otherwise(F.array("k0", "k1"))
    info = materialise(
        distinct.join(quant, by).withColumn("spline_df", spline_df).withColumn("knots", raw_knots)
        .select(*by, "m", "df", "n_floored", "spline_df", "knots", F.col("_a").alias("low"), (F.col("_b") - F.col("_a")).alias("width"))
    )
    assert_empty(info.where("width <= 0 or spline_df < 2"), "the trend covariate takes a single value")
    on_unit = lambda df: df.withColumn("_u", (F.col("mean_abundance") - F.col("low")) / F.col("width")).withColumn(
        "_k", F.transform("knots", lambda t: (t - F.col("low")) / F.col("width"))
    )
    names = ["_f0", "_f1", "_f2", "_f3"]
    with_basis = lambda df: df.select("*", *[c.alias(n) for c, n in zip(_spline_columns(F.col("_u"), F.col("_k"), 2), names)])
    points = with_basis(on_unit(z.drop("df").join(info, by)))
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    normal = points.groupBy(*by).agg(
        F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(n) * F.col("_z")) for n in names]).alias("xz"),
        F.first("spline_df").alias("p"),
    )

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xz: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(xx, xz, p):
            m = np.zeros((4, 4))
            for (i, j), v in zip(pairs, a):
                m[i, j] = m[j, i] = v
            k = int(k)
            beta = np.zeros(4)
            beta[:k] = np.linalg.lstsq(m[:k, :k], np.asarray(b, float)[:k], rcond=None)[0]
            out.append(beta)
        return pd.Series(out)

    coef = materialise(normal.select(*by, solve("xx", "xz", "p").alias("beta")))
    fitted = reduce(Column.__add__, [F.col(n) * F.col("beta")[i] for i, n in enumerate(names)])
    resid = points.join(coef, by).withColumn("_e", F.col("_z") - fitted)
    spread = resid.groupBy(*by).agg(
        (F.sum(F.col("_e") * F.col("_e")) / (F.count(F.lit(1)) - F.first("spline_df"))).alias("v"), F.first("df").alias("df")
    ).withColumn("_p", _prior_df("v", "df"))
    prior = materialise(spread.select(*by, F.col("_p.d0").alias("d0"), F.col("_p.log_shift").alias("log_shift")))
    summary = materialise(info.join(coef, by).join(prior, by))  # else its size is estimated as a product
    placed = with_basis(on_unit(fits.join(summary.drop("df", "m", "n_floored"), by)))
    out = placed.withColumn("s0_sq", F.exp(fitted + F.col("log_shift")))
    drop = [*names, "_u", "_k", "beta", "log_shift", "low", "width", "knots", "spline_df"]
    return out.drop(*drop), summary.select(*by, "d0", "spline_df", "knots", F.col("m").alias("n_features"), "n_floored")


# --- statistics ---------------------------------------------------------------------


def add_variance(fits: DataFrame, terms: DataFrame) -> DataFrame:
    """Residual variance and df joined to the fits."""
    per_design = terms.groupBy(STUDY, "design_id").agg(F.first("df").alias("df"), F.max("term_index").alias("_p"))
    return fits.join(per_design, [STUDY, "design_id"]).withColumn("sigma2", F.col("rss") / F.col("df")).drop("_p")


def moderate(fits: DataFrame, prior: DataFrame, by: Sequence[str] = (STUDY, "design_id")) -> DataFrame:
    """Posterior variance ``var_post`` and ``df_total``; without a prior they are the fit's own."""
    joined = fits.join(prior.select(*by, "d0", "s0_sq"), list(by)) if prior is not None else fits
    return with_posterior(joined)


def with_posterior(fits: DataFrame) -> DataFrame:
    if "d0" not in fits.columns:
        return fits.withColumn("var_post", F.col("sigma2")).withColumn("df_total", F.col("df").cast("double"))
    endless = F.col("d0") == float("inf")
    shrunk = (F.col("d0") * F.col("s0_sq") + F.col("df") * F.col("sigma2")) / (F.col("d0") + F.col("df"))
    return fits.withColumn("var_post", F.when(endless, F.col("s0_sq")).otherwise(shrunk)).withColumn(
        "df_total", F.when(endless, F.lit(float("inf"))).otherwise(F.col("d0") + F.col("df"))
    )


def t_statistics(df: DataFrame, effect: str, se: Column, dof: Column, alpha: float = 0.05) -> DataFrame:
    """Add ``se, t, p, ci_low, ci_high``; a standard error of 0 makes the row untestable."""
    out = df.withColumn("se", F.when(se > 0, se)).withColumn("_df", dof)
    out = out.withColumn("t", F.col(effect) / F.col("se"))
    out = out.withColumn("p", tails.t_two_sided(F.col("t"), F.col("_df"))).withColumn(
        "_c", tails.t_critical(F.col("_df"), alpha)
    )
    half = F.col("_c") * F.col("se")
    return out.withColumn("ci_low", F.col(effect) - half).withColumn("ci_high", F.col(effect) + half).drop("_c", "_df")


def term_table(fits: DataFrame, terms: DataFrame, alpha: float = 0.05, adjust: bool = True) -> DataFrame:
    """One row per feature and term with t, p, CI and q (q within study, design and term)."""
    use = terms.where(F.col("term_index") > 0).select(STUDY, "design_id", "term_index", "term", "is_contrast", "inv_diag")
    long = fits.join(use, [STUDY, "design_id"]).withColumn("effect", F.get("coef", F.col("term_index")))
    table = t_statistics(long, "effect", F.sqrt(F.col("var_post") * F.col("inv_diag")), F.col("df_total"), alpha)
    cols = [STUDY, "design_id", FEATURE, "term", "is_contrast", "effect", "se", "t", "p", "ci_low", "ci_high", "mean_abundance",
            F.sqrt(F.greatest(F.col("sigma2"), F.lit(0.0))).alias("sigma"), "df_total", "n"]
    extra = [F.sqrt("s0_sq").alias("prior_sd")] if "s0_sq" in long.columns else []
    # The tails run in Python; written once, they are not evaluated again by every reader.
    table = materialise(table.select(*cols, *extra))
    return materialise(benjamini_hochberg(table, "p", [STUDY, "design_id", "term"])) if adjust else table


def welch(cells: DataFrame, samples: DataFrame, contrast: str, reference: str, alpha: float = 0.05) -> DataFrame:
    """Welch t of every level against the reference, per feature."""
    t = _two_group_moments(cells, samples, contrast, reference)
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    dof = F.try_divide(F.pow(a + b, 2), F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n0") - 1))
    t = t.withColumn("effect", F.col("m1") - F.col("m0")).withColumn("df_total", dof)
    out = t_statistics(t, "effect", F.when(dof.isNotNull(), F.sqrt(a + b)), F.col("df_total"), alpha)
    return _finish_two_group(out)


def _two_group_rows(cells: DataFrame, samples: DataFrame, contrast: str, reference: str) -> DataFrame:
    """Cells once per comparison they take part in: a level's own, the reference's all."""
    require_levels(samples, contrast, reference)
    levels = samples.select(STUDY, F.col(contrast).cast("string").alias("level")).distinct().where(F.col("level") != reference)
    tagged = samples.select(*SAMPLE_KEY, F.col(contrast).cast("string").alias("_l"))
    own = tagged.where(F.col("_l") != reference).select(*SAMPLE_KEY, F.col("_l").alias("level"), F.lit(1).alias("arm"))
    base = tagged.where(F.col("_l") == reference).join(levels, STUDY).select(*SAMPLE_KEY, "level", F.lit(0).alias("arm"))
    arms = materialise(own.unionByName(base))
    term = F.concat(F.lit(f"{contrast}["), "level", F.lit(f" vs {reference}]"))
    return cells.select(*CELL_KEY, VALUE).join(arms, SAMPLE_KEY).withColumn("term", term)


def require_levels(samples: DataFrame, contrast: str, reference: str) -> None:
    sizes = samples.groupBy(STUDY, F.col(contrast).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    assert_empty(sizes.where("n < 2"), f"levels of {contrast} with fewer than 2 samples")
    known = sizes.groupBy(STUDY).agg(F.count_if(F.col("level") == reference).alias("k"), F.count(F.lit(1)).alias("m"))
    assert_empty(known.where("k = 0 or m < 2"), f"studies without {reference!r} and another level of {contrast}")


def _two_group_moments(cells: DataFrame, samples: DataFrame, contrast: str, reference: str) -> DataFrame:
    rows = _two_group_rows(cells, samples, contrast, reference)
    arm = lambda a: F.when(F.col("arm") == a, F.col(VALUE))
    return rows.groupBy(*FEATURE_KEY, "term").agg(
        *[f(arm(a)).alias(f"{n}{a}") for a in (1, 0) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))],
        F.avg(VALUE).alias("mean_abundance"),
        F.count(VALUE).alias("n"),
    )


def _finish_two_group(table: DataFrame) -> DataFrame:
    stat = [c for c in ("t", "u") if c in table.columns]
    cols = [STUDY, F.lit("two-group").alias("design_id"), FEATURE, "term", F.lit(True).alias("is_contrast"), "effect", "se", *stat,
            "p", "ci_low", "ci_high", "mean_abundance", "n"]
    return materialise(benjamini_hochberg(materialise(table.select(*cols)), "p", [STUDY, "term"]))


def _shift_statistics(x: Column, y: Column, k: Column) -> Column:
    """Struct ``u, _ties, effect, ci_low, ci_high`` of two sorted arms; null without values, ends null where k < 0."""

    @F.pandas_udf("u double, _ties double, effect double, ci_low double, ci_high double")
    def select(xs: pd.Series, ys: pd.Series, ks: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(xs, ys, ks, strict=True):
            a, b = np.asarray(a, float), np.asarray(b, float)
            size = len(a) * len(b)
            if not size:
                out.append((None,) * 5)
                continue
            ends = [c, size - 1 - c] if c >= 0 else []
            d = pairwise.kth_differences(a, b, [(size - 1) // 2, size // 2, *ends])
            both = np.sort(np.concatenate([a, b]))
            out.append((pairwise.u_statistic(a, b), pairwise.tie_sum(both), (d[0] + d[1]) / 2, *(d[2:] or (None, None))))
        return pd.DataFrame(out, columns=["u", "_ties", "effect", "ci_low", "ci_high"], dtype=float)

    return select(x, y, k)


def mannwhitney(cells: DataFrame, samples: DataFrame, contrast: str, reference: str, alpha: float = 0.05) -> DataFrame:
    """Mann-Whitney U per feature with the Hodges-Lehmann shift and its rank interval.

    An arm is an array bounded by the number of samples; its differences to the other arm are selected from, not formed
    (``functions.pairwise``), so hundreds of samples an arm cost no more than sorting them a few times. p is exact when an arm has at
    most 8 samples and no feature of the study has ties, otherwise the tie-corrected normal.
    The interval is NULL when its rank falls below the first difference.
    """
    rows = _two_group_rows(cells, samples, contrast, reference)
    arm = lambda a: F.array_sort(F.collect_list(F.when(F.col("arm") == a, F.col(VALUE).cast("double"))))
    arms = rows.groupBy(*FEATURE_KEY, "term").agg(arm(1).alias("x"), arm(0).alias("y"), F.avg(VALUE).alias("mean_abundance"), F.count(VALUE).alias("n"))
    m = F.size("x") * F.size("y")
    k = F.floor(m / 2 - tails.norm_critical(alpha) * F.sqrt(m * (F.size("x") + F.size("y") + 1) / 12.0)).cast("int")
    table = arms.withColumns({"n1": F.size("x"), "n0": F.size("y"), "_k": k})
    # Written once: the selection runs in Python, and its results are read twice.
    table = materialise(table.withColumn("_s", _shift_statistics(F.col("x"), F.col("y"), F.col("_k"))).drop("x", "y").select("*", "_s.*").drop("_s"))
    any_ties = materialise(table.groupBy(STUDY).agg(F.max(F.col("_ties") > 0).alias("_tied")))
    table = table.join(any_ties, STUDY)
    exact = (F.least("n1", "n0") <= 8) & ~F.col("_tied")
    table = table.withColumns({"p": tails.mann_whitney_p(F.col("u"), F.col("n1"), F.col("n0"), F.col("_ties"), exact), "se": F.lit(None).cast("double")})
    return _finish_two_group(table)


def two_group(cells: DataFrame, samples: DataFrame, contrast: str, reference: str, method: str, alpha: float = 0.05) -> DataFrame:
    """Every level of ``contrast`` against the reference by ``welch`` or ``mannwhitney``."""
    return {"welch": welch, "mannwhitney": mannwhitney}[method](cells, samples, contrast, reference, alpha)


def differential_abundance(
    cells: DataFrame,
    samples: DataFrame,
    contrast: str,
    covariates: Sequence[str] = (),
    reference: Mapping[str, str] | None = None,
    method: str = "moderated",
    categorical: Sequence[str] = (),
    alpha: float = 0.05,
    trend: bool = False,
    design_id: str = "design",
    absorb: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Test every feature across ``contrast``; returns the long result and ``fit_info``.

    ``absorb`` names a covariate of many levels, such as pairs, that is swept out: the same results for
    all other terms, without a column for each level. ``method`` is ``moderated``, ``ols``, ``welch`` or ``mannwhitney``. Cells must be on a
    log scale and complete over the given samples.
    """
    if method not in ("moderated", "ols", "welch", "mannwhitney"):
        raise ValueError(f"unknown method {method!r}")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")
    if trend and method != "moderated":
        raise ValueError("trend applies to method='moderated' only")
    require_scale(cells, LOG_SCALES)
    if method in ("welch", "mannwhitney"):
        if covariates or absorb:
            raise ValueError(f"{method} cannot adjust for covariates")
        if dict(samples.dtypes)[contrast] != "string" and contrast not in categorical:
            raise ValueError(f"{contrast!r} is numeric; declare it categorical for a two-group test")
        base = (reference or {}).get(contrast) or samples.agg(F.min(F.col(contrast).cast("string"))).first()[0]
        table = two_group(cells, samples, contrast, base, method, alpha)
        return table, table.groupBy(STUDY, "term").agg(F.count("p").alias("n_features"), F.max("n").alias("n_samples"))
    if absorb:
        projection, terms = design_within(samples, contrast, absorb, covariates, reference, categorical, design_id)
    else:
        projection, terms = design(samples, contrast, covariates, reference, categorical, design_id)
    if terms.where("low_cardinality").take(1):
        warnings.warn("a numeric column with few distinct values is fitted as a slope", stacklevel=2)
    fits = materialise(add_variance(ols(cells, projection), terms))
    table, info = _finish(fits, terms, method == "moderated", trend, alpha)
    sizes = projection.groupBy(STUDY, "design_id").agg(F.count(F.lit(1)).alias("n_samples"))
    dfs = terms.groupBy(STUDY, "design_id").agg(F.first("df").alias("residual_df"))
    incomplete = fits.join(sizes, [STUDY, "design_id"]).where(F.col("n") != F.col("n_samples"))
    whole = incomplete.groupBy(STUDY, "design_id").agg(F.count(F.lit(1)).alias("n_incomplete_features"))
    info = info.join(dfs, [STUDY, "design_id"]).join(sizes, [STUDY, "design_id"]).join(whole, [STUDY, "design_id"], "left")
    return table, info.na.fill(0, ["n_incomplete_features"])


def _finish(fits: DataFrame, terms: DataFrame, moderated: bool, trend: bool, alpha: float) -> tuple[DataFrame, DataFrame]:
    if not moderated:
        info = terms.select(STUDY, "design_id").distinct().withColumn("d0", F.lit(None).cast("double")).withColumn("s0_sq", F.lit(None).cast("double"))
        return term_table(with_posterior(fits), terms, alpha), info
    if trend:
        with_prior, info = eb_prior_trend(fits)
        return term_table(with_posterior(with_prior), terms, alpha), info
    prior = eb_prior(fits)
    return term_table(moderate(fits, prior), terms, alpha), prior


# --- result tables ------------------------------------------------------------------


def contrast_table(table: DataFrame, annotations: DataFrame) -> DataFrame:
    """Contrast rows with feature annotations; the join must be one to one."""
    assert_empty(check_unique(annotations, FEATURE_KEY), "repeated annotations")
    rows = table.where("is_contrast")
    out = rows.join(annotations.withColumn("_in", F.lit(True)), FEATURE_KEY, "left")
    checked = F.when(F.col("_in"), F.col(FEATURE)).otherwise(F.raise_error(F.lit("feature without annotation")).cast("string"))
    return out.withColumn(FEATURE, checked).drop("_in")


def hits(table: DataFrame, thresholds: Sequence[float] = (0.05, 0.1, 0.2), by: Sequence[str] = (STUDY,), q: str = "q", effect: str = "effect") -> DataFrame:
    """Hits strictly below each q threshold, split by direction."""
    long = table.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.col(q) < F.col("threshold")
    return long.groupBy(*by, "threshold").agg(
        F.count_if(hit).alias("n_hits"), F.count_if(hit & (F.col(effect) > 0)).alias("n_up"), F.count_if(hit & (F.col(effect) < 0)).alias("n_down")
    )


def pi0(table: DataFrame, by: Sequence[str] = (STUDY,), lam: float = 0.5, p: str = "p") -> DataFrame:
    """Storey's estimate of the null share at a fixed lambda, raw and at most 1."""
    raw = F.try_divide(F.count_if(F.col(p) > lam), F.count(p) * (1 - lam))
    return table.groupBy(*by).agg(F.count(p).alias("n"), raw.alias("pi0_raw"), F.least(raw, F.lit(1.0)).alias("pi0"))


def p_bin(p: Column, bins: int = 20) -> Column:
    """0-based histogram bin on [0, 1], the last closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def calibration(table: DataFrame, by: Sequence[str] = (STUDY,), p: str = "p", bins: int = 20, z: float = 3.0) -> DataFrame:
    """Read of the p-value histogram against the uniform law.

    Densities of the first bin, the low quarter and the last two bins are flagged beyond
    ``z`` binomial SDs (of that many bins); ``ks_distance`` is descriptive.
    """
    by = list(by)
    b = p_bin(F.col(p), bins)
    counts = table.where(F.col(p).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("m"), *[F.count_if(b == i).alias(f"_c{i}") for i in range(bins)]
    )
    dens = [F.col(f"_c{i}") * bins / F.col("m") for i in range(bins)]
    sd = F.sqrt(F.lit((1 - 1 / bins) * bins) / F.col("m"))
    low = bins // 4
    mean = lambda cols: reduce(Column.__add__, cols) / len(cols)
    flag = lambda v, k: F.when(v > 1 + z * sd / math.sqrt(k), "high").when(v < 1 - z * sd / math.sqrt(k), "low").otherwise("uniform")
    first, quarter, top = dens[0], mean(dens[:low]), mean(dens[-2:])
    read = counts.select(
        *by, "m", first.alias("density_first_bin"), quarter.alias("density_low_quarter"), top.alias("density_top"), sd.alias("bin_sd"),
        flag(first, 1).alias("flag_first_bin"), flag(quarter, low).alias("flag_low_quarter"), flag(top, 2).alias("flag_top"),
        F.array(*dens).alias("densities"),
    )
    return read.join(ks_uniform(table, p, by).drop("n"), by)


def design_summary(table: DataFrame, info: DataFrame, by: Sequence[str] = (STUDY, "design_id")) -> DataFrame:
    """One row per study and design: fit scalars, hits, pi0 and medians."""
    by = list(by)
    rows = table.where("is_contrast").withColumn("ci_half", (F.col("ci_high") - F.col("ci_low")) / 2)
    base = rows.groupBy(*by).agg(
        F.count("p").alias("n_tested"), F.avg((F.col("effect") > 0).cast("double")).alias("share_positive"),
        *[F.count_if(F.col("q") < t).alias(f"hits_q{int(t * 100):02d}") for t in (0.05, 0.1, 0.2)],
    )
    for column, name in (("effect", "median_effect"), ("sigma", "median_sigma"), ("se", "median_se"), ("ci_half", "median_ci_half")):
        base = base.join(group_median(rows, by, column, name), by)
    return base.join(pi0(rows, by).drop("n"), by).join(info, by)


def concordance(a: DataFrame, b: DataFrame, by: Sequence[str] = (STUDY,), threshold: float = 0.1) -> DataFrame:
    """Agreement of two result tables over the same features."""
    cols = ["effect", "t", "p", "q"]
    side = lambda df, s: df.select(*by, FEATURE, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    both = materialise(side(a, "a").join(side(b, "b"), [*by, FEATURE]))
    ha, hb = F.coalesce(F.col("q_a") < threshold, F.lit(False)), F.coalesce(F.col("q_b") < threshold, F.lit(False))
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.max(F.abs(F.col("effect_a") - F.col("effect_b"))).alias("max_abs_effect_diff"),
        F.count_if(ha).alias("hits_a"), F.count_if(hb).alias("hits_b"), F.count_if(ha & hb).alias("hits_both"),
        F.try_divide(F.count_if(ha & hb), F.count_if(ha | hb)).alias("jaccard"),
    )
    for c in cols[:3]:
        r = correlate(both, f"{c}_a", f"{c}_b", by, "spearman").select(*by, F.col("r").alias(f"spearman_{c}"))
        out = out.join(r, list(by))
    return out


def common_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Wide table over features every quantity has, one column block per quantity."""
    blocks = [
        df.select(*FEATURE_KEY, *[F.col(c).alias(f"{name}_{c}") for c in ("effect", "se", "t", "p", "q", "sigma")])
        for name, df in tables.items()
    ]
    return reduce(lambda x, y: x.join(y, FEATURE_KEY), blocks)


def trend_table(trend: DataFrame, plain: DataFrame, thresholds: Sequence[float] = (0.05, 0.1)) -> DataFrame:
    """Trend and constant-prior results side by side with the hit flags of both."""
    keys = [STUDY, "design_id", FEATURE, "term"]
    other = plain.select(*keys, *[F.col(c).alias(f"plain_{c}") for c in ("se", "t", "p", "q")])
    joined = materialise(trend.join(other, keys))
    flags = {}
    for t in thresholds:
        tag = f"q{int(t * 100):02d}"
        flags[f"hit_{tag}_trend"] = F.coalesce(F.col("q") < t, F.lit(False))
        flags[f"hit_{tag}_plain"] = F.coalesce(F.col("plain_q") < t, F.lit(False))
    return joined.withColumns(flags)


def hit_changes(joined: DataFrame, by: Sequence[str] = (STUDY,), thresholds: Sequence[float] = (0.05, 0.1)) -> DataFrame:
    """Features that enter or leave the hit set under the trend prior."""
    parts = []
    for t in thresholds:
        tag = f"q{int(t * 100):02d}"
        a, b = F.col(f"hit_{tag}_trend"), F.col(f"hit_{tag}_plain")
        parts.append(joined.groupBy(*by).agg(
            F.lit(float(t)).alias("threshold"), F.count_if(a).alias("n_trend"), F.count_if(b).alias("n_plain"),
            F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("n_gained"), F.count_if(~a & b).alias("n_lost"),
        ))
    return reduce(DataFrame.unionByName, parts)


def value_quantile_bins(df: DataFrame, by: Sequence[str], x: str, bins: int, name: str = "bin") -> DataFrame:
    """0-based bins between value quantiles, right-closed, the lowest value included."""
    inner = [i / bins for i in range(1, bins)]
    names = [f"_e{i}" for i in range(1, bins)]
    edges = materialise(group_quantiles(df, by, x, inner, names))
    above = reduce(Column.__add__, [(F.col(x) > F.col(n)).cast("int") for n in names])
    return df.join(edges, list(by)).withColumn(name, above).drop(*names)


def se_ratio(joined: DataFrame, by: Sequence[str] = (STUDY,), bins: int = 3) -> DataFrame:
    """Median trend / constant-prior standard-error ratio by abundance tertile."""
    b = value_quantile_bins(joined, by, "mean_abundance", bins, "tertile").withColumn("_ratio", F.col("se") / F.col("plain_se"))
    keys = [*by, "tertile"]
    ends = b.groupBy(*keys).agg(
        F.min("mean_abundance").alias("low"), F.max("mean_abundance").alias("high"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("q") < 0.1).alias("n_hits_trend"), F.count_if(F.col("plain_q") < 0.1).alias("n_hits_plain"),
    )
    return ends.join(group_median(b, keys, "_ratio", "median_se_ratio"), keys)


def trend_block(joined: DataFrame, by: Sequence[str] = (STUDY,)) -> DataFrame:
    """Summary of a trend fit beside its constant-prior fit."""
    by = list(by)
    base = joined.groupBy(*by).agg(
        F.count("p").alias("n_tested"), F.min("prior_sd").alias("prior_sd_min"), F.max("prior_sd").alias("prior_sd_max")
    ).join(group_median(joined, by, "prior_sd", "prior_sd_median"), by)
    for x, y, name in (("prior_sd", "mean_abundance", "spearman_prior_abundance"), ("p", "plain_p", "spearman_p"), ("t", "plain_t", "spearman_t")):
        base = base.join(correlate(joined, x, y, by, "spearman").select(*by, F.col("r").alias(name)), by)
    base = base.join(pi0(joined, by).select(*by, F.col("pi0").alias("pi0_trend")), by)
    base = base.join(pi0(joined, by, p="plain_p").select(*by, F.col("pi0").alias("pi0_plain")), by)
    for column in ("se", "plain_se"):
        base = base.join(group_median(joined, by, column, f"median_{column}"), by)
    return base


def top_n(table: DataFrame, n: int, by: Sequence[str] = (STUDY,)) -> DataFrame:
    """The n rows of smallest q, then p, then feature id in each group."""
    order = [F.col("q").asc_nulls_last(), F.col("p").asc_nulls_last(), F.col(FEATURE)]
    return top_per_group(table, by, order, n, FEATURE, "place")


def pair_rows(cells: DataFrame, roles: DataFrame, ratio: bool = False) -> DataFrame:
    """Control, treated and their difference (or log2 ratio) per feature and pair."""
    arm = lambda t: F.max(F.when(F.col("treated") == t, F.col(VALUE)))
    pairs = cells.select(*CELL_KEY, VALUE).join(roles, SAMPLE_KEY).groupBy(*FEATURE_KEY, "pair_id").agg(
        arm(False).alias("control"), arm(True).alias("treated_value"), F.min("batch").alias("batch")
    )
    positive = (F.col("control") > 0) & (F.col("treated_value") > 0)
    diff = F.when(positive, F.log2(F.try_divide(F.col("treated_value"), F.col("control")))) if ratio else F.col("treated_value") - F.col("control")
    return pairs.withColumn("difference", diff)


def pair_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*FEATURE_KEY).agg(
        F.count("difference").alias("n_pairs"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("sd_difference"),
        F.min("difference").alias("min_difference"), F.max("difference").alias("max_difference"),
    )


def direction_tally(rows: DataFrame, by: Sequence[str] = (STUDY, FEATURE)) -> DataFrame:
    """Pairs that go up, down or stay, per group."""
    d = F.col("difference")
    return rows.groupBy(*by).agg(F.count_if(d > 0).alias("n_up"), F.count_if(d < 0).alias("n_down"), F.count_if(d == 0).alias("n_tie"))


def volcano_table(table: DataFrame, threshold: float = 0.05, min_effect: float = 0.0, label_top: int = 10, by: Sequence[str] = (STUDY,)) -> DataFrame:
    """Significance bucket per feature and the label rank of the strongest ``label_top``."""
    hit = F.coalesce((F.col("q") < threshold) & (F.abs("effect") >= min_effect), F.lit(False))
    bucket = F.when(hit & (F.col("effect") > 0), "up").when(hit & (F.col("effect") < 0), "down").otherwise("NS")
    best = top_n(table.where(F.col("p").isNotNull()), label_top, by).select(*by, FEATURE, F.col("place").alias("label_rank"))
    out = table.withColumn("bucket", bucket).withColumn("neg_log10_p", -F.log10(F.when(F.col("p") > 0, F.col("p"))))
    return out.join(best, [*by, FEATURE], "left")


def pvalue_by_tercile(table: DataFrame, by: Sequence[str] = (STUDY,), bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """p-value histogram and pi0 within equal-count abundance terciles."""
    tested = table.where(F.col("p").isNotNull())
    t = equal_count_bins(tested, by, "mean_abundance", [FEATURE], 3, "tercile")
    hist = t.groupBy(*by, "tercile", p_bin(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return hist, pi0(t, [*by, "tercile"])


def sd_hist(table: DataFrame, width: float = 0.05, by: Sequence[str] = (STUDY, "design_id")) -> DataFrame:
    """Histogram of residual SDs per design in bins of a fixed width."""
    return table.where("sigma is not null").groupBy(*by, F.floor(F.col("sigma") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def precision(tables: Mapping[str, DataFrame], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """Residual SD and interval width per quantity on the common features, with the SD trend."""
    from quantgrid.operators.missing import common_set
    from quantgrid.operators.qc import ntile_median

    shared = common_set([t for t in tables.values()])
    rows = reduce(DataFrame.unionByName, [
        df.join(shared, FEATURE_KEY, "left_semi").select(
            F.lit(name).alias("quantity"), *FEATURE_KEY, "sigma", ((F.col("ci_high") - F.col("ci_low")) / 2).alias("ci_half"), "mean_abundance"
        )
        for name, df in tables.items()
    ])
    keys = ["quantity", STUDY]
    summary = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features"))
    summary = summary.join(group_median(rows, keys, "sigma", "median_sigma"), keys).join(group_median(rows, keys, "ci_half", "median_ci_half"), keys)
    rho = correlate(rows, "sigma", "mean_abundance", keys, "spearman").select(*keys, F.col("r").alias("spearman_sigma_abundance"))
    return summary.join(rho, keys), ntile_median(rows, keys, "mean_abundance", "sigma", bins)


def display_label(features: DataFrame, members: str = "members", sequence: str = "base_sequence", mass: str = "total_mod_mass", longest: int = 12) -> DataFrame:
    """Text labels: first member with ``+k`` for further ones, or an abbreviated sequence.

    A modified sequence gets its mass only where the base sequence occurs in several
    features.
    """
    out = features
    if members in features.columns:
        parts = F.split(members, ";")
        more = F.size(parts) - 1
        out = out.withColumn("member_label", F.concat(parts[0], F.when(more > 0, F.concat(F.lit(" +"), more)).otherwise("")))
    if sequence in features.columns:
        short = F.when(F.length(sequence) > longest, F.concat(F.substring(sequence, 1, longest - 3), F.lit("..."))).otherwise(F.col(sequence))
        forms = features.groupBy(STUDY, sequence).agg(F.count(F.lit(1)).alias("_forms"))
        suffix = F.when(F.col("_forms") > 1, F.concat(F.lit(" [+"), F.format_number(F.col(mass), 2), F.lit("]"))).otherwise("")
        out = out.join(forms, [STUDY, sequence]).withColumn("sequence_label", F.concat(short, suffix)).drop("_forms")
    return out
