"""Normalisation between samples and changes of scale."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.model import CELL_KEY, FEATURE, LOG_SCALES, SAMPLE, STUDY, VALUE, require_scale, scale_of, tag_scale
from quantgrid.operators.matrix import PackedCells, packed_features, with_sample_values
from quantgrid.operators.ranks import group_median
from quantgrid.session import materialise

SAMPLE_KEY = [STUDY, SAMPLE]
MAD_CONSISTENCY = 1.4826
LIKELIHOOD_GAIN = 1e-5


def require_complete(cells: DataFrame) -> DataFrame:
    """Cells without a value (violations)."""
    return cells.where(F.col(VALUE).isNull())


def median_factors(cells: DataFrame) -> DataFrame:
    """Per-sample factor: mean of the study's sample medians over the sample's own."""
    medians = group_median(cells, SAMPLE_KEY, VALUE)
    target = F.avg("median").over(Window.partitionBy(STUDY))
    return medians.withColumn("factor", F.try_divide(target, F.col("median")))


def normalize(cells: DataFrame, method: str = "median", **options) -> DataFrame:
    """``median`` (linear), ``mad`` (z-scores of log2(x + 1)) or ``vsn`` (glog2)."""
    require_scale(cells, "linear")
    if method == "median":
        factors = materialise(median_factors(cells).select(*SAMPLE_KEY, "factor"))
        out = cells.join(factors, SAMPLE_KEY).withColumn(VALUE, F.col(VALUE) * F.col("factor")).drop("factor")
        return tag_scale(out, "linear")
    if method == "mad":
        logged = cells.withColumn(VALUE, F.log2(F.col(VALUE) + 1))
        medians = materialise(group_median(logged, SAMPLE_KEY, VALUE, "_med"))
        dev = logged.join(medians, SAMPLE_KEY).withColumn("_dev", F.abs(F.col(VALUE) - F.col("_med")))
        mads = materialise(group_median(dev, SAMPLE_KEY, "_dev", "_mad"))
        z = F.try_divide(F.col(VALUE) - F.col("_med"), F.col("_mad") * MAD_CONSISTENCY)
        out = dev.join(mads, SAMPLE_KEY).withColumn(VALUE, z).drop("_med", "_dev", "_mad")
        return tag_scale(out, "zscore")
    if method == "vsn":
        return apply_vsn(cells, fit_vsn(cells, **options))
    raise ValueError(f"unknown method {method!r}")


def fit_vsn(cells: DataFrame, max_rounds: int = 25, tol: float = 1e-6) -> DataFrame:
    """Maximum-likelihood offset and log factor per sample: ``a, log_b``.

    The transform is arsinh(a + b x) with a common residual variance per study. Features are packed in rows once, so a round
    is one aggregation without a shuffle of cells: the profile likelihood's gradient and a 2 x 2
    Gauss-Newton block per sample. The parameter table has one row per sample; it is
    written out each round, so lineage stays flat. A step that lowers a study's likelihood
    is taken back and halved. A study leaves the rounds once no parameter of it moves by ``tol``; ``converged`` is
    false for one that still moved in the last of ``max_rounds``.
    """
    packed, places = packed_features(cells.where(F.col(VALUE).isNotNull()), VALUE)
    # Each sample starts with its mean at 1 on the arsinh axis.
    means = packed.select(STUDY, F.explode(F.arrays_zip("p", "v")).alias("_c")).groupBy(STUDY, F.col("_c.p").alias("p")).agg(F.avg("_c.v").alias("_mean"))
    params = materialise(
        places.join(means, [STUDY, "p"]).select(*SAMPLE_KEY, "p",
            F.lit(0.0).alias("a"), (-F.log("_mean")).alias("log_b")
        ).select("*", F.lit(1.0).alias("damp"), F.lit(None).cast("double").alias("best"),
                 F.col("a").alias("a0"), F.col("log_b").alias("log_b0"), F.lit(None).cast("double").alias("moved"), F.lit(True).alias("on"))
    )
    still = F.coalesce(F.max("moved").over(Window.partitionBy(STUDY)) >= tol, F.lit(True))
    for _ in range(max_rounds):
        fresh = _vsn_round(packed, params.where("on").drop("on")).withColumn("on", still)
        params = materialise(fresh.unionByName(params.where("not on")))
        if not params.where("on").take(1):
            break
    return params.select(*SAMPLE_KEY, F.col("a0").alias("a"), F.col("log_b0").alias("log_b"), (~F.col("on")).alias("converged"))


_SUMS = ("m", "rss", "jac", "ra", "rb", "ja", "jb", "saa", "sab", "sbb", "j11", "j12", "j22", "c11", "c12", "c22")


def _vsn_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a batch's features, a row a sample; cells of a sample without a factor (null) are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = PackedCells(batch)
        keep = ~np.isnan(cells.s["log_b"])
        v, a, log_b, row, code = (x[keep] for x in (cells.v, cells.s["a"], cells.s["log_b"], cells.row, cells.code))
        n = np.maximum(np.bincount(row, minlength=batch.num_rows), 1)
        rest = lambda x: x - (np.bincount(row, x, len(n)) / n)[row]  # noqa: E731, B023
        bx = np.exp(log_b) * v
        z = a + bx
        inv2 = 1 / (1 + z * z)
        ga = np.sqrt(inv2)
        gb, k, zg = bx * ga, (1 - z * z) * inv2 * inv2, z * ga * ga
        r, ca, cb = rest(np.arcsinh(z)), rest(ga), rest(gb)
        terms = (np.ones(len(z)), r * r, log_b + np.log(ga), r * ga, r * gb, zg, 1 - zg * bx, ga * ga, ga * gb, gb * gb,
                 k, bx * k, bx * bx * k + zg * bx, ca * ca, ca * cb, cb * cb)
        seen = np.flatnonzero(np.bincount(code))
        yield pa.RecordBatch.from_arrays([*cells.named(seen), *[pa.array(np.bincount(code, t)[seen]) for t in terms]], names=[STUDY, "p", *_SUMS])


def _vsn_round(packed: DataFrame, params: DataFrame) -> DataFrame:
    cells = with_sample_values(packed, params, ["a", "log_b"])
    parts = cells.mapInArrow(_vsn_sums, f"{STUDY} string, p int, " + ", ".join(f"{c} double" for c in _SUMS))
    sums = parts.groupBy(STUDY, "p").agg(*[F.sum(c).alias(c) for c in _SUMS])
    study = Window.partitionBy(STUDY)
    over = lambda e: F.sum(F.expr(e)).over(study)
    solve = lambda x, y, p, q, r: F.try_divide(F.expr(f"{r} * {x} - {q} * {y}"), F.expr(f"{p} * {r} - {q} * {q}"))
    step = params.join(sums, [STUDY, "p"], "left").withColumn("var", over("rss") / over("m"))
    step = step.withColumn("like", over("jac") - over("m") / 2 * F.log("var"))
    step = step.withColumn("better", F.col("best").isNull() | (F.col("like") >= F.col("best")))
    step = step.withColumns({
        "ga": -F.col("ra") / F.col("var") - F.col("ja"), "gb": -F.col("rb") / F.col("var") + F.col("jb"),
        "haa": F.expr("saa / var + greatest(j11, 0)"), "hab": F.expr("sab / var"), "hbb": F.expr("sbb / var + greatest(j22, 0)"),
        "gain": F.try_divide(F.col("like") - F.col("best"), over("m")),
    })
    # A shift shared by all samples of a study hardly moves the residuals; it gets its own
    # Newton step, and the per-sample steps keep only what differs between samples.
    step = step.withColumns({"GA": over("ga"), "GB": over("gb"), "h11": over("c11 / var + j11"), "h12": over("c12 / var + j12"), "h22": over("c22 / var + j22"),
                             "w11": over("c11 / var + abs(j11)"), "w22": over("c22 / var + abs(j22)"),
                             "xa": solve("ga", "gb", "haa", "hab", "hbb"), "xb": solve("gb", "ga", "hbb", "hab", "haa")})
    sound = F.expr("h11 > 0 and h11 * h22 - h12 * h12 > 1e-6 * h11 * h22")
    zero = F.lit(0.0)
    joint_a = F.coalesce(F.when(sound, solve("GA", "GB", "h11", "h12", "h22")).otherwise(F.try_divide(F.col("GA"), F.col("w11"))), zero)
    joint_b = F.coalesce(F.when(sound, solve("GB", "GA", "h22", "h12", "h11")).otherwise(F.try_divide(F.col("GB"), F.col("w22"))), zero)
    clip = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    step = step.withColumns({
        "da": F.coalesce(F.col("xa"), zero) - F.avg(F.coalesce(F.col("xa"), zero)).over(study) + clip(joint_a),
        "db": F.coalesce(F.col("xb"), zero) - F.avg(F.coalesce(F.col("xb"), zero)).over(study) + clip(joint_b),
    })
    damp = F.when(F.col("better"), F.least(F.col("damp") * 1.5, F.lit(1.0))).otherwise(F.col("damp") / 2)
    # From an accepted point take the new step; otherwise retry half-way back to it.
    next_a = F.when(F.col("better"), F.col("a") + damp * F.col("da")).otherwise((F.col("a") + F.col("a0")) / 2)
    next_b = F.when(F.col("better"), F.col("log_b") + damp * F.col("db")).otherwise((F.col("log_b") + F.col("log_b0")) / 2)
    keep = lambda new, old: F.when(F.col("better"), F.col(new)).otherwise(F.col(old))
    moved = F.greatest(F.abs(next_a - keep("a", "a0")), F.abs(next_b - keep("log_b", "log_b0")))
    return step.select(
        *SAMPLE_KEY,
        "p",
        next_a.alias("a"),
        next_b.alias("log_b"),
        damp.alias("damp"),
        keep("like", "best").alias("best"),
        keep("a", "a0").alias("a0"),
        keep("log_b", "log_b0").alias("log_b0"),
        # A gain below 1e-5 of likelihood per cell is the end as well.
        F.when(F.col("gain").between(0, LIKELIHOOD_GAIN), zero).otherwise(moved).alias("moved"),
    )


def apply_vsn(cells: DataFrame, params: DataFrame) -> DataFrame:
    """glog2 values; the study's mean factor is taken out so large values read as log2."""
    shifted = materialise(params.select(*SAMPLE_KEY, "a", "log_b").withColumn("_ref", F.avg("log_b").over(Window.partitionBy(STUDY))))
    u = F.asinh(F.col("a") + F.exp("log_b") * F.col(VALUE))
    out = cells.join(shifted, SAMPLE_KEY).withColumn(VALUE, (u - F.col("_ref")) / math.log(2) - 1)
    return tag_scale(out.drop("a", "log_b", "_ref"), "glog2")


def log2_transform(cells: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """``log2(x + pseudocount)``; a value below ``-pseudocount`` fails the job."""
    require_scale(cells, "linear")
    if not pseudocount > 0:
        raise ValueError("pseudocount must be > 0")
    return tag_scale(cells.withColumn(VALUE, guarded_log2(F.col(VALUE) + pseudocount)), "log2")


def guarded_log2(x: Column) -> Column:
    negative = F.raise_error(F.lit("log of a negative value")).cast("double")
    return F.when(x > 0, F.log2(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, negative)


def log2_positive(cells: DataFrame) -> DataFrame:
    """Plain log2 of positive values, without a pseudocount."""
    require_scale(cells, "linear")
    return tag_scale(cells.withColumn(VALUE, F.log2(F.when(F.col(VALUE) > 0, F.col(VALUE)))), "log2")


def to_linear(cells: DataFrame) -> DataFrame:
    """Invert log2, log10 or ln; other scales cannot be inverted and are refused."""
    require_scale(cells, ("log2", "log10", "ln"))
    value = F.col(VALUE)
    inverse = {"log2": F.pow(F.lit(2.0), value), "log10": F.pow(F.lit(10.0), value), "ln": F.exp(value)}
    return tag_scale(cells.withColumn(VALUE, inverse[scale_of(cells)]), "linear")


def median_center(cells: DataFrame) -> DataFrame:
    """Subtract each sample's median on a log scale."""
    require_scale(cells, LOG_SCALES)
    tag = scale_of(cells)
    medians = materialise(group_median(cells, SAMPLE_KEY, VALUE, "_med"))
    out = cells.join(medians, SAMPLE_KEY).withColumn(VALUE, F.col(VALUE) - F.col("_med")).drop("_med")
    return tag_scale(out, tag)


def recover_factors(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """Per-sample factor between two linear states and how far it is from constant."""
    ratio = raw.select(*CELL_KEY, F.col(VALUE).alias("_raw")).join(
        normalized.select(*CELL_KEY, F.col(VALUE).alias("_norm")), CELL_KEY
    ).withColumn("_ratio", F.try_divide(F.col("_norm"), F.col("_raw")))
    factors = materialise(group_median(ratio, SAMPLE_KEY, "_ratio", "factor"))
    spread = F.max(F.abs(F.col("_ratio") / F.col("factor") - 1))
    return ratio.join(factors, SAMPLE_KEY).groupBy(*SAMPLE_KEY, "factor").agg(
        spread.alias("max_rel_spread"), F.count_if(F.col("_ratio").isNull() | (F.col("_ratio") <= 0)).alias("n_bad")
    )


def apply_factors(cells: DataFrame, factors: DataFrame, rtol: float = 1e-9) -> DataFrame:
    """Scale all cells by recovered factors; a factor that was not constant fails the job."""
    require_scale(cells, "linear")
    sound = (F.col("max_rel_spread") <= rtol) & (F.col("n_bad") == 0)
    checked = F.when(sound, F.col("factor")).otherwise(
        F.raise_error(F.lit("normalisation is not a per-sample scaling")).cast("double")
    )
    small = materialise(factors.select(*SAMPLE_KEY, checked.alias("factor")))
    out = cells.join(small, SAMPLE_KEY).withColumn(VALUE, F.col(VALUE) * F.col("factor")).drop("factor")
    return tag_scale(out, "linear")


def center_by_feature(cells: DataFrame) -> DataFrame:
    mean = F.avg(VALUE).over(Window.partitionBy(STUDY, FEATURE))
    tag = scale_of(cells)
    out = cells.withColumn(VALUE, F.col(VALUE) - mean)
    return tag_scale(out, tag) if tag else out


def run_offsets(complete: DataFrame) -> DataFrame:
    """Per-sample median of the deviation from the feature's mean."""
    return group_median(center_by_feature(complete), SAMPLE_KEY, VALUE, "offset")


def round_fraction(x: Column, precise_below: float = 1e-3, figures: int = 3, decimals: int = 3) -> Column:
    """Display rounding: significant figures below ``precise_below``, decimals above."""
    from quantgrid.operators.ids import sig_figs

    return F.when(x <= 0, F.lit(None).cast("double")).when(x < precise_below, sig_figs(x, figures)).otherwise(
        F.bround(x, decimals)
    )
