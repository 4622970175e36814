"""Quality-control summaries: the tables under the usual plots."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.model import FEATURE, SAMPLE, STUDY, VALUE, require_scale, study_sizes
from quantgrid.operators.checks import check_bijection
from quantgrid.operators.correlation import correlate, pearson
from quantgrid.operators.matrix import cross_moments
from quantgrid.operators.missing import detected
from quantgrid.operators.ranks import (
    average_ranks,
    equal_count_bins,
    group_median,
    group_quantiles,
    row_positions,
    top_per_group,
)
from quantgrid.session import materialise

FEATURE_KEY = [STUDY, FEATURE]
SAMPLE_KEY = [STUDY, SAMPLE]


def stack_states(states: Mapping[str, DataFrame]) -> DataFrame:
    """Cells of several states with the state's name as a key column."""
    parts = [df.select(F.lit(name).alias("state"), STUDY, FEATURE, SAMPLE, VALUE) for name, df in states.items()]
    return reduce(DataFrame.unionByName, parts)


def profile(raw: DataFrame) -> DataFrame:
    """Per-sample profile of parsed cells: token counts, positive values and their spread.

    Missing provenance columns count as absent tokens.
    """
    nan = F.count_if("was_nan_token") if "was_nan_token" in raw.columns else F.lit(0).cast("long")
    zero = F.count_if("was_zero_token") if "was_zero_token" in raw.columns else F.count_if(F.col(VALUE) == 0)
    positive = F.when(F.col(VALUE) > 0, F.col(VALUE))
    counts = raw.groupBy(*SAMPLE_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        nan.alias("n_nan"),
        zero.alias("n_zero"),
        F.count(positive).alias("n_pos"),
        F.min(positive).alias("min_pos"),
        F.max(positive).alias("max_pos"),
        (F.log10(F.max(positive)) - F.log10(F.min(positive))).alias("log10_range"),
    )
    medians = group_median(raw.withColumn(VALUE, positive), SAMPLE_KEY, VALUE, "median_pos")
    return counts.join(medians, SAMPLE_KEY, "left")


def pattern_counts(ids: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """How many ids match each named pattern."""
    hits = ids.groupBy(STUDY).agg(*[F.count_if(F.col(column).rlike(p)).alias(n) for n, p in patterns.items()])
    return hits.unpivot([STUDY], list(patterns), "pattern", "n")


def features_by_runs(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Number of features quantified in exactly k runs, k = 0 included."""
    seen = cells.where(detected()).groupBy(*FEATURE_KEY).agg(F.count(F.lit(1)).alias("n_runs"))
    all_features = features.select(*FEATURE_KEY).join(seen, FEATURE_KEY, "left")
    return all_features.groupBy(STUDY, F.coalesce("n_runs", F.lit(0)).alias("n_runs")).agg(F.count(F.lit(1)).alias("n_features"))


def duplicate_value_rows(cells: DataFrame) -> DataFrame:
    """Features whose values over all samples are identical to another feature's."""
    rows = cells.where(detected()).groupBy(*FEATURE_KEY).agg(
        F.sort_array(F.collect_list(F.struct(SAMPLE, VALUE))).alias("_row"), F.count(F.lit(1)).alias("n_runs")
    ).withColumn("_digest", F.sha2(F.to_json("_row"), 256))
    twins = rows.groupBy(STUDY, "_digest").agg(F.count(F.lit(1)).alias("k"), F.min("n_runs").alias("n_runs")).where("k > 1")
    return twins.groupBy(STUDY).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("k").alias("n_features"))


def token_counts(features: DataFrame, column: str, pattern: str) -> DataFrame:
    """Occurrences of every token a pattern finds in a text column."""
    tokens = features.select(STUDY, F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("token"))
    return tokens.groupBy(STUDY, "token").agg(F.count(F.lit(1)).alias("n"))


def source_agreement(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Two sources summed to ``group`` and sample: log correlation and median relative gap."""
    keys = [STUDY, group, SAMPLE]
    left = a.groupBy(*keys).agg(F.sum(VALUE).alias("_a"))
    right = b.groupBy(*keys).agg(F.sum(VALUE).alias("_b"))
    both = left.join(right, keys).where("_a > 0 and _b > 0").withColumn(
        "_gap", F.abs(F.col("_a") - F.col("_b")) / F.col("_b")
    )
    r = both.groupBy(*SAMPLE_KEY).agg(
        F.count(F.lit(1)).alias("n"), pearson(F.log2("_a"), F.log2("_b")).alias("r_log2")
    )
    return r.join(group_median(both, SAMPLE_KEY, "_gap", "median_rel_diff"), SAMPLE_KEY)


def id_depth(cells: DataFrame, samples: DataFrame, min_value: float = 0.0, reference: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Detected features per sample, and the study median over the reference samples."""
    require_scale(cells, "linear")
    seen = cells.where(detected(min_value)).groupBy(*SAMPLE_KEY).agg(F.count(F.lit(1)).alias("n_detected"))
    depth = samples.join(seen, SAMPLE_KEY, "left").withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
    chosen = depth if reference is None else depth.where(reference)
    return depth, chosen.groupBy(STUDY).agg(F.median("n_detected").alias("reference_median"))


def contiguous_groups(samples: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """Runs of equal labels in acquisition order with first and last position."""
    w = Window.partitionBy(STUDY).orderBy(*order)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    placed = samples.withColumn("_new", changed.cast("int")).withColumn("_pos", F.row_number().over(w))
    islands = placed.withColumn("group_index", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(STUDY, "group_index", label).agg(
        F.min("_pos").alias("first_position"), F.max("_pos").alias("last_position"), F.count(F.lit(1)).alias("n")
    )


def split_labels(groups: DataFrame, label: str) -> DataFrame:
    """Labels that form more than one contiguous group (violations)."""
    return groups.groupBy(STUDY, label).agg(F.count(F.lit(1)).alias("n_groups")).where("n_groups > 1")


def completeness(cells: DataFrame, features: DataFrame, samples: DataFrame, min_value: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Detection rate per feature and per sample over the full grid."""
    seen = cells.where(detected(min_value))
    sizes = materialise(study_sizes(samples))
    n_features = materialise(features.groupBy(STUDY).agg(F.count(F.lit(1)).alias("n_features")))
    by_feature = (
        features.select(*FEATURE_KEY)
        .join(seen.groupBy(*FEATURE_KEY).agg(F.count(F.lit(1)).alias("n_detected")), FEATURE_KEY, "left")
        .join(sizes, STUDY)
        .withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
        .withColumn("detection_rate", F.col("n_detected") / F.col("n_samples"))
    )
    by_sample = (
        samples.select(*SAMPLE_KEY)
        .join(seen.groupBy(*SAMPLE_KEY).agg(F.count(F.lit(1)).alias("n_detected")), SAMPLE_KEY, "left")
        .join(n_features, STUDY)
        .withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
        .withColumn("detection_rate", F.col("n_detected") / F.col("n_features"))
    )
    return by_feature, by_sample


def _detection_histogram(cells: DataFrame, samples: DataFrame, by: str | None, min_value: float) -> DataFrame:
    """Features per (study, group, number of runs they are detected in)."""
    labels = materialise(samples.select(*SAMPLE_KEY, (F.col(by) if by else F.lit("all")).cast("string").alias("group")))
    seen = cells.where(detected(min_value)).join(labels, SAMPLE_KEY)
    per_feature = seen.groupBy(STUDY, "group", FEATURE).agg(F.count(F.lit(1)).alias("k"))
    return per_feature.groupBy(STUDY, "group", "k").agg(F.count(F.lit(1)).alias("m"))


def _group_sizes(samples: DataFrame, by: str | None) -> DataFrame:
    label = (F.col(by) if by else F.lit("all")).cast("string").alias("group")
    return samples.groupBy(STUDY, label).agg(F.count(F.lit(1)).alias("n_samples"))


def retention(
    cells: DataFrame, samples: DataFrame, fractions: Sequence[float], by: str | None = None, min_value: float = 0.0
) -> DataFrame:
    """Features detected in at least ceil(f n) samples, per group and fraction f in (0, 1]."""
    if not all(0 < f <= 1 for f in fractions):
        raise ValueError("fractions must lie in (0, 1]")
    grid = _group_sizes(samples, by).withColumn(
        "fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    ).withColumn("needed", F.ceil(F.col("fraction") * F.col("n_samples") - 1e-9))
    hist = _detection_histogram(cells, samples, by, min_value)
    joined = grid.join(hist, [STUDY, "group"], "left")
    return joined.groupBy(STUDY, "group", "fraction", "needed", "n_samples").agg(
        F.coalesce(F.sum(F.when(F.col("k") >= F.col("needed"), F.col("m"))), F.lit(0)).alias("n_features")
    )


def retention_curve(cells: DataFrame, samples: DataFrame, by: str | None = None, min_value: float = 0.0) -> DataFrame:
    """Features detected in at least k samples for every k up to the group's size."""
    ks = _group_sizes(samples, by).select(STUDY, "group", F.explode(F.sequence(F.lit(1), F.col("n_samples").cast("int"))).alias("k"))
    hist = _detection_histogram(cells, samples, by, min_value)
    w = Window.partitionBy(STUDY, "group").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = ks.join(hist, [STUDY, "group", "k"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return filled.select(STUDY, "group", "k", F.sum("m").over(w).alias("n_features"))


def mnar_points(cells: DataFrame, samples: DataFrame, min_value: float = 0.0) -> DataFrame:
    """Mean log2 detected value and detection rate per feature with any positive value."""
    require_scale(cells, "linear")
    positive = cells.where(detected(min_value) & (F.col(VALUE) > 0))
    means = positive.groupBy(*FEATURE_KEY).agg(F.avg(F.log2(VALUE)).alias("mean_log2"), F.count(F.lit(1)).alias("k"))
    sizes = materialise(study_sizes(samples))
    return means.join(sizes, STUDY).withColumn("detection_rate", F.col("k") / F.col("n_samples"))


def mnar(cells: DataFrame, samples: DataFrame, min_value: float = 0.0) -> DataFrame:
    """Correlation of mean log2 value with detection rate: are missing cells the low ones?"""
    return correlate(mnar_points(cells, samples, min_value), "mean_log2", "detection_rate", [STUDY])


def percentile_bins(df: DataFrame, keys: Sequence[str], x: str, bins: int, name: str = "bin") -> DataFrame:
    """Add a 0-based bin between distinct percentile edges, half-open, the last closed."""
    probs = [i / bins for i in range(bins + 1)]
    q = group_quantiles(df, keys, x, probs, [f"_e{i}" for i in range(bins + 1)])
    edges = materialise(q.select(*keys, F.array_distinct(F.array(*[f"_e{i}" for i in range(bins + 1)])).alias("_edges")))
    joined = df.join(edges, list(keys)) if keys else _attach_one(df, edges)
    below = F.size(F.filter("_edges", lambda e: e <= F.col(x)))
    index = F.least(below, F.size("_edges") - 1) - 1
    return joined.where(F.col(x).isNotNull() & (F.size("_edges") > 1)).withColumn(name, index).drop("_edges")


def _attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(1)).join(one_row.withColumn("_k", F.lit(1)), "_k").drop("_k")


def binned_median(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int) -> DataFrame:
    """Median x and y within percentile-edge bins; empty bins do not appear."""
    return _bin_medians(percentile_bins(df, keys, x, bins), keys, x, y)


def ntile_median(df: DataFrame, keys: Sequence[str], x: str, y: str, bins: int, tie: Sequence[str] = (FEATURE,)) -> DataFrame:
    """Median x and y within equal-count bins."""
    return _bin_medians(equal_count_bins(df, keys, x, tie, bins), keys, x, y)


def _bin_medians(binned: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    by = [*keys, "bin"]
    binned = materialise(binned.select(*by, x, y))
    n = binned.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.join(group_median(binned, by, x, "x_median"), by).join(group_median(binned, by, y, "y_median"), by)


def dynamic_range(cells: DataFrame, features: DataFrame | None = None, by: str | None = None, min_value: float = 0.0) -> DataFrame:
    """Rank-abundance table: features by descending median detected value.

    Per feature log2 median and quartiles, detections and rank; ties follow the feature id.
    ``by`` ranks each class of the feature table on its own.
    """
    require_scale(cells, "linear")
    seen = cells.where(detected(min_value))
    # A feature's cells are bounded by the number of samples.
    rows = seen.groupBy(*FEATURE_KEY).agg(
        F.percentile(VALUE, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.count(F.lit(1)).alias("n_detected")
    ).select(
        *FEATURE_KEY, "n_detected", F.col("_q")[1].alias("median"),
        F.log2(F.col("_q")[1]).alias("log2_median"), F.log2(F.col("_q")[0]).alias("log2_q25"), F.log2(F.col("_q")[2]).alias("log2_q75"),
    )
    keys = [STUDY]
    if by:
        rows, keys = rows.join(features.select(*FEATURE_KEY, by), FEATURE_KEY), [STUDY, by]
    return row_positions(rows, keys, "median", [FEATURE], "rank", descending=True)


def dynamic_range_summary(ranked: DataFrame, samples: DataFrame, keys: Sequence[str] = (STUDY,)) -> DataFrame:
    sizes = materialise(study_sizes(samples))
    return ranked.join(sizes, STUDY).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_detected"),
        F.log10(F.max("median") / F.min("median")).alias("orders"),
        F.max("log2_median").alias("log2_median_max"),
        F.min("log2_median").alias("log2_median_min"),
        F.count_if(F.col("n_detected") == F.col("n_samples")).alias("n_detected_all_samples"),
        F.count_if(F.col("n_detected") == 1).alias("n_detected_single_sample"),
    )


def flagged_ranks(ranked: DataFrame, features: DataFrame, flag: str, top: Sequence[int] = (10, 50, 100)) -> tuple[DataFrame, DataFrame]:
    """Where flagged features stand in the rank order; also the ten highest of them."""
    marks = features.select(*FEATURE_KEY, flag)
    marked = ranked.join(marks, FEATURE_KEY).where(F.col(flag))
    counts = marked.groupBy(STUDY).agg(
        F.count(F.lit(1)).alias("n_flagged_detected"),
        *[F.count_if(F.col("rank") <= k).alias(f"n_top_{k}") for k in top],
        F.count_if(F.col("rank") <= F.ceil(F.col("rank_n") / 10)).alias("n_top_decile"),
    )
    total = features.groupBy(STUDY).agg(F.count_if(flag).alias("n_flagged"))
    medians = group_median(marked, [STUDY], "rank", "median_rank")
    summary = total.join(counts, STUDY, "left").join(medians, STUDY, "left")
    return summary, top_per_group(marked, [STUDY], [F.col("rank")], 10, FEATURE, "flagged_order")


def box_summary(states: DataFrame) -> DataFrame:
    """Five-number summary per state and sample (states stacked with a ``state`` column)."""
    keys = ["state", *SAMPLE_KEY]
    return group_quantiles(states, keys, VALUE, [0, 0.25, 0.5, 0.75, 1], ["min", "q25", "median", "q75", "max"])


def median_range(boxes: DataFrame) -> DataFrame:
    """Spread of the sample medians per state."""
    return boxes.groupBy("state", STUDY).agg((F.max("median") - F.min("median")).alias("median_range"))


def cv(states: DataFrame) -> DataFrame:
    """Coefficient of variation per state and feature; a mean at or below 0 gives NULL."""
    rows = states.groupBy("state", *FEATURE_KEY).agg(
        F.avg(VALUE).alias("mean"), F.stddev_samp(VALUE).alias("sd"), F.count(VALUE).alias("n")
    )
    return rows.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))


def cv_summary(cvs: DataFrame) -> DataFrame:
    counts = cvs.groupBy("state", STUDY).agg(F.count("cv").alias("n_features"))
    return counts.join(group_median(cvs, ["state", STUDY], "cv", "median_cv"), ["state", STUDY])


def cv_alignment(cvs: DataFrame) -> DataFrame:
    """Features that some state lacks (violations)."""
    n_states = F.count_distinct("state")
    total = cvs.select("state", STUDY).distinct().groupBy(STUDY).agg(F.count(F.lit(1)).alias("k"))
    return cvs.groupBy(*FEATURE_KEY).agg(n_states.alias("n_states")).join(total, STUDY).where("n_states < k")


def cv_histogram(cvs: DataFrame, bins: int = 60) -> DataFrame:
    """Histogram per state up to the study's pooled 99.5th percentile; bin ``bins`` holds what lies beyond."""
    bound = materialise(group_quantiles(cvs, [STUDY], "cv", [0.995], ["upper"]))
    rows = cvs.where(F.col("cv").isNotNull()).join(bound, STUDY)
    index = F.least(F.floor(F.try_divide(F.col("cv") * bins, F.col("upper"))), F.lit(bins - 1)).cast("int")
    index = F.when(F.col("cv") > F.col("upper"), bins).otherwise(index)
    return rows.groupBy("state", STUDY, "upper", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sample_corr(cells: DataFrame, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of samples, both orders and the unit diagonal included.

    Values are centred per sample first, so the pairwise sums do not cancel. A sample
    without spread has NULL, as its correlation is undefined.
    """
    base = cells.select(*FEATURE_KEY, SAMPLE, VALUE)
    if method == "spearman":
        base = average_ranks(base, SAMPLE_KEY, VALUE, "_r").select(*FEATURE_KEY, SAMPLE, F.col("_r").alias(VALUE))
    means = materialise(base.groupBy(*SAMPLE_KEY).agg(F.avg(VALUE).alias("_m")))
    centred = base.join(means, SAMPLE_KEY).withColumn(VALUE, F.col(VALUE) - F.col("_m"))
    m = cross_moments(centred)
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(F.greatest(vx * vy, F.lit(0.0))))
    bounded = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    same = F.col("sample_a") == F.col("sample_b")
    return m.where("n > 0").select(
        STUDY, "sample_a", "sample_b", n.cast("long").alias("n"), F.when(same & (vx > 0), F.lit(1.0)).otherwise(bounded).alias("r")
    )


def nearest_partner(corr: DataFrame, samples: DataFrame, pair: str = "candidate_pair") -> DataFrame:
    """Closest other sample per sample and whether it is its own pair's."""
    w = Window.partitionBy(STUDY, "sample_a").orderBy(F.col("r").desc(), "sample_b")
    best = corr.where("sample_a <> sample_b").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    pairs = samples.select(STUDY, F.col(SAMPLE), F.col(pair).alias("_p"))
    named = lambda side: pairs.select(STUDY, F.col(SAMPLE).alias(f"sample_{side}"), F.col("_p").alias(f"_p{side}"))
    return best.join(named("a"), [STUDY, "sample_a"]).join(named("b"), [STUDY, "sample_b"]).select(
        STUDY, "sample_a", F.col("sample_b").alias("nearest"), "r", (F.col("_pa") == F.col("_pb")).alias("own_pair")
    )


def corr_summary(corr: DataFrame) -> DataFrame:
    """Lowest and highest pair and the median over distinct pairs of a study."""
    pairs = corr.where("sample_a < sample_b").withColumn("_pair", F.concat_ws("/", "sample_a", "sample_b"))
    ends = pairs.groupBy(STUDY).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.min("r").alias("min_r"), F.min_by("_pair", F.struct("r", "_pair")).alias("min_pair"),
        F.max("r").alias("max_r"), F.max_by("_pair", F.struct("r", "_pair")).alias("max_pair"),
    )
    return ends.join(group_median(pairs, [STUDY], "r", "median_r"), STUDY)


def pca(cells: DataFrame, k: int = 2, standardize: bool = False) -> DataFrame:
    """Principal components of the samples: ``component, sample_id, score, explained``.

    Features are centred over samples (and scaled to unit sd if asked). Only the
    sample-by-sample Gram matrix reaches the decomposition, one study per group. Signs are
    fixed so that the largest loading of a component is positive.
    """
    if standardize:
        flat = cells.groupBy(*FEATURE_KEY).agg(F.stddev_pop(VALUE).alias("s")).where("s = 0 or s is null")
        from quantgrid.operators.checks import assert_empty

        assert_empty(flat, "constant features cannot be standardised")
    gram = cross_moments(cells, centre=True, scale=standardize).select(STUDY, "sample_a", "sample_b", "sxy")

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="sample_a", columns="sample_b", values="sxy").sort_index().sort_index(axis=1).fillna(0.0)
        w, v = np.linalg.eigh(m.to_numpy())
        order = np.argsort(w)[::-1]
        w, v = np.clip(w[order], 0, None), v[:, order]
        top = min(k, len(w))
        v = v[:, :top] * np.sign(v[np.argmax(np.abs(v[:, :top]), axis=0), np.arange(top)])
        score = v * np.sqrt(w[:top])
        total = w.sum()
        return pd.DataFrame({
            STUDY: pdf[STUDY].iloc[0],
            "component": np.repeat(np.arange(1, top + 1), len(m)),
            SAMPLE: np.tile(m.index.to_numpy(), top),
            "score": score.T.ravel(),
            "explained": np.repeat(w[:top] / total if total > 0 else np.full(top, math.nan), len(m)),
        })

    schema = f"{STUDY} string, component int, {SAMPLE} string, score double, explained double"
    return gram.groupBy(STUDY).applyInPandas(decompose, schema)


def align_states(states: Mapping[str, DataFrame]) -> DataFrame:
    """Samples that only some states have (violations)."""
    names = list(states)
    parts = [
        check_bijection(states[names[0]], states[o], SAMPLE_KEY).withColumn("state", F.lit(o)) for o in names[1:]
    ]
    return reduce(DataFrame.unionByName, parts)


def check_order(samples: DataFrame, index: str, order: Sequence[str]) -> DataFrame:
    """Samples whose stored index does not follow acquisition order (violations)."""
    w = Window.partitionBy(STUDY).orderBy(index)
    key = F.struct(*order)
    return samples.withColumn("_prev", F.lag(key).over(w)).where(F.col("_prev") > key).drop("_prev")


def same_detection(a: DataFrame, b: DataFrame, flagged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells that only one of two measures detects, and the shared depth per sample."""
    keys = [*FEATURE_KEY, SAMPLE]
    left = a.select(*keys, detected().alias("_a"))
    right = b.select(*keys, detected().alias("_b"))
    both = left.join(right, keys, "full_outer").na.fill(False, ["_a", "_b"])
    conflicts = both.where("_a <> _b")
    if flagged is not None:
        both = both.join(flagged.select(*FEATURE_KEY, F.lit(True).alias("_f")), FEATURE_KEY, "left").na.fill(False, ["_f"])
    else:
        both = both.withColumn("_f", F.lit(False))
    depth = both.groupBy(*SAMPLE_KEY).agg(
        F.count_if("_a").alias("n_detected"), F.count_if(F.expr("_a and not _f")).alias("n_detected_unflagged")
    )
    return conflicts, depth
