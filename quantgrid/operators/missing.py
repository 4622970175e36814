"""Detection, completeness filters and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.model import (
    CELL_KEY,
    FEATURE,
    SAMPLE,
    STUDY,
    VALUE,
    complete_grid,
    require_scale,
    scale_of,
    study_sizes,
    tag_scale,
)
from quantgrid.operators.matrix import cross_moments
from quantgrid.session import materialise

FEATURE_KEY = [STUDY, FEATURE]
SAMPLE_KEY = [STUDY, SAMPLE]


def detected(min_value: float = 0.0, value: str = VALUE) -> Column:
    """Present and strictly above ``min_value``."""
    return F.coalesce(F.col(value) > min_value, F.lit(False))


def missing_fractions(cells: DataFrame, features: DataFrame, samples: DataFrame, min_value: float = 0.0) -> DataFrame:
    """``n_detected, n_samples, missing_fraction`` per feature.

    The denominator comes from the sample table, so absent rows count without a grid.
    """
    seen = cells.where(detected(min_value)).groupBy(*FEATURE_KEY).agg(F.count(F.lit(1)).alias("n_detected"))
    sizes = materialise(study_sizes(samples))
    return (
        features.select(*FEATURE_KEY)
        .join(seen, FEATURE_KEY, "left")
        .join(sizes, STUDY)
        .withColumn("n_detected", F.coalesce("n_detected", F.lit(0)))
        .withColumn("missing_fraction", 1 - F.col("n_detected") / F.col("n_samples"))
    )


def filter_missing(
    cells: DataFrame, features: DataFrame, samples: DataFrame, max_fraction: float = 0.0, min_value: float = 0.0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells of features missing in at most ``max_fraction``; also dropped ids and a report."""
    if not 0 <= max_fraction <= 1:
        raise ValueError("max_fraction must lie in [0, 1]")
    if cells.select(VALUE).schema[VALUE].metadata.get("scale") not in (None, "linear"):
        require_scale(cells, "linear")
    rates = missing_fractions(cells, features, samples, min_value)
    # Counts are compared, so a fraction such as 1/3 is not decided by rounding.
    allowed = F.floor(F.lit(max_fraction) * F.col("n_samples") + 1e-9)
    keep = F.col("n_samples") - F.col("n_detected") <= allowed
    kept = cells.join(rates.where(keep).select(*FEATURE_KEY), FEATURE_KEY, "left_semi")
    dropped = rates.where(~keep).select(*FEATURE_KEY, "missing_fraction")
    report = rates.groupBy(STUDY).agg(
        F.count(F.lit(1)).alias("n_features_in"),
        F.count_if(keep).alias("n_features_out"),
        F.count_if(~keep).alias("n_dropped"),
    )
    return kept, dropped, report


def complete_cells(cells: DataFrame, samples: DataFrame, min_value: float = 0.0) -> DataFrame:
    """Cells of features detected in every sample of their study, in one shuffle.

    The count is a window over the feature, so the cells are shuffled once by feature and
    stay that way for a following per-feature step.
    """
    sizes = materialise(study_sizes(samples))
    seen = F.count_if(detected(min_value)).over(Window.partitionBy(*FEATURE_KEY))
    kept = cells.withColumn("_seen", seen).join(sizes, STUDY).where("_seen = n_samples")
    return kept.drop("_seen", "n_samples")


def subset(cells: DataFrame, features: DataFrame, predicate: Column) -> DataFrame:
    """Cells of the features that satisfy a predicate."""
    return cells.join(features.where(predicate).select(*FEATURE_KEY), FEATURE_KEY, "left_semi")


def impute(
    cells: DataFrame, features: DataFrame, samples: DataFrame, method: str, k: int = 5, min_value: float = 0.0
) -> DataFrame:
    """Fill every undetected cell of the grid by ``zero``, ``mean``, ``median`` or ``knn``."""
    tag = scale_of(cells)
    if method == "zero" and tag in ("log2", "log10", "ln", "glog2", "zscore"):
        require_scale(cells, ("linear", "ratio"))
    if method == "knn":
        out = _impute_knn(cells.where(detected(min_value)).select(*CELL_KEY, VALUE), features, samples, k)
        return tag_scale(out, tag) if tag else out
    grid = complete_grid(cells.select(*CELL_KEY, F.when(detected(min_value), F.col(VALUE)).alias(VALUE)), features, samples)
    per_feature = Window.partitionBy(*FEATURE_KEY)
    if method == "zero":
        out = grid.withColumn(VALUE, F.coalesce(VALUE, F.lit(0.0)))
    elif method in ("mean", "median"):
        fill = F.avg(VALUE) if method == "mean" else F.median(VALUE)
        out = grid.withColumn(VALUE, F.coalesce(VALUE, fill.over(per_feature)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return tag_scale(out, tag) if tag else out


def sample_distances(grid: DataFrame) -> DataFrame:
    """Missing-aware euclidean distance between the samples of a study.

    The squared sum over shared features is scaled up to all features; samples that share
    none have no distance.
    """
    m = cross_moments(grid, centre=True)
    size = grid.where(F.col(VALUE).isNotNull()).groupBy(STUDY).agg(F.count_distinct(FEATURE).alias("n_features"))
    squared = F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0))
    return (
        m.where((F.col("n") > 0) & (F.col("sample_a") != F.col("sample_b")))
        .join(size, STUDY)
        .select(STUDY, "sample_a", "sample_b", F.sqrt(squared * F.col("n_features") / F.col("n")).alias("distance"))
    )


def _impute_knn(cells: DataFrame, features: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """Mean over the ``k`` nearest samples that observe the feature, else the feature mean.

    Each sample's neighbour order is ranked once; a missing cell looks its order up among
    the feature's own observed cells, an array bounded by the number of samples. Detected cells are written once and
    gathered by feature, and a feature's row is laid out over its study's samples in place, without a join of cells.
    """
    features = materialise(features.select(*FEATURE_KEY))
    seen = materialise(cells.join(features, FEATURE_KEY, "left_semi").join(samples.select(*SAMPLE_KEY), SAMPLE_KEY, "left_semi"))
    ordered = (
        sample_distances(seen).groupBy(STUDY, "sample_a")
        .agg(F.sort_array(F.collect_list(F.struct("distance", "sample_b"))).alias("_near"))
        .select(STUDY, F.col("sample_a").alias(SAMPLE), F.transform("_near", lambda s: s["sample_b"]).alias("_near"))
    )
    near = samples.select(*SAMPLE_KEY).join(ordered, SAMPLE_KEY, "left")
    near = materialise(near.groupBy(STUDY).agg(F.collect_list(F.struct(F.col(SAMPLE), F.col("_near"))).alias("_samples")))
    own = seen.groupBy(*FEATURE_KEY).agg(F.map_from_entries(F.collect_list(F.struct(SAMPLE, VALUE))).alias("_seen"), F.avg(VALUE).alias("_mean"))
    donors = F.slice(
        F.filter(F.transform("_s._near", lambda s: F.try_element_at(F.col("_seen"), s)), lambda v: v.isNotNull()), 1, k
    )
    mean = F.try_divide(F.aggregate(donors, F.lit(0.0), lambda a, v: a + v), F.size(donors).cast("double"))
    rows = features.join(own, FEATURE_KEY, "left").join(near, STUDY).select(*FEATURE_KEY, "_seen", "_mean", F.explode("_samples").alias("_s"))
    value = F.coalesce(F.try_element_at(F.col("_seen"), F.col("_s").getField(SAMPLE)), mean, F.col("_mean"))
    return rows.select(*FEATURE_KEY, F.col("_s").getField(SAMPLE).alias(SAMPLE), value.alias(VALUE))


def fully_missing(cells: DataFrame, features: DataFrame, min_value: float = 0.0) -> DataFrame:
    """Features without any detected cell; mean, median and knn have nothing to fill from."""
    seen = cells.where(detected(min_value)).select(*FEATURE_KEY).distinct()
    return features.select(*FEATURE_KEY).join(seen, FEATURE_KEY, "left_anti")


def drop_constant(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of features that vary over samples, and the ids of those that do not."""
    spans = cells.groupBy(*FEATURE_KEY).agg(F.min(VALUE).alias("_lo"), F.max(VALUE).alias("_hi"))
    flat = spans.where(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*FEATURE_KEY)
    return cells.join(flat, FEATURE_KEY, "left_anti"), flat


def common_set(tables: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Ids present in every table."""
    keys = keys or FEATURE_KEY
    return reduce(DataFrame.intersect, [t.select(*keys) for t in tables])
