"""Data model: long cell tables keyed by study, feature and sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgrid.session import materialise

STUDY, FEATURE, SAMPLE, VALUE = "study_id", "feature_id", "sample_id", "value"
CELL_KEY = [STUDY, FEATURE, SAMPLE]

# The scale tags a value column may carry.
SCALES = ("linear", "log2", "log10", "ln", "glog2", "zscore", "ratio")
LOG_SCALES = ("log2", "log10", "ln", "glog2", "zscore")


class ScaleError(ValueError):
    """An operator met a value column on a scale it must not be applied to."""


class CheckFailed(ValueError):
    """A check found violating rows."""


@dataclass(frozen=True)
class Study:
    """Cells with their feature and sample tables, possibly of many studies."""

    cells: DataFrame
    features: DataFrame
    samples: DataFrame

    def with_cells(self, cells: DataFrame) -> "Study":
        return Study(cells, self.features, self.samples)


def tag_scale(df: DataFrame, scale: str, column: str = VALUE) -> DataFrame:
    if scale not in SCALES:
        raise ScaleError(f"unknown scale {scale!r}; expected one of {SCALES}")
    return df.withMetadata(column, {"scale": scale})


def scale_of(df: DataFrame, column: str = VALUE) -> str | None:
    return df.schema[column].metadata.get("scale")


def require_scale(df: DataFrame, allowed: tuple[str, ...] | str, column: str = VALUE) -> None:
    """Plan-time guard; no job is started."""
    allowed = (allowed,) if isinstance(allowed, str) else tuple(allowed)
    found = scale_of(df, column)
    if found not in allowed:
        raise ScaleError(f"column {column!r} is on scale {found!r}; needs one of {allowed}")


def missing_when_nan(value: Column) -> Column:
    """NaN never enters a cell table: Spark orders NaN above every number."""
    return F.when(~F.isnan(value), value)


def study_sizes(samples: DataFrame) -> DataFrame:
    """Samples per study: ``study_id, n_samples``."""
    return samples.groupBy(STUDY).agg(F.count(F.lit(1)).alias("n_samples"))


def complete_grid(cells: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per feature and sample of its study; absent cells are NULL rows.

    Each feature expands to its study's sample list in place, so a study that holds most
    features spreads over tasks as its features do.
    """
    per_study = materialise(samples.groupBy(STUDY).agg(F.collect_list(SAMPLE).alias("_samples")))
    grid = (
        features.select(STUDY, FEATURE)
        .join(per_study, STUDY)
        .select(STUDY, FEATURE, F.explode("_samples").alias(SAMPLE))
    )
    meta = cells.schema[VALUE].metadata
    out = grid.join(cells, CELL_KEY, "left")
    return out.withMetadata(VALUE, meta) if meta else out
