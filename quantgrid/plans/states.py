"""Processing states of a study, from raw cells to batch-corrected values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.model import FEATURE, STUDY, tag_scale
from quantgrid.operators.batch import combat
from quantgrid.operators.checks import assert_empty, check_bijection
from quantgrid.operators.missing import complete_cells, subset
from quantgrid.operators.normalize import log2_transform, normalize, to_linear

FRACTION_PSEUDOCOUNT = 1e-9


def build_states(
    cells: DataFrame, features: DataFrame, samples: DataFrame, batch: str = "batch", flag: str = "is_contaminant"
) -> dict[str, DataFrame]:
    """Raw, complete, log, normalised and batch-corrected states as lazy DataFrames.

    Flagged features and incomplete features leave before the medians are taken, because
    the factors depend on which features are in.
    """
    states = {"raw_linear": tag_scale(cells, "linear")}
    unflagged = subset(states["raw_linear"], features, ~F.col(flag))
    complete = tag_scale(complete_cells(unflagged, samples), "linear")
    states["raw_linear_complete"] = complete
    states["raw_log"] = log2_transform(complete)
    states["normalized_linear"] = normalize(complete, "median")
    states["normalized_log"] = log2_transform(states["normalized_linear"])
    if batch:
        corrected = combat(states["normalized_log"], samples, batch).drop("corrected")
        states["batch_corrected_log"] = tag_scale(corrected, "log2")
        states["batch_corrected_linear"] = to_linear(states["batch_corrected_log"])
    return states


def build_count_states(
    fractions: DataFrame, counts: DataFrame, features: DataFrame, samples: DataFrame, flag: str = "is_contaminant"
) -> dict[str, DataFrame]:
    """Fraction states (log with a tiny pseudocount, no normalisation) and count states.

    Both must be complete in the same features.
    """
    out: dict[str, DataFrame] = {}
    for name, cells in (("fraction", fractions), ("count", counts)):
        raw = tag_scale(cells, "linear")
        out[f"{name}_raw"] = raw
        out[f"{name}_complete"] = tag_scale(complete_cells(subset(raw, features, ~F.col(flag)), samples), "linear")
    keys = [STUDY, FEATURE]
    lone = check_bijection(out["fraction_complete"], out["count_complete"], keys)
    assert_empty(lone, "fractions and counts are complete in different features")
    out["fraction_log"] = log2_transform(out["fraction_complete"], FRACTION_PSEUDOCOUNT)
    out["count_log"] = log2_transform(out["count_complete"])
    return out


def manifest(states: Mapping[str, DataFrame]) -> DataFrame:
    """Features, samples and cells per state and study."""
    parts = [
        df.groupBy(STUDY).agg(
            F.lit(name).alias("state"),
            F.count_distinct(FEATURE).alias("n_features"),
            F.count_distinct("sample_id").alias("n_samples"),
            F.count("value").alias("n_cells"),
        )
        for name, df in states.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
