"""Several designs, quantities and relabellings in one pass over the cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.model import LOG_SCALES, STUDY, require_scale
from quantgrid.operators.checks import assert_empty
from quantgrid.operators.de import (
    _finish,
    add_variance,
    calibration,
    design,
    ols,
    pi0,
)
from quantgrid.session import materialise

MAX_LABELLINGS = 1 << 12


def run_designs(
    cells: DataFrame, samples: DataFrame, designs: Mapping[str, tuple[str, Sequence[str]]], method: str = "moderated",
    trend: bool = False, reference: Mapping[str, str] | None = None, alpha: float = 0.05,
) -> tuple[DataFrame, DataFrame]:
    """Fit every design (name -> contrast, covariates) together, keyed by ``design_id``."""
    require_scale(cells, LOG_SCALES)
    solved = [design(samples, c, covs, reference, (), name) for name, (c, covs) in designs.items()]
    projection = reduce(DataFrame.unionByName, [p for p, _ in solved])
    terms = reduce(DataFrame.unionByName, [t for _, t in solved])
    fits = materialise(add_variance(ols(cells, projection), terms))
    return _finish(fits, terms, method == "moderated", trend, alpha)


def run_quantities(
    quantities: Mapping[str, DataFrame], samples: DataFrame, designs: Mapping[str, tuple[str, Sequence[str]]], **options
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """All designs for every quantity; the tables of a quantity are lazy until read."""
    return {name: run_designs(cells, samples, designs, **options) for name, cells in quantities.items()}


def labellings(samples: DataFrame, control: str, treated: str) -> DataFrame:
    """The sample sheet once per within-pair swap pattern; the first pair stays fixed.

    ``design_id`` 0 is the observed labelling. 2^(pairs - 1) sheets of at most a few
    thousand rows; studies with more than 13 pairs are refused.
    """
    index = F.dense_rank().over(Window.partitionBy(STUDY).orderBy("candidate_pair")) - 1
    placed = samples.withColumn("_i", index)
    pairs = F.max("_i").over(Window.partitionBy(STUDY))
    placed = materialise(placed.withColumn("_k", pairs))
    assert_empty(placed.where(F.expr(f"shiftleft(1L, _k) > {MAX_LABELLINGS}")), "too many pairs to relabel exhaustively")
    many = placed.withColumn("_l", F.explode(F.expr("sequence(0L, shiftleft(1L, _k) - 1)")))
    flip = F.expr("_i > 0 and getbit(_l, cast(greatest(_i - 1, 0) as int)) = 1")
    swapped = F.when(F.col("condition") == control, F.lit(treated)).otherwise(F.lit(control))
    return many.select(
        *[c for c in samples.columns if c != "condition"], F.when(flip, swapped).otherwise(F.col("condition")).alias("condition"),
        F.lpad(F.col("_l").cast("string"), 6, "0").alias("design_id"),
    )


def relabel(
    cells: DataFrame, samples: DataFrame, control: str, treated: str, covariates: Sequence[str] = ("candidate_pair",)
) -> tuple[DataFrame, DataFrame]:
    """Refit all within-pair swaps in one job; rank the observed labelling by pi0.

    Returns one row per study and labelling, and one row per study with the rank (1 is the
    lowest pi0).
    """
    sheets = labellings(samples, control, treated)
    projection, terms = design(sheets, "condition", covariates, {"condition": control})
    fits = materialise(add_variance(ols(cells, projection), terms))
    table, prior = _finish(fits, terms, True, False, 0.05)
    rows = materialise(table.where("is_contrast").select(STUDY, "design_id", "p", "q"))
    by = [STUDY, "design_id"]
    hits = rows.groupBy(*by).agg(F.count_if(F.col("q") < 0.1).alias("hits_q10"), F.min("q").alias("min_q"))
    cal = calibration(rows, by).select(*by, "density_first_bin", "density_low_quarter")
    out = hits.join(pi0(rows, by).select(*by, "pi0"), by).join(cal, by).join(prior.select(*by, "d0"), by)
    out = materialise(out.withColumn("observed", F.col("design_id") == "000000"))
    seen = out.where("observed").select(STUDY, F.col("pi0").alias("observed_pi0"))
    ranked = out.join(seen, STUDY).groupBy(STUDY, "observed_pi0").agg(
        F.count(F.lit(1)).alias("n_labellings"), (1 + F.count_if(F.col("pi0") < F.col("observed_pi0"))).alias("observed_rank")
    )
    return out, ranked
