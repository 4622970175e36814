"""Study design: crosstabs, association, run-order tests and pair layout.

All of it works on sample sheets, grouped by study, one row per sample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.functions import special
from quantgrid.model import SAMPLE, STUDY
from quantgrid.operators.checks import assert_empty


def level_counts(samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    return samples.groupBy(STUDY, *columns).agg(F.count(F.lit(1)).alias("n"))


def crosstab(samples: DataFrame, row: str, column: str) -> DataFrame:
    """Wide counts per study and row level; absent combinations are 0."""
    return samples.groupBy(STUDY, row).pivot(column).agg(F.count(F.lit(1))).na.fill(0)


def association(samples: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V per study: ``n, n_a, n_b, chi2, v, v_corrected``.

    Only filled combinations exist as rows; with margins r and c, the empty ones add
    n - sum(r c / n over filled ones) to chi square.
    """
    counts = samples.groupBy(STUDY, a, b).agg(F.count(F.lit(1)).alias("o"))
    margins = counts.withColumns(
        {
            "r": F.sum("o").over(Window.partitionBy(STUDY, a)),
            "c": F.sum("o").over(Window.partitionBy(STUDY, b)),
            "n": F.sum("o").over(Window.partitionBy(STUDY)),
        }
    ).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    table = margins.groupBy(STUDY).agg(
        F.max("n").alias("n"),
        F.count_distinct(a).alias("n_a"),
        F.count_distinct(b).alias("n_b"),
        (F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")) + F.max("n") - F.sum("e")).alias("chi2"),
    )
    n, r, c = F.col("n"), F.col("n_a"), F.col("n_b")
    phi2 = F.col("chi2") / n
    plain = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(phi2, F.least(r, c) - 1)))
    over = F.greatest(F.lit(0.0), phi2 - F.try_divide((r - 1) * (c - 1), n - 1))
    shrunk = F.least(r - F.try_divide(F.pow(r - 1, 2), n - 1) - 1, c - F.try_divide(F.pow(c - 1, 2), n - 1) - 1)
    usable = (n > 1) & (F.least(r, c) >= 2)
    return table.withColumn("v", F.when(usable, plain).otherwise(0.0)).withColumn(
        "v_corrected", F.when(usable & (shrunk > 0), F.sqrt(F.try_divide(over, shrunk))).otherwise(0.0)
    )


def assess_confounding(samples: DataFrame, batch: str, covariates: Sequence[str], warn_at: float = 0.5) -> DataFrame:
    """One row per study and covariate: corrected V, perfect flag and grade."""
    blank = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in (batch, *covariates)])
    assert_empty(samples.where(blank), "missing batch or covariate labels")
    parts = []
    for cov in covariates:
        v = association(samples, batch, cov).select(STUDY, F.col("v_corrected").alias("cramers_v"))
        per_batch = samples.groupBy(STUDY, batch).agg(F.count_distinct(cov).alias("k"))
        perfect = per_batch.groupBy(STUDY).agg((F.max("k") == 1).alias("perfect"))
        grade = F.when(F.col("perfect"), "perfect").when(F.col("cramers_v") >= warn_at, "strong").otherwise("weak")
        parts.append(v.join(perfect, STUDY).select(STUDY, F.lit(cov).alias("covariate"), "cramers_v", "perfect", grade.alias("grade")))
    return reduce(DataFrame.unionByName, parts)


def order_statistics(samples: DataFrame, control: str, order: str = "seq_number", condition: str = "condition") -> DataFrame:
    """Per batch: ``n_control, n_other, u`` where u counts control-before-other pairs."""
    is_control = (F.col(condition) == control).cast("int")
    before = Window.partitionBy(STUDY, "batch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("_c").over(before), F.lit(0))
    return (
        samples.withColumn("_c", is_control)
        .withColumn("_seen", seen)
        .groupBy(STUDY, "batch")
        .agg(
            F.sum("_c").alias("n_control"),
            F.sum(1 - F.col("_c")).alias("n_other"),
            F.sum((1 - F.col("_c")) * F.col("_seen")).alias("u"),
        )
    )


def _order_result(us: Sequence[int], shapes: Sequence[tuple[int, int]]) -> dict:
    """p of a sum of independent per-batch U, from the convolution of their laws.

    Laws are multiplied in the frequency domain, all at once (p is then good to 1e-14). Beyond ``special.LAW_TERMS`` terms the
    sum follows the normal law of its mean and variance, with a correction of one half.
    """
    used = [(k, m) for k, m in shapes if k and m]
    u, u_max = int(sum(us)), sum(k * m for k, m in used)
    if u_max <= special.LAW_TERMS:
        law = np.ones(1)
        if len(used) == 1:
            law = special._u_law(*used[0])
        elif used:
            wave = np.ones(1)
            for k, m in used:
                wave = wave * np.fft.rfft(special._u_law(k, m), u_max + 1)
            law = np.maximum(np.fft.irfft(wave, u_max + 1), 0.0) if u_max else np.ones(1)
        grid = np.arange(u_max + 1)
        two = law[np.abs(2 * grid - u_max) >= abs(2 * u - u_max)].sum()
        one = law[grid >= u].sum() if 2 * u >= u_max else law[grid <= u].sum()
    else:
        spread = math.sqrt(sum(k * m * (k + m + 1) for k, m in used) / 12.0)
        one = float(special.norm_sf((abs(u - u_max / 2.0) - 0.5) / spread))
        two = 2 * one
    rb = 2.0 * u / u_max - 1.0 if u_max else 0.0
    direction = "undetermined" if not u_max else "control_earlier" if rb > 0 else "control_later" if rb < 0 else "no_difference"
    return {"u": u, "u_max": u_max, "rank_biserial": rb, "direction": direction, "p_one_sided": float(min(one, 1.0)), "p_two_sided": float(min(two, 1.0))}


_RESULT = "u bigint, u_max bigint, rank_biserial double, direction string, p_one_sided double, p_two_sided double"


def exact_perm(samples: DataFrame, control: str, order: str = "seq_number", condition: str = "condition") -> DataFrame:
    """Exact run-order permutation test within each batch.

    Positions are distinct, so all relabellings of a batch give the Mann-Whitney null law,
    counted by recurrence instead of enumerated.
    """

    @F.pandas_udf(_RESULT)
    def test(k: pd.Series, m: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_order_result([c], [(int(a), int(b))]) for a, b, c in zip(k, m, u)])

    stats = order_statistics(samples, control, order, condition)
    return stats.withColumn("_t", test("n_control", "n_other", "u")).select(STUDY, "batch", "n_control", "n_other", "_t.*")


def exact_perm_stratified(samples: DataFrame, control: str, order: str = "seq_number", condition: str = "condition") -> DataFrame:
    """Exact test of the summed U with relabelling inside batches, one row per study."""

    @F.pandas_udf(_RESULT)
    def test(rows: pd.Series) -> pd.DataFrame:
        parsed = [[(int(b["n_control"]), int(b["n_other"]), int(b["u"])) for b in batches] for batches in rows]
        return pd.DataFrame([_order_result([u for _, _, u in bs], [(k, m) for k, m, _ in bs]) for bs in parsed])

    stats = order_statistics(samples, control, order, condition)
    grouped = stats.groupBy(STUDY).agg(
        F.collect_list(F.struct("n_control", "n_other", "u")).alias("_b"),
        F.sum("n_control").alias("n_control"),
        F.sum("n_other").alias("n_other"),
        F.count(F.lit(1)).alias("n_batches"),
    )
    return grouped.withColumn("_t", test("_b")).select(STUDY, "n_batches", "n_control", "n_other", "_t.*")


def design_report(samples: DataFrame, control: str, treated: str) -> DataFrame:
    """Design hypotheses H1 to H5 as ``study_id, hypothesis, scope, passed, statistic``.

    H1 equal arms; H2 both arms in every batch; H3 one of each arm per pair with controls
    on odd numbers; H4 run order against condition; H5 run order equals id order.
    """
    c, t = F.col("condition") == control, F.col("condition") == treated
    row = lambda df, h, scope, passed, stat: df.select(
        STUDY, F.lit(h).alias("hypothesis"), scope.alias("scope"), passed.alias("passed"), stat.cast("string").alias("statistic")
    )
    overall = F.lit("overall")
    arms = samples.groupBy(STUDY).agg(F.count_if(c).alias("nc"), F.count_if(t).alias("nt"))
    h1 = row(arms, "H1", overall, (F.col("nc") == F.col("nt")) & (F.col("nc") > 0), F.concat_ws(",", "nc", "nt"))
    per_batch = samples.groupBy(STUDY, "batch").agg(F.count_if(c).alias("nc"), F.count_if(t).alias("nt"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "batch", "nc", "nt"))), ";")
    both = per_batch.groupBy(STUDY).agg(F.bool_and((F.col("nc") > 0) & (F.col("nt") > 0)).alias("ok"), text.alias("s"))
    h2 = row(both, "H2", overall, F.col("ok"), F.col("s"))
    pairs = samples.groupBy(STUDY, "candidate_pair").agg(
        F.count_if(c).alias("nc"), F.count_if(t).alias("nt"), F.count(F.lit(1)).alias("n"),
        F.bool_and((F.col("sample_number") % 2 == 1) == c).alias("parity"),
    )
    one_each = (F.col("nc") == 1) & (F.col("nt") == 1) & (F.col("n") == 2)
    pair_ok = pairs.groupBy(STUDY).agg(F.bool_and(one_each).alias("each"), F.bool_and("parity").alias("parity"))
    h3 = row(pair_ok, "H3", overall, F.col("each") & F.col("parity"), F.concat_ws(",", F.col("each").cast("string"), F.col("parity").cast("string")))
    separated = F.col("u").isin(0) | (F.col("u") == F.col("u_max"))
    score = F.concat(F.col("u"), F.lit("/"), F.col("u_max"))
    batches = exact_perm(samples, control)
    able = (F.col("n_control") >= 2) & (F.col("n_other") >= 2)
    h4 = row(batches, "H4", F.concat(F.lit("batch="), "batch"), F.when(able, separated), F.when(able, score).otherwise(F.concat_ws(",", "n_control", "n_other")))
    joint = exact_perm_stratified(samples, control)
    h4s = row(joint, "H4", F.lit("stratified"), F.when(F.col("u_max") > 0, separated), score)
    by_seq = F.transform(F.array_sort(F.collect_list(F.struct("seq_number", "sample_number"))), lambda s: s["sample_number"])
    ids = samples.groupBy(STUDY, "batch").agg(by_seq.alias("a"), F.array_sort(F.collect_list("sample_number")).alias("b"))
    h5 = row(ids, "H5", F.concat(F.lit("batch="), "batch"), F.col("a") == F.col("b"), F.array_join("a", ","))
    return reduce(DataFrame.unionByName, [h1, h2, h3, h4, h4s, h5])


def run_layout(samples: DataFrame) -> DataFrame:
    """Batch by run position, cell ``condition/sample``; absent positions are ''."""
    cell = F.concat_ws("/", "condition", SAMPLE)
    return samples.groupBy(STUDY, "batch").pivot("run_position_within_batch").agg(F.first(cell)).na.fill("")


def cohort_table(samples: DataFrame) -> DataFrame:
    """One row per condition: size, batch counts, sequence range, median position, ids."""
    per_batch = samples.groupBy(STUDY, "condition", "batch").agg(F.count(F.lit(1)).alias("k"))
    text = per_batch.groupBy(STUDY, "condition").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "batch", "k"))), "; ").alias("batch_counts")
    )
    main = samples.groupBy(STUDY, "condition").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("seq_number").alias("seq_number_min"),
        F.max("seq_number").alias("seq_number_max"),
        F.median("run_position_within_batch").alias("median_run_position"),
        F.array_join(F.array_sort(F.collect_list(SAMPLE)), ",").alias("sample_ids"),
    )
    return main.join(text, [STUDY, "condition"])


def join_key(samples: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """File, run id and its column names per sample, with the dump label once resolved."""
    run = F.col("search_scan_file_id").cast("string")
    keyed = samples.select(
        STUDY, "file", "search_scan_file_id", SAMPLE, "condition",
        F.concat(F.lit("Intensity_search_scan_file_id_"), run).alias("intensity_column"),
        F.concat(F.lit("Detection Type_search_scan_file_id_"), run).alias("detection_type_column"),
    )
    if labels is None:
        return keyed.withColumn("label", F.lit("UNRESOLVED"))
    return keyed.join(labels.select(STUDY, SAMPLE, "label"), [STUDY, SAMPLE], "left").withColumn(
        "label", F.coalesce("label", F.lit("UNRESOLVED"))
    )


def validate_design(samples: DataFrame, control: str, treated: str) -> DataFrame:
    """Pairs that are not one control and one treated sample inside one batch."""
    pairs = samples.groupBy(STUDY, "candidate_pair").agg(
        F.count_if(F.col("condition") == control).alias("n_control"),
        F.count_if(F.col("condition") == treated).alias("n_treated"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("batch").alias("n_batches"),
    )
    return pairs.where("not (n_control = 1 and n_treated = 1 and n = 2 and n_batches = 1)")


def pair_layout(samples: DataFrame, control: str, treated: str) -> DataFrame:
    """``study_id, pair_id, batch, control_sample, treated_sample``; every pair must be 1 + 1."""
    bad = validate_design(samples, control, treated).where("not (n_control = 1 and n_treated = 1 and n = 2)")
    assert_empty(bad, "unbalanced pairs")
    pick = lambda level: F.max(F.when(F.col("condition") == level, F.col(SAMPLE)))
    return samples.groupBy(STUDY, F.col("candidate_pair").alias("pair_id")).agg(
        F.min("batch").alias("batch"), pick(control).alias("control_sample"), pick(treated).alias("treated_sample")
    )


def pair_roles(samples: DataFrame, control: str, treated: str) -> DataFrame:
    """The layout in long form: ``study_id, sample_id, pair_id, batch, treated``."""
    bad = validate_design(samples, control, treated).where("not (n_control = 1 and n_treated = 1 and n = 2)")
    assert_empty(bad, "unbalanced pairs")
    return samples.select(
        STUDY, SAMPLE, F.col("candidate_pair").alias("pair_id"), "batch", (F.col("condition") == treated).alias("treated")
    )
