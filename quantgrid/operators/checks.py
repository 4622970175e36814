"""Integrity checks: each is a DataFrame of violations, empty when all is well."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.model import CELL_KEY, CheckFailed, FEATURE, SAMPLE, STUDY, scale_of


def assert_empty(violations: DataFrame, what: str) -> None:
    """Raise with up to five example rows."""
    rows = violations.take(5)
    if rows:
        raise CheckFailed(f"{what}: {[r.asDict() for r in rows]}")


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_bijection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, marked ``left_only`` or ``right_only``."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    lone = lambda x, y, tag: x.join(y, list(keys), "left_anti").withColumn("side", F.lit(tag))
    return lone(left, right, "left_only").unionByName(lone(right, left, "right_only"))


def check_cells(raw: DataFrame, text: str = "raw", nan_token: str = "NaN") -> DataFrame:
    """Blank, non-numeric or negative cells with the reason."""
    t = F.trim(F.col(text))
    number = t.try_cast("double")
    reason = (
        F.when(t == "", "blank")
        .when(t == nan_token, F.lit(None).cast("string"))
        .when(number.isNull() | F.isnan(number), "not a number")
        .when(number < 0, "negative")
    )
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def check_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside an enumerated set, with how often they occur."""
    outside = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def check_invariant(df: DataFrame, rule: Column) -> DataFrame:
    """Rows where a rule is false or undecided."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def run_checks(violations: Mapping[str, DataFrame]) -> DataFrame:
    """Evaluate every check, none short-circuited: ``name, passed, n_violations, detail``."""

    def summary(name: str, df: DataFrame) -> DataFrame:
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])) if df.columns else F.lit("{}")
        counted = df.select(row.alias("r")).agg(
            F.count(F.lit(1)).alias("n_violations"), F.min("r").alias("detail")
        )
        passed = F.col("n_violations") == 0
        return counted.select(F.lit(name).alias("name"), passed.alias("passed"), "n_violations", "detail")

    return reduce(DataFrame.unionByName, [summary(n, d) for n, d in violations.items()])


def raise_failures(results: DataFrame) -> None:
    """Raise once, listing every failed check (one row per check reaches the driver)."""
    failed = results.where(~F.col("passed")).collect()
    if failed:
        lines = "; ".join(f"{r['name']} ({r['n_violations']}): {r['detail']}" for r in failed)
        raise CheckFailed(f"{len(failed)} check(s) failed: {lines}")


def check_family_ids(header_ids: DataFrame, mapping_ids: DataFrame, key: str = "run_id") -> DataFrame:
    """Ids of a column family against the mapping: repeated, non-canonical or unmatched."""
    text = F.col(key).cast("string")
    ids = header_ids.select(text.alias(key))
    repeated = check_unique(ids, [key]).select(key, F.lit("repeated").alias("reason"))
    odd = ids.where(~F.col(key).rlike("^(0|[1-9][0-9]*)$")).select(key, F.lit("not canonical").alias("reason"))
    lone = check_bijection(ids, mapping_ids.select(text.alias(key)), [key])
    return repeated.unionByName(odd).unionByName(lone.select(key, F.col("side").alias("reason")))


def tally(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def check_tally(found: DataFrame, expected: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Groups whose count differs from an expectation; an absent group counts as 0."""
    joined = found.withColumnRenamed(count, "found").join(
        expected.withColumnRenamed(count, "expected"), list(keys), "full_outer"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = joined.select(*keys, zero("found").alias("found"), zero("expected").alias("expected"))
    return out.where("found <> expected")


def tolerance(a: Column, b: Column, rtol: float, atol: float = 0.0) -> Column:
    """NULL matches NULL; otherwise |a - b| <= atol + rtol |b|."""
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def _side_by_side(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    left = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("_in_b"))
    return left.join(right, list(keys), "full_outer")


def reconcile(
    a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], rtol: float = 1e-12, atol: float = 0.0
) -> DataFrame:
    """Cell-by-cell comparison of two parses: rows that differ or exist on one side only."""
    both = _side_by_side(a, b, keys, values)
    same = reduce(Column.__and__, [tolerance(F.col(f"{v}_a"), F.col(f"{v}_b"), rtol, atol) for v in values])
    paired = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.where(~paired | ~same).drop("_in_a", "_in_b")


def reconcile_report(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, rtol: float = 1e-12, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of compared, mismatching and one-sided rows."""
    both = _side_by_side(a, b, keys, [value])
    paired = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    same = tolerance(F.col(f"{value}_a"), F.col(f"{value}_b"), rtol)
    return both.groupBy(*by).agg(
        F.count_if(paired).alias("n_compared"),
        F.count_if(paired & ~same).alias("n_mismatch"),
        F.count_if(~paired).alias("n_one_sided"),
    )


def reconcile_sample(
    a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, n: int = 200, seed: int = 0, rtol: float = 1e-12
) -> DataFrame:
    """The comparison on ``n`` cells drawn by hash, so the draw repeats on any cluster."""
    drawn = a.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
    joined = drawn.select(*keys, F.col(value).alias("value_a")).join(
        b.select(*keys, F.col(value).alias("value_b"), F.lit(True).alias("_in_b")), list(keys), "left"
    )
    same = tolerance(F.col("value_a"), F.col("value_b"), rtol) & F.col("_in_b").isNotNull()
    return joined.withColumn("match", same).drop("_in_b")


def reconcile_totals(a: DataFrame, b: DataFrame, value: str = "value", rtol: float = 1e-9) -> DataFrame:
    """Per-sample sum and median of two parses that disagree."""
    from quantgrid.operators.ranks import group_median

    key = [STUDY, SAMPLE]

    def totals(df: DataFrame) -> DataFrame:
        summed = df.groupBy(*key).agg(F.sum(value).alias("total"))
        return summed.join(group_median(df, key, value), key, "left")

    return reconcile(totals(a), totals(b), key, ["total", "median"], rtol)


def check_shape(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Studies whose feature, sample or cell counts differ from ``n_features, n_samples``."""
    found = cells.groupBy(STUDY).agg(
        F.count_distinct(FEATURE).alias("found_features"),
        F.count_distinct(SAMPLE).alias("found_samples"),
        F.count(F.lit(1)).alias("found_cells"),
    )
    joined = found.join(expected.select(STUDY, "n_features", "n_samples"), STUDY, "full_outer")
    fits = (
        F.col("found_features").eqNullSafe(F.col("n_features"))
        & F.col("found_samples").eqNullSafe(F.col("n_samples"))
        & F.col("found_cells").eqNullSafe(F.col("n_features") * F.col("n_samples"))
    )
    return joined.where(~fits)


def check_round_trip(ids: DataFrame, rebuilt: Column, original: str) -> DataFrame:
    """Ids that their parsed parts do not put back together."""
    return ids.withColumn("rebuilt", rebuilt).where(~F.col("rebuilt").eqNullSafe(F.col(original)))


def check_same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows present on one side only, duplicates counted."""
    cols = a.columns
    lone = lambda x, y, tag: x.select(*cols).exceptAll(y.select(*cols)).withColumn("side", F.lit(tag))
    return lone(a, b, "left_only").unionByName(lone(b, a, "right_only"))


def check_pairing(samples: DataFrame, derived: DataFrame) -> DataFrame:
    """Sample sheet against a pairing re-derived from raw names and mapping."""
    keys = [c for c in ("sample_id", "run_id", "file", "condition", "candidate_pair", "batch") if c in derived.columns]
    return check_same_rows(samples.select(*keys), derived.select(*keys))


def check_crosstab(table: DataFrame, samples: DataFrame, row: str, column: str, count: str = "n") -> DataFrame:
    """A stored long crosstab against the sample sheet; absent levels count as 0."""
    return check_tally(tally(samples, [row, column]), table.select(row, column, count), [row, column], count)


def check_counts(found: DataFrame, expected: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Named counts against a table of expectations."""
    return check_tally(found, expected, keys)


def check_against(base: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-12) -> DataFrame:
    """Regression check of a result table against an earlier one."""
    return reconcile(new, base, keys, columns, rtol)


def check_inputs(states: Mapping[str, DataFrame], scale: str | None = None, same_values: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Gate before a job: all states share features and samples, listed pairs share values."""
    names = list(states)
    if scale is not None:
        for name in names:
            if scale_of(states[name]) != scale:
                raise CheckFailed(f"state {name!r} is on scale {scale_of(states[name])!r}, not {scale!r}")
    out = []
    for key in ([STUDY, SAMPLE], [STUDY, FEATURE]):
        for other in names[1:]:
            lone = check_bijection(states[names[0]], states[other], key)
            out.append(lone.select(F.lit(other).alias("state"), F.to_json(F.struct(*key)).alias("key"), "side"))
    for a, b in same_values:
        lone = check_same_rows(states[a].select(*CELL_KEY, "value"), states[b].select(*CELL_KEY, "value"))
        out.append(lone.select(F.lit(f"{a}={b}").alias("state"), F.to_json(F.struct(*CELL_KEY)).alias("key"), "side"))
    return reduce(DataFrame.unionByName, out)


def check_summary(recomputed: DataFrame, published: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float) -> DataFrame:
    """A published summary against its recomputation within an absolute tolerance."""
    if sorted(published.columns) != sorted([*keys, *columns]):
        raise CheckFailed(f"summary has columns {published.columns}, expected {[*keys, *columns]}")
    return reconcile(recomputed, published, keys, columns, 0.0, atol)


def max_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Largest absolute and relative difference per column; one-sided keys are counted."""
    both = _side_by_side(a, b, keys, columns)
    lone = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_a").cast("double").alias("a"), F.col(f"{c}_b").cast("double").alias("b"))
        for c in columns
    ])
    long = both.select(lone.alias("_lone"), F.explode(rows).alias("_r")).select("_lone", "_r.*")
    return long.groupBy("column").agg(
        F.count_if(F.col("_lone")).alias("n_one_sided"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"),
        F.max(F.abs(F.try_divide(F.col("a"), F.col("b")) - 1)).alias("max_rel_diff"),
    )


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
