"""Exact quantiles, ranks and false-discovery adjustment for groups of any size.

``percentile`` and a window ordered over a whole group hold that group in one task. The
operators here count equal values before any shuffle, so a value that fills a third of the
table is one row, then count the rows of each group, and cut groups of more than
``SMALL_GROUP`` rows into value ranges, as many as the largest group needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.session import materialise

SMALL_GROUP = 100_000
ACCURACY = 10_000
MOST_RANGES = 4096  # what a sketch of ACCURACY can tell apart


def quantile_names(probs: Sequence[float]) -> list[str]:
    return [f"q{p:g}" for p in probs]


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles (type 7) per group, one row per group.

    Pass one sketches each group. Pass two collapses everything below a quantile's
    bracket to one count and keeps only the bracket itself, about 0.06 % of a large group.
    """
    keys, probs = list(keys), list(probs)
    names = list(names or quantile_names(probs))
    slack = 2.0 / ACCURACY
    edges = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    # Both passes must see the same doubles: a sum made anew can differ in its last bit.
    base = materialise(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    sketch = materialise(
        base.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.percentile_approx("_v", edges, ACCURACY).alias("_e"),
        )
    )
    small = F.col("_n") <= SMALL_GROUP
    parts = []
    for i, p in enumerate(probs):
        low = F.when(small | F.lit(p - slack <= 0), F.col("_min")).otherwise(F.col("_e")[2 * i])
        high = F.when(small | F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_e")[2 * i + 1])
        kept = F.when(F.col("_v") < low, F.lit(float("-inf"))).when(F.col("_v") <= high, F.col("_v"))
        parts.append(F.struct(F.lit(i).alias("i"), kept.alias("v")))
    joined = _join_keys(base, sketch, keys)
    counted = (
        joined.select(*keys, "_n", F.explode(F.array(*parts)).alias("_b"))
        .select(*keys, "_n", F.col("_b.i").alias("_i"), F.col("_b.v").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_n", "_i", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    placed = (
        counted.withColumn("_cum", F.sum("_c").over(w))
        .withColumn("_h", (F.col("_n") - 1) * prob)
        .withColumn("_lo", F.floor("_h"))
        .withColumn("_hi", F.ceil("_h"))
    )

    def at(rank: str) -> Column:
        inside = (F.col("_cum") - F.col("_c") <= F.col(rank)) & (F.col(rank) < F.col("_cum"))
        return F.max(F.when(inside, F.col("_v")))

    picked = placed.groupBy(*keys, "_i").agg(
        at("_lo").alias("_a"), at("_hi").alias("_z"), F.max(F.col("_h") - F.col("_lo")).alias("_f")
    )
    sound = F.col("_a").isNotNull() & F.col("_z").isNotNull() & (F.col("_a") > float("-inf"))
    exact = F.when(sound, F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).otherwise(
        F.raise_error(F.lit("quantile fell outside its bracket")).cast("double")
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, exact)).alias(n) for i, n in enumerate(names)]
    )


def group_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return group_quantiles(df, keys, value, [0.5], [name])


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join; without keys the right side is the one row of an ungrouped aggregate."""
    if keys:
        return left.join(right, list(keys), how)
    one = "_one"
    return left.withColumn(one, F.lit(1)).join(right.withColumn(one, F.lit(1)), one, how).drop(one)


def _with_range(df: DataFrame, keys: list[str], value: str, amount: Column | None = None) -> DataFrame:
    """Add ``_range``, which of the group's value ranges the row falls in, and ``_n``, the sum of ``amount`` (1 a row).

    Ranges come from a sketch of those groups that have more than ``SMALL_GROUP`` rows; others have one range.
    """
    counts = [F.sum(F.lit(1) if amount is None else amount).alias("_n"), F.count(F.lit(1)).alias("_rows")]
    sizes = materialise(df.groupBy(*keys).agg(*counts))
    most = sizes.agg(F.max("_rows")).first()[0] or 0
    out = _join_keys(df, sizes.drop("_rows"), keys).withColumn("_range", F.lit(0))
    if most <= SMALL_GROUP:
        return out
    ranges = min(MOST_RANGES, 2 ** math.ceil(math.log2(most / SMALL_GROUP)))  # a power of two, found by bisection
    large = sizes.where(F.col("_rows") > SMALL_GROUP).select(*keys)
    fractions = [i / ranges for i in range(1, ranges)]
    edges = F.percentile_approx(F.col(value).cast("double"), fractions, ACCURACY).alias("_edges")
    sketch = materialise(_join_keys(df, large, keys).groupBy(*keys).agg(edges))
    out = _join_keys(out, sketch, keys, "left")
    step = ranges // 2
    while step:
        edge = F.get("_edges", F.col("_range") + (step - 1))
        out = out.withColumn(
            "_range", F.col("_range") + F.when(edge <= F.col(value), step).otherwise(0)
        )
        step //= 2
    return out.drop("_edges")


def _offsets(counted: DataFrame, keys: list[str], amount: Column, descending: bool) -> DataFrame:
    """Rows before each range of a group; at most ``MOST_RANGES`` rows per group."""
    totals = counted.groupBy(*keys, "_range").agg(F.sum(amount).alias("_t"))
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_range", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_before"))


def distinct_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Ascending ranks of each distinct value: ``ties, n, rank_min, rank_max, rank_avg``.

    NULL values are left out. ``_range`` is kept for operators that continue by range.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).select(*keys, value)
    ties = materialise(base.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties")))
    counted = _with_range(ties, keys, value, F.col("ties"))
    w = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("ties").over(w))
    offsets = _offsets(counted, keys, F.col("ties"), descending=False)
    end = F.col("_cum") + F.col("_before")
    return ranked.join(offsets, [*keys, "_range"]).select(
        *keys,
        "_range",
        value,
        "ties",
        F.col("_n").alias("n"),
        (end - F.col("ties") + 1).alias("rank_min"),
        end.alias("rank_max"),
        (end - (F.col("ties") - 1) / 2.0).alias("rank_avg"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Add the average rank of ``value`` in its group (NULL stays NULL).

    Rows find their rank by their value, so they are written first: a sum made anew can differ in its last bit.
    """
    keys, df = list(keys), materialise(df)
    ranks = distinct_ranks(df, keys, value).select(*keys, value, F.col("rank_avg").alias(name))
    return df.join(ranks, [*keys, value], "left")


def nested_ranks(df: DataFrame, levels: Sequence[Sequence[str]], value: str, state: str, subsets: Sequence[Column]) -> DataFrame:
    """Average ranks of each value, less the group's middle rank, in nested groups and subsets: ``rank_<level>_<subset>``.

    ``levels`` go from the coarsest keys to the finest; ``subsets`` are conditions on ``state``, and rows without a state are left
    out. One row for the finest keys, value and state, all ranked by one cut into value ranges. A rank outside its subset means nothing.
    """
    finest = list(levels[-1])
    seen = df.where(F.col(state).isNotNull() & F.col(value).isNotNull())
    ties = materialise(seen.groupBy(*finest, value, state).agg(F.count(F.lit(1)).alias("_k")))
    ranged = _with_range(ties, list(levels[0]), value, F.col("_k")).drop("_n")
    ranged = ranged.withColumns({f"_k{j}": F.when(held, F.col("_k")).otherwise(0) for j, held in enumerate(subsets)})
    placed = ranged.repartition(*levels[0], "_range")  # serves the windows of all levels
    for i, keys in enumerate(levels):
        totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_k{j}").alias(f"_t{j}") for j in range(len(subsets))])
        group = Window.partitionBy(*keys)
        before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        shift = lambda j: F.coalesce(F.sum(f"_t{j}").over(before), F.lit(0)) - (F.sum(f"_t{j}").over(group) + 1) / 2.0
        shifts = materialise(totals.select(*keys, "_range", *[shift(j).alias(f"_o{j}") for j in range(len(subsets))]))
        # The default frame runs to the last row of the same value.
        upto, equal = Window.partitionBy(*keys, "_range").orderBy(value), Window.partitionBy(*keys, "_range", value)
        end = {f"rank_{i}_{j}": F.sum(f"_k{j}").over(upto) - (F.sum(f"_k{j}").over(equal) - 1) / 2.0 for j in range(len(subsets))}
        placed = placed.withColumns(end).join(shifts, [*keys, "_range"])
        placed = placed.withColumns({f"rank_{i}_{j}": F.col(f"rank_{i}_{j}") + F.col(f"_o{j}") for j in range(len(subsets))}).drop(*[f"_o{j}" for j in range(len(subsets))])
    names = [f"rank_{i}_{j}" for i in range(len(levels)) for j in range(len(subsets))]
    return placed.select(*finest, value, state, *names)


def bounded_average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average ranks for groups bounded by the number of samples of a study."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    # The default frame runs to the last tie, so its count is the highest rank of the ties.
    last = F.count(value).over(w)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), (F.rank().over(w) + last) / 2.0))


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    name: str = "position",
    descending: bool = False,
) -> DataFrame:
    """Add the 1-based position of every row in its group; ties are ordered by ``tie``.

    Also adds ``<name>_n``, the group's row count. Rows with a NULL value are left out. Ranges are counted
    and numbered in two passes over the rows, which are written first so that both see the same doubles.
    """
    keys = list(keys)
    df = materialise(df.where(F.col(value).isNotNull()))
    placed = _with_range(df, keys, value)
    order = F.col(value).desc() if descending else F.col(value).asc()
    w = Window.partitionBy(*keys, "_range").orderBy(order, *tie)
    offsets = _offsets(placed, keys, F.lit(1), descending)
    return (
        placed.withColumn("_rn", F.row_number().over(w))
        .join(offsets, [*keys, "_range"])
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("long"))
        .withColumnRenamed("_n", f"{name}_n")
        .drop("_rn", "_before", "_range")
    )


def equal_count_bins(
    df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], bins: int, name: str = "bin"
) -> DataFrame:
    """Add a 0-based bin of (nearly) equal size; the first bins take the remainder."""
    placed = row_positions(df, keys, value, tie, "_pos")
    size, extra = F.floor(F.col("_pos_n") / bins), F.col("_pos_n") % bins
    head = extra * (size + 1)
    zero_based = F.col("_pos") - 1
    index = F.when(zero_based < head, F.floor(zero_based / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(zero_based - head, size))
    )
    return placed.withColumn(name, index.cast("int")).drop("_pos", "_pos_n")


def benjamini_hochberg(
    df: DataFrame, p: str = "p", by: Sequence[str] = (), name: str = "q"
) -> DataFrame:
    """Add BH-adjusted ``p`` within each family; missing ``p`` is outside the family."""
    by = list(by)
    ranks = distinct_ranks(df, by, p).withColumn("_s", F.col(p) * F.col("n") / F.col("rank_max"))
    inside = Window.partitionBy(*by, "_range").orderBy(F.col(p).desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    later = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    tails = (
        ranks.groupBy(*by, "_range")
        .agg(F.min("_s").alias("_m"))
        .select(*by, "_range", F.min("_m").over(later).alias("_later"))
    )
    adjusted = (
        ranks.withColumn("_own", F.min("_s").over(inside))
        .join(tails, [*by, "_range"])
        .select(*by, p, F.least("_own", "_later", F.lit(1.0)).alias(name))
    )
    return df.join(adjusted, [*by, p], "left")


def ks_uniform(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov distance of each family's p-values from the uniform law."""
    r = distinct_ranks(df, by, p)
    gap = F.greatest(F.col("rank_max") / F.col("n") - F.col(p), F.col(p) - (F.col("rank_min") - 1) / F.col("n"))
    return r.groupBy(*by).agg(F.max(gap).alias("ks_distance"), F.max("n").alias("n"))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: str, name: str = "place"
) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their place.

    A group is first cut to its ``n`` first rows in each of 256 hash slices of ``spread``,
    so the last ordering sees a bounded number of rows however large the group is.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(256)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    cut = sliced.withColumn(name, F.row_number().over(inside)).where(F.col(name) <= n).drop("_slice")
    last = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(name, F.row_number().over(last)).where(F.col(name) <= n)
