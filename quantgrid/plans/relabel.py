"""The paired test under all within-pair relabellings, from one vector of pair differences a feature.

A relabelling flips the signs of some differences, so its effect is a signed sum and its residual variance follows from
that sum and the sum of squares. All 2^(pairs - 1) signed sums of a feature come from doubling: each difference is added to and
subtracted from the sums so far (the butterflies of a Walsh-Hadamard transform). Each pass makes them anew in its
tasks and moves only counts and sums for each labelling: of variances (their median, by digits of the number), of log variances
(for the prior), of p-values. With more pairs than ``most`` allows, seeded random sign patterns are taken instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.functions import special
from quantgrid.model import FEATURE, LOG_SCALES, SAMPLE, STUDY, VALUE, require_scale
from quantgrid.operators.checks import assert_empty
from quantgrid.operators.de import MIN_FEATURES, VARIANCE_FLOOR, _solve_prior
from quantgrid.operators.design import pair_roles
from quantgrid.session import materialise

LABELLINGS = 1 << 12
#: Features that one task takes, and features worked on at a time.
SLICE, _CHUNK = 16_384, 256
#: Binary digits read in one pass over the variances.
DIGITS = 12
#: Histogram bins of p, and blocks of ranks in the count of hits.
BINS, RANKS = 20, 1024
_KEY = [STUDY, "labelling"]


def sign_patterns(pairs: int, most: int = LABELLINGS, seed: int = 0) -> np.ndarray | None:
    """None if all patterns are to be taken, else ``most`` seeded ones; the first changes nothing, and no first pair is flipped."""
    if 1 << (pairs - 1) <= most:
        return None
    signs = np.where(np.random.default_rng([seed, pairs]).random((most, pairs)) < 0.5, -1.0, 1.0)
    signs[0], signs[:, 0] = 1.0, 1.0
    return signs


def signed_sums(d: np.ndarray, signs: np.ndarray | None) -> np.ndarray:
    """Sums of each row of ``d`` under each pattern; bit i - 1 of a pattern's number flips difference i."""
    if signs is not None:
        return d @ signs.T
    out = d[:, :1]
    for i in range(1, d.shape[1]):
        out = np.concatenate([out + d[:, i : i + 1], out - d[:, i : i + 1]], axis=1)
    return out


def _variances(d: np.ndarray, sums: np.ndarray) -> np.ndarray:
    k = d.shape[1]
    return np.maximum((d * d).sum(1)[:, None] - sums * sums / k, 0.0) / (2 * (k - 1))


def _sparse(counts: np.ndarray, low: np.ndarray | None = None) -> dict:
    """Non-zero counts of a labelling x bin table as columns."""
    at, bins = np.nonzero(counts)
    out = {"labelling": pa.array(at, pa.int32()), "bin": pa.array(bins, pa.int32()), "k": pa.array(counts[at, bins], pa.int64())}
    return out if low is None else out | {"low": pa.array(low[at])}


class _Passes:
    """Pair differences dealt in slices, and passes over them that give sums for each labelling."""

    def __init__(self, vectors: DataFrame, most: int, seed: int) -> None:
        counts = vectors.groupBy(STUDY).agg(F.count(F.lit(1)).alias("_m"))
        slices = materialise(counts.select(STUDY, F.ceil(F.col("_m") / SLICE).cast("int").alias("_slices")))
        dealt = vectors.join(slices, STUDY)
        self.vectors = materialise(dealt.select(STUDY, "d", F.pmod(F.xxhash64(FEATURE), F.col("_slices")).cast("int").alias("_slice")))
        self.slices = materialise(slices.select(STUDY, F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")))
        self.most, self.seed = most, seed

    def run(self, state: DataFrame | None, step: Callable, schema: str) -> DataFrame:
        """``step(d, sums, signs, state)`` for each slice; ``state`` holds columns by labelling, as arrays."""
        most, seed = self.most, self.seed

        def work(key: tuple, rows: pa.Table, held: pa.Table | None) -> pa.Table:
            if not rows.num_rows:  # a slice that no feature fell into
                return empty.empty_table()
            d = np.array(rows["d"].to_pylist(), float)
            columns = step(d, sign_patterns(d.shape[1], most, seed), None if held is None else held.sort_by("labelling").to_pandas())
            return pa.table({STUDY: pa.array([key[0].as_py()] * len(columns["labelling"]), pa.string())} | columns)

        schema = f"{STUDY} string, labelling int, {schema}"
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        empty = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
        if state is None:
            return self.vectors.groupBy(STUDY, "_slice").applyInArrow(lambda key, rows: work(key, rows, None), schema)
        sent = state.join(self.slices, STUDY)
        return self.vectors.groupBy(STUDY, "_slice").cogroup(sent.groupBy(STUDY, "_slice")).applyInArrow(work, schema)


def _digit_pass(shift: int) -> Callable:
    """Counts by the next digits of the variances (as whole numbers that order like them), below the digits known so far."""

    width, cut = DIGITS + min(shift, 0), max(shift, 0)

    def step(d, signs, known):
        n = len(sign_row(d, signs))
        counts, low = np.zeros((2 * n, 1 << width), np.int64), np.full(n, np.inf)
        for i in range(0, len(d), _CHUNK):
            part = d[i : i + _CHUNK]
            v = _variances(part, signed_sums(part, signs))
            low = np.minimum(low, v.min(0))
            bits = np.ascontiguousarray(v).view(np.int64)
            digit = (bits >> cut) & ((1 << width) - 1)
            for t in (0, 1):
                fits = np.ones(bits.shape, bool) if known is None else (bits >> (cut + width)) == known[f"prefix{t}"].to_numpy()[None, :]
                lab = np.broadcast_to(np.arange(n) * 2 + t, bits.shape)
                counts += np.bincount((lab[fits] << width) + digit[fits], minlength=counts.size).reshape(counts.shape)
        at, bins = np.nonzero(counts)
        return {"labelling": pa.array(at // 2, pa.int32()), "side": pa.array(at % 2, pa.int32()), "bin": pa.array(bins, pa.int64()), "k": pa.array(counts[at, bins], pa.int64()), "low": pa.array(low[at // 2])}

    return step


def sign_row(d: np.ndarray, signs: np.ndarray | None) -> range:
    """The labellings of vectors as long as those of ``d``."""
    return range(1 << (d.shape[1] - 1)) if signs is None else range(len(signs))


def _medians(passes: _Passes) -> DataFrame:
    """``n, low, center, floor`` by labelling: the median variance is read digit by digit, and no further than the floor needs.

    The floor is a small share of the median. Where even the largest value that the median can have puts it below the
    least variance, it changes nothing, is left at 0, and no more digits are read.
    """
    state, shift = None, 64 - DIGITS
    while True:
        width = DIGITS + min(shift, 0)
        counts = passes.run(state, _digit_pass(shift), "side int, bin long, k long, low double")
        counts = counts.groupBy(*_KEY, "side", "bin").agg(F.sum("k").alias("k"), F.min("low").alias("low"))
        if state is None:
            total = F.sum("k").over(Window.partitionBy(*_KEY, "side"))
            counts = counts.withColumn("n", total).withColumn("rank", F.floor((F.col("n") - 1 + F.col("side")) / 2)).withColumn("prefix", F.lit(0).cast("long"))
        else:
            sides = F.explode(F.array(*[F.struct(F.lit(t).alias("side"), F.col(f"rank{t}").alias("rank"), F.col(f"prefix{t}").alias("prefix")) for t in (0, 1)]))
            # The least variance is that of the first pass: a slice without these digits says nothing of it.
            counts = counts.drop("low").join(state.select(*_KEY, "n", "low", sides.alias("_s")).select(*_KEY, "n", "low", "_s.*"), [*_KEY, "side"])
        below = F.coalesce(F.sum("k").over(Window.partitionBy(*_KEY, "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        least = F.min("low").over(Window.partitionBy(*_KEY))
        here = counts.withColumn("low", least).withColumn("_b", below).where("rank >= _b and rank < _b + k")
        here = here.select(*_KEY, "side", "n", "low", (F.col("rank") - F.col("_b")).alias("rank"), (F.shiftleft("prefix", width) + F.col("bin")).alias("prefix"))
        pick = lambda c, t: F.max(F.when(F.col("side") == t, F.col(c)))
        state = here.groupBy(*_KEY).agg(F.max("n").alias("n"), F.min("low").alias("low"), *[pick(c, t).alias(f"{c}{t}") for t in (0, 1) for c in ("rank", "prefix")])
        cut = max(shift, 0)
        state = materialise(state.select("*", _number(F.shiftleft("prefix0", cut)).alias("from"), _number(F.shiftleft(F.col("prefix1") + 1, cut) - 1).alias("to")))
        open_ = (F.col("low") < VARIANCE_FLOOR * F.col("to")) & (F.lit(cut) > 0)
        if not state.where(open_).limit(1).count():
            break
        shift -= DIGITS
    median = (F.col("from") + F.col("to")) / 2
    floor = F.when(F.col("low") < VARIANCE_FLOOR * F.col("to"), VARIANCE_FLOOR * median).otherwise(0.0)
    return state.select(*_KEY, "n", F.log(F.greatest(median, F.lit(1e-300))).alias("center"), floor.alias("floor"), "to")


def _number(bits: Column) -> Column:
    """The double whose bits, as a whole number, are given."""

    @F.pandas_udf("double")
    def read(b):
        import pandas as pd

        return pd.Series(b.to_numpy(np.int64).view(np.float64))

    return read(bits)


def _prior_pass(d, signs, known):
    floor, center = known["floor"].to_numpy(), known["center"].to_numpy()
    out = np.zeros((3, len(floor)))
    for i in range(0, len(d), _CHUNK):
        part = d[i : i + _CHUNK]
        v = _variances(part, signed_sums(part, signs))
        out[2] += (v < floor).sum(0)
        z = np.log(np.maximum(v, floor)) - center
        out[0] += z.sum(0)
        out[1] += (z * z).sum(0)
    return {"labelling": pa.array(np.arange(len(floor), dtype=np.int32)), "z": pa.array(out[0]), "zz": pa.array(out[1]), "low": pa.array(out[2])}


def _p_values(d: np.ndarray, signs: np.ndarray | None, known) -> np.ndarray:
    """Moderated two-sided p of each feature (row) and labelling."""
    k = d.shape[1]
    sums = signed_sums(d, signs)
    d0, s0 = known["d0"].to_numpy(), known["s0_sq"].to_numpy()
    endless = np.isinf(d0)
    some = np.where(endless, 1.0, d0)
    post = np.where(endless, s0, (some * s0 + (k - 1) * _variances(d, sums)) / (some + k - 1))
    t = sums / k / np.sqrt(post * 2 / k)
    return special.t_two_sided(t.ravel(), np.broadcast_to(d0 + k - 1, t.shape).ravel()).reshape(t.shape)


def _p_pass(level: float) -> Callable:
    """Counts of p by histogram bin, above one half, and below ``level`` by block of the rank it needs to be a hit."""

    def step(d, signs, known):
        n, lines = known["n"].to_numpy(), len(known)
        counts = np.zeros((lines, BINS + 1 + RANKS), np.int64)
        size = np.ceil(n / RANKS)
        for i in range(0, len(d), _CHUNK):
            p = _p_values(d[i : i + _CHUNK], signs, known)
            lab = np.broadcast_to(np.arange(lines), p.shape)
            need = np.floor(p * n / level)  # a hit if more than so many p are at most as large
            block = (need // size).astype(np.int64)
            for bins, where in ((np.minimum((p * BINS).astype(int), BINS - 1), slice(None)), (np.full(p.shape, BINS), p > 0.5), (BINS + 1 + block, need < n)):
                flat = (lab * counts.shape[1] + bins)[where].ravel()
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        return _sparse(counts)

    return step


def _rank_pass(level: float) -> Callable:
    """Counts within the block that is looked at, by rank needed."""

    def step(d, signs, known):
        n, at = known["n"].to_numpy(), known["block"].to_numpy()
        size = np.ceil(n / RANKS)
        counts = np.zeros((len(known), int(size.max())), np.int64)
        for i in range(0, len(d), _CHUNK):
            need = np.floor(_p_values(d[i : i + _CHUNK], signs, known) * n / level)
            inside = (need < n) & (need // size == at)
            lab = np.broadcast_to(np.arange(len(known)), need.shape)[inside]
            flat = lab * counts.shape[1] + (need - at * size)[inside].astype(np.int64)
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        return _sparse(counts)

    return step


def _hits(passes: _Passes, prior: DataFrame, blocks: DataFrame, level: float) -> DataFrame:
    """Hits of each labelling: the largest rank i such that i p-values are below level * i / n.

    ``blocks`` counts p by the block of the rank it needs. Only a block that has enough p up to its end can hold
    that rank; from the highest one down they are opened until one does.
    """
    upto = F.sum("k").over(Window.partitionBy(*_KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    placed = blocks.withColumn("upto", upto).withColumn("size", F.ceil(F.col("n") / RANKS))
    # Ranks of a block run from block * size + 1 to (block + 1) * size; between two blocks with p, counts don't change.
    open_ = materialise(placed.where(F.col("upto") > F.col("block") * F.col("size")).select(*_KEY, "n", "size", "block", "k", "upto"))
    found = []
    while True:
        top = materialise(open_.groupBy(*_KEY).agg(F.max_by(F.struct("block", "n", "size", F.col("k").alias("own"), "upto"), "block").alias("_b")).select(*_KEY, "_b.*"))
        if not top.limit(1).count():
            break
        state = prior.join(top.select(*_KEY, "block"), _KEY, "left").withColumn("block", F.coalesce("block", F.lit(-1)))
        ranks = passes.run(state, _rank_pass(level), "bin int, k long").groupBy(*_KEY, "bin").agg(F.sum("k").alias("k")).join(top, _KEY)
        within = F.sum("k").over(Window.partitionBy(*_KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        total = F.col("upto") - F.col("own") + within
        # As many p as ``total`` need rank block * size + bin + 1 at most, so total itself is a rank that is reached if it is that high.
        good = ranks.withColumn("total", total).where(F.col("total") > F.col("block") * F.col("size") + F.col("bin"))
        best = materialise(good.groupBy(*_KEY).agg(F.max("total").alias("hits")))
        found.append(best)
        open_ = materialise(open_.join(best, _KEY, "left_anti").join(top.select(*_KEY, "block"), [*_KEY, "block"], "left_anti"))
    out = prior.select(*_KEY)
    for i, part in enumerate(found):
        out = out.join(part.withColumnRenamed("hits", f"_h{i}"), _KEY, "left")
    return out.select(*_KEY, F.coalesce(*[F.col(f"_h{i}") for i in range(len(found))], F.lit(0)).cast("long").alias("hits"))


def pair_vectors(cells: DataFrame, samples: DataFrame, control: str, treated: str) -> DataFrame:
    """study, feature and ``d``, the treated-minus-control differences in order of the pairs; features with every pair only."""
    roles = materialise(pair_roles(samples, control, treated))
    arm = lambda t: F.max(F.when(F.col("treated") == t, F.col(VALUE)))
    diffs = cells.join(roles, [STUDY, SAMPLE]).groupBy(STUDY, FEATURE, "pair_id").agg((arm(True) - arm(False)).alias("_d")).where("_d is not null")
    sizes = materialise(roles.groupBy(STUDY).agg(F.count_distinct("pair_id").alias("_pairs")))
    rows = diffs.groupBy(STUDY, FEATURE).agg(F.array_sort(F.collect_list(F.struct("pair_id", "_d"))).alias("_v")).join(sizes, STUDY)
    return rows.where(F.size("_v") == F.col("_pairs")).select(STUDY, FEATURE, F.transform("_v", lambda x: x["_d"]).alias("d"))


def relabel_pairs(cells: DataFrame, samples: DataFrame, control: str, treated: str, most: int = LABELLINGS, seed: int = 0, level: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The moderated paired test under every within-pair relabelling; the observed one is labelling 0.

    Returns ``pi0, density_first_bin, density_low_quarter, hits, d0, s0_sq, n`` by study and labelling, and the rank
    of the observed pi0 among them by study (1 is the lowest). Up to ``most`` labellings are enumerated; beyond, the observed
    one and ``most`` - 1 seeded random ones are taken.
    """
    require_scale(cells, LOG_SCALES)
    vectors = materialise(pair_vectors(cells, samples, control, treated))
    few = vectors.groupBy(STUDY).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("d")).alias("k"))
    assert_empty(few.where((F.col("n") < MIN_FEATURES) | (F.col("k") < 2)), f"fewer than {MIN_FEATURES} features or 2 pairs")
    passes = _Passes(vectors, most, seed)
    medians = _medians(passes)
    assert_empty(medians.where("to <= 0"), "more than half of the residual variances are zero")
    sums = passes.run(medians, _prior_pass, "z double, zz double, low double").groupBy(*_KEY).agg(F.sum("z").alias("z"), F.sum("zz").alias("zz"), F.sum("low").alias("n_floored"))
    sums = sums.join(medians, _KEY).join(vectors.groupBy(STUDY).agg((F.max(F.size("d")) - 1).alias("df")), STUDY)
    spread = (F.col("zz") - F.col("z") * F.col("z") / F.col("n")) / (F.col("n") - 1)
    solve = F.pandas_udf(_solve_prior, "d0 double, log_shift double")
    prior = sums.withColumn("_p", solve(spread, F.col("df").cast("double")))
    shift = F.col("center") + F.col("z") / F.col("n") + F.col("_p.log_shift")
    prior = materialise(prior.select(*_KEY, "n", "n_floored", F.col("_p.d0").alias("d0"), F.exp(shift).alias("s0_sq")))
    counts = materialise(passes.run(prior, _p_pass(level), "bin int, k long").groupBy(*_KEY, "bin").agg(F.sum("k").alias("k")))
    share = lambda where: F.sum(F.when(where, F.col("k")).otherwise(0))
    read = counts.groupBy(*_KEY).agg(share(F.col("bin") == 0).alias("_first"), share(F.col("bin") < BINS // 4).alias("_low"), share(F.col("bin") == BINS).alias("_high"))
    blocks = counts.where(F.col("bin") > BINS).join(prior.select(*_KEY, "n"), _KEY).select(*_KEY, "n", (F.col("bin") - BINS - 1).alias("block"), "k")
    out = prior.join(read, _KEY).join(_hits(passes, prior, blocks, level), _KEY)
    out = materialise(
        out.select(
            *_KEY, (F.col("labelling") == 0).alias("observed"), F.least(F.col("_high") / F.col("n") / 0.5, F.lit(1.0)).alias("pi0"), (F.col("_first") * BINS / F.col("n")).alias("density_first_bin"),
            (F.col("_low") * 4 / F.col("n")).alias("density_low_quarter"), "hits", "d0", "s0_sq", "n", "n_floored",
        )
    )
    seen = out.where("observed").select(STUDY, F.col("pi0").alias("observed_pi0"))
    ranked = out.join(seen, STUDY).groupBy(STUDY, "observed_pi0").agg(F.count(F.lit(1)).alias("n_labellings"), (1 + F.count_if(F.col("pi0") < F.col("observed_pi0"))).alias("observed_rank"))
    return out, ranked
