"""Sample-by-sample tables over features, without pairing cells in a join.

A self-join on the feature would move every pair of samples of every feature through a shuffle. Here each
feature's cells are gathered once (a group bounded by the number of samples) and samples are numbered and cut
into tiles of 1,024. A feature meets each pair of tiles in which it has cells; tasks read their rows by pair of tiles, so
that they hold the sums of one pair at a time, whatever the number of samples. Sums leave a task as one packed row for each
sample and tile, and are added up in a stream of sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.model import FEATURE, SAMPLE, STUDY
from quantgrid.session import materialise

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
MIRRORED = [0, 2, 1, 4, 3, 5]  # the moments with both samples exchanged
TILE = 1024  # samples a side of a tile
BLOCK_CELLS = 4_000_000  # doubles, or pairs of cells, held at a time
PAIR_COST = 16  # dense products that cost as much as one pair added by its place

_PARTIAL = f"{STUDY} string, a int, b int, i int, sums binary"


def cross_moments(
    cells: DataFrame, x: str = "value", y: str | None = None, centre: bool = False, scale: bool = False, tile: int = TILE
) -> DataFrame:
    """Sums over features for every ordered pair of samples of a study.

    Returns ``study_id, sample_a, sample_b, n, sx, sy, sxx, syy, sxy`` where ``x`` is taken
    in sample a and ``y`` (default ``x``) in sample b, over features with both present; pairs that share no
    feature have no row. ``centre`` subtracts the feature's mean first, ``scale`` divides by its population sd.
    Values that are null or not finite are taken as absent.
    """
    same, y = y is None, y or x
    kept = materialise(cells.where(F.col(x).isNotNull() | F.col(y).isNotNull()).select(
        STUDY, FEATURE, SAMPLE, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    index = _numbered(kept, SAMPLE)
    rows = kept.join(index, [STUDY, SAMPLE]).groupBy(STUDY, FEATURE).agg(
        F.collect_list(F.struct("p", "x", "y")).alias("cells"), F.max("k").alias("ka"), F.max("k").alias("kb"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"))
    shaped = rows.select(STUDY, "ka", "kb", *[_side("cells", v, f"m{v}" if centre else None, f"d{v}" if scale else None).alias(name) for v, name in (("x", "l"), ("y", "r"))])
    return _named(_summed(shaped, MOMENTS, _add_moments, tile, MIRRORED if same else None), index, index, SAMPLE, SAMPLE, MOMENTS)


def match_counts(left: DataFrame, right: DataFrame, label: str, atol: float, rtol: float, tile: int = TILE) -> DataFrame:
    """Features that a label and a sample share, and those where ``|value - reference| <= atol + rtol * |reference|``.

    ``left``: study, feature, ``label``, value; ``right``: cells of references. A feature's references are sorted and
    each value finds its range of them, so work goes with the matches and not with labels x samples; references of
    zero, which many samples share, are counted as a product of indicators, and a cell without a reference (null) matches
    nothing. Labels without a value take no part. Returns ``study_id, label, sample_id, n, n_match``.
    """
    sides = {}
    for key, df, name in ((label, left, "l"), (SAMPLE, right, "r")):
        value = F.col("value").cast("double")
        kept = df.select(STUDY, FEATURE, key, (value if name == "l" else F.coalesce(value, F.lit(float("nan")))).alias("v"))
        kept = materialise(kept.where(F.abs("v") < float("inf")) if name == "l" else kept)
        index = _numbered(kept, key)
        side = kept.join(index, [STUDY, key]).groupBy(STUDY, FEATURE).agg(
            F.collect_list(F.struct("p", "v")).alias("cells"), F.max("k").alias("ka" if name == "l" else "kb"))
        sides[name] = (index, side.withColumnRenamed("cells", name))
    shaped = sides["l"][1].join(sides["r"][1], [STUDY, FEATURE])
    planes = ("n", "n_match")
    out = _named(_summed(shaped, planes, _match_kernel(atol, rtol), tile, None), sides["l"][0], sides["r"][0], label, SAMPLE, planes)
    return out.select(STUDY, F.col("sample_a").alias(label), F.col("sample_b").alias(SAMPLE), *[F.col(c).cast("long").alias(c) for c in planes])


def packed_features(cells: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """``study_id, p, v``: places of samples and values of a feature, a row each; and the samples' places. No nulls.

    Both are written, so that rounds over the features need no shuffle of cells. A feature is bounded by the number of samples.
    """
    kept = materialise(cells.select(STUDY, FEATURE, SAMPLE, F.col(value).cast("double").alias("v")))
    index = _numbered(kept, SAMPLE)
    rows = kept.join(index, [STUDY, SAMPLE]).groupBy(STUDY, FEATURE).agg(F.collect_list(F.struct("p", "v")).alias("_c"))
    return materialise(rows.select(STUDY, F.col("_c.p").alias("p"), F.col("_c.v").alias("v"))), index


def with_sample_values(packed: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``s``: the columns of ``table`` (study_id, p, columns) for each cell; studies that it lacks are left out."""
    own = table.groupBy(STUDY).agg(F.sort_array(F.collect_list(F.struct("p", *columns))).alias("_t"))
    at = lambda i: F.struct(*[F.get("_t", i)[c].alias(c) for c in columns])
    return packed.join(own, STUDY).select(STUDY, "p", "v", F.transform("p", at).alias("s"))


class PackedCells:
    """Cells of a batch of ``with_sample_values``: ``v`` and the columns of ``s`` by cell, ``row`` by cell, ``code`` of study and place."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("v")
        self.sizes = lists.value_lengths().to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.v = lists.flatten().to_numpy()
        values = batch.column("s").flatten()
        self.s = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
        p, study = batch.column("p").flatten().to_numpy().astype(np.int64), batch.column(STUDY).dictionary_encode()
        self.studies, self.width = study.dictionary.to_pylist(), int(p.max(initial=0)) + 1
        self.code = study.indices.to_numpy().astype(np.int64)[self.row] * self.width + p

    def named(self, code: np.ndarray) -> list[pa.Array]:
        """Study and place of each code."""
        return [pa.array([self.studies[i] for i in code // self.width], pa.string()), pa.array(code % self.width, pa.int32())]


def _numbered(cells: DataFrame, key: str) -> DataFrame:
    """``p``: the place of each id of a study in ascending order; ``k``: their number."""
    study = Window.partitionBy(STUDY)
    ids = cells.select(STUDY, key).distinct()
    return materialise(ids.withColumn("p", F.row_number().over(study.orderBy(key)) - 1).withColumn("k", F.count(F.lit(1)).over(study).cast("int")))


def _side(cells: str, value: str, mean: str | None = None, sd: str | None = None) -> Column:
    shift = lambda v: v - F.col(mean) if mean else v
    unit = lambda v: F.try_divide(v, F.col(sd)) if sd else v
    shaped = F.transform(cells, lambda c: F.struct(c["p"].alias("p"), unit(shift(c[value])).alias("v")))
    return F.filter(shaped, lambda c: F.abs(c["v"]) < float("inf"))


def _summed(rows: DataFrame, planes: tuple, add: Callable, tile: int, mirror: list[int] | None) -> DataFrame:
    """``study_id, pa, pb`` and the planes, summed over rows (study, ka, kb, l, r), for places with a first plane above 0.

    With ``mirror`` both sides are alike: only tiles b >= a are multiplied and the others are read from them.
    """
    of = lambda p: F.floor(p / tile).cast("int")
    own = lambda side: F.array_distinct(F.transform(side, lambda c: of(c["p"])))
    right = own("r")
    pairs = F.flatten(F.transform(own("l"), lambda a: F.transform(
        F.filter(right, lambda b: b >= a) if mirror else right, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = rows.withColumn("_t", F.explode(pairs)).select("*", F.col("_t.a").alias("a"), F.col("_t.b").alias("b"))
    part = lambda side, t, f: F.transform(F.filter(side, lambda c: of(c["p"]) == F.col(t)), lambda c: c[f])
    width = lambda k, t: F.least(F.lit(tile), F.col(k) - F.col(t) * tile).cast("int")
    place = lambda side, t: F.transform(part(side, t, "p"), lambda p: (p - F.col(t) * tile).cast("int"))
    shaped = met.select(
        STUDY, "a", "b", width("ka", "a").alias("wa"), width("kb", "b").alias("wb"), place("l", "a").alias("lp"), part("l", "a", "v").alias("lv"),
        place("r", "b").alias("rp"), part("r", "b", "v").alias("rv"),
    ).sortWithinPartitions(STUDY, "a", "b")
    n_planes = len(planes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            keys = batch.select([STUDY, "a", "b"]).to_pandas()
            ends = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()[1:]) + 1
            for start, end in zip([0, *ends], [*ends, len(keys)]):
                if start == end:
                    continue
                key = tuple(keys.iloc[start])
                run = batch.slice(start, end - start)
                if key != at:
                    if total is not None:
                        yield from _packed(at, total)
                    at, total = key, np.zeros((n_planes, run["wa"][0].as_py(), run["wb"][0].as_py()))
                _add_run(run, total, add)
        if total is not None:
            yield from _packed(at, total)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for study, a, b, i, sums in zip(*[batch[c].to_pylist() for c in (STUDY, "a", "b", "i", "sums")]):
                row = np.frombuffer(sums).reshape(n_planes, -1)
                if (study, a, b, i) == at:
                    total = total + row
                    continue
                if total is not None:
                    yield from _rows_of(at, total, planes, tile, mirror)
                at, total = (study, a, b, i), row
        if total is not None:
            yield from _rows_of(at, total, planes, tile, mirror)

    sums = shaped.mapInArrow(partial, _PARTIAL).repartition(STUDY, "a", "b", "i").sortWithinPartitions(STUDY, "a", "b", "i")
    return sums.mapInArrow(finish, f"{STUDY} string, pa int, pb int, " + ", ".join(f"{m} double" for m in planes))


def _packed(key: tuple, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    study, a, b = key
    used = np.flatnonzero(total[0].any(axis=1))
    for start in range(0, len(used), 64):
        rows = used[start : start + 64]
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([study] * n, pa.string()), pa.array([int(a)] * n, pa.int32()), pa.array([int(b)] * n, pa.int32()), pa.array(rows, pa.int32()),
             pa.array([np.ascontiguousarray(total[:, i]).tobytes() for i in rows], pa.binary())], names=[STUDY, "a", "b", "i", "sums"])


def _rows_of(key: tuple, total: np.ndarray, planes: tuple, tile: int, mirror: list[int] | None) -> Iterator[pa.RecordBatch]:
    study, a, b, i = key
    at = np.flatnonzero(total[0] > 0)
    here, there = np.full(len(at), a * tile + i, dtype=np.int32), (b * tile + at).astype(np.int32)
    names = [STUDY, "pa", "pb", *planes]
    study = pa.array([study] * len(at), pa.string())
    yield pa.RecordBatch.from_arrays([study, pa.array(here), pa.array(there), *[pa.array(total[m, at]) for m in range(len(planes))]], names=names)
    if mirror and a != b:
        yield pa.RecordBatch.from_arrays([study, pa.array(there), pa.array(here), *[pa.array(total[m, at]) for m in mirror]], names=names)


def _named(sums: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, planes: tuple) -> DataFrame:
    a = left.select(STUDY, F.col("p").alias("pa"), F.col(left_key).alias("sample_a"))
    b = right.select(STUDY, F.col("p").alias("pb"), F.col(right_key).alias("sample_b"))
    return sums.join(a, [STUDY, "pa"]).join(b, [STUDY, "pb"]).select(STUDY, "sample_a", "sample_b", *planes)


def _add_run(run: pa.RecordBatch, total: np.ndarray, add: Callable) -> None:
    """Add rows of one pair of tiles, a bounded number of cells at a time."""
    lists = {c: run[c] for c in ("lp", "lv", "rp", "rv")}
    flat = {c: v.flatten().to_numpy(zero_copy_only=False) for c, v in lists.items()}
    nl, nr = (lists[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lp", "rp"))
    ol, o_r = np.concatenate([[0], np.cumsum(nl)]), np.concatenate([[0], np.cumsum(nr)])
    step = max(1, BLOCK_CELLS // (4 * (total.shape[1] + total.shape[2])))
    for s in range(0, len(nl), step):
        e = min(s + step, len(nl))
        left, right = slice(ol[s], ol[e]), slice(o_r[s], o_r[e])
        add(total, nl[s:e], nr[s:e], flat["lp"][left], flat["lv"][left], flat["rp"][right], flat["rv"][right])


def _spread(counts: np.ndarray, places: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(counts), width))
    out[np.repeat(np.arange(len(counts)), counts), places] = values
    return out


def _add_moments(total, nl, nr, lp, lv, rp, rv) -> None:
    wa, wb = total.shape[1:]
    if PAIR_COST * (nl * nr).sum() > len(nl) * wa * wb:
        x, y = _spread(nl, lp, lv, wa), _spread(nr, rp, rv, wb)
        hx, hy = _spread(nl, lp, 1.0, wa), _spread(nr, rp, 1.0, wb)
        for m, (f, g) in enumerate(((hx, hy), (x, hy), (hx, y), (x * x, hy), (hx, y * y), (x, y))):
            total[m] += f.T @ g
        return
    # Few cells a row: each pair is added at its place.
    n_pairs = np.cumsum(nl * nr)
    ol, o_r = np.cumsum(nl) - nl, np.cumsum(nr) - nr
    start = 0
    while start < len(nl):
        before = n_pairs[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(n_pairs, before + BLOCK_CELLS, "right")))
        rows = np.repeat(np.arange(start, end), (nl * nr)[start:end])
        within = np.arange(len(rows)) - (n_pairs - nl * nr)[rows] + before
        i, j = ol[rows] + within // nr[rows], o_r[rows] + within % nr[rows]
        place, x, y = lp[i].astype(np.int64) * wb + rp[j], lv[i], rv[j]
        for m, w in enumerate((None, x, y, x * x, y * y, x * y)):
            total[m] += np.bincount(place, w, wa * wb).reshape(wa, wb)
        start = end


def _match_kernel(atol: float, rtol: float) -> Callable:
    def add(total, nl, nr, lp, lv, rp, rv) -> None:
        wa, wb = total.shape[1:]
        total[0] += _spread(nl, lp, 1.0, wa).T @ _spread(nr, rp, 1.0, wb)
        total[1] += _spread(nl, lp, np.abs(lv) <= atol, wa).T @ _spread(nr, rp, rv == 0, wb)
        ol, o_r = np.cumsum(nl) - nl, np.cumsum(nr) - nr
        for row in range(len(nl)):
            vals, places = lv[ol[row] : ol[row] + nl[row]], lp[ol[row] : ol[row] + nl[row]]
            refs, others = rv[o_r[row] : o_r[row] + nr[row]], rp[o_r[row] : o_r[row] + nr[row]]
            order = np.argsort(refs)
            order = order[refs[order] != 0]
            refs, others = refs[order], others[order]
            room = atol + rtol * np.abs(refs)
            # Ends of the ranges ascend with the references, as rtol is below 1.
            first, last = np.searchsorted(refs + room, vals, "left"), np.searchsorted(refs - room, vals, "right")
            count = np.maximum(last - first, 0)
            i = np.repeat(np.arange(len(vals)), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            np.add.at(total[1], (places[i], others[j]), 1.0)

    return add
