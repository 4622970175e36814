"""Cluster bootstrap: features are drawn with replacement, all cells of a feature together.

A cluster's number of copies in a draw is a Poisson count of mean one, read from a hash of seed, draw and cluster. Any task
can work it out for the clusters it holds, so weights don't move: sums over all draws are made where the data are, as one
matrix product, and only a row for each draw and group is shuffled. (The number of clusters in a draw varies by its
square root; all statistics here are ratios, so their intervals are those of draws of a fixed number.)
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.functions.numeric import finite
from quantgrid.operators.ranks import _join_keys, average_ranks
from quantgrid.session import materialise

DRAWS = 2000
#: Multipliers of the 32-bit finaliser that mixes seed, draw and cluster.
GOLDEN, MIX_A, MIX_B = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
#: Rank classes of a group in a Spearman bootstrap, and cells of a group that one task takes.
CLASSES, CELLS = 512, 524_288
_CHUNK = 256
#: Draws, cells and cells of one class whose copies are held at a time.
_STRETCH, _PIECE, _RUN = 250, 65_536, 2_048


def poisson_steps() -> list[int]:
    """A 32-bit hash gives as many copies as it reaches of these: cumulative probabilities of a Poisson count of mean one."""
    steps, total = [], 0.0
    for i in range(13):
        total += math.exp(-1) / math.factorial(i)
        steps.append(int(total * 2**32))
    return [s for s in steps if s < 2**32]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(MIX_A)
    h ^= h >> np.uint32(13)
    h *= np.uint32(MIX_B)
    h ^= h >> np.uint32(16)
    return h


def draw_hashes(words: np.ndarray, draws: int, seed: int = 0, start: int = 0) -> np.ndarray:
    """A 32-bit hash for each cluster (a row of two 32-bit words) and draw after ``start``."""
    key = _mix((np.arange(start + 1, start + draws + 1, dtype=np.uint64) * GOLDEN + seed).astype(np.uint32))
    return _mix((words[:, :1] ^ key) + words[:, 1:] * (key | np.uint32(1)))


def draw_counts(words: np.ndarray, draws: int, seed: int = 0, start: int = 0) -> np.ndarray:
    """Copies of each cluster (a row of two 32-bit words) in each draw after ``start``, as bytes."""
    out = np.empty((len(words), draws), np.uint8)
    for i in range(0, len(words), _CHUNK):
        h = draw_hashes(words[i : i + _CHUNK], draws, seed, start)
        part = np.zeros(h.shape, np.uint8)
        for s in poisson_steps():
            part += h >= np.uint32(s)
        out[i : i + _CHUNK] = part
    return out


def cluster_words(cluster: str) -> list[Column]:
    """Two 32-bit words of a cluster's name, as ``_w1`` and ``_w2``."""
    digest = F.md5(F.col(cluster).cast("string"))
    return [F.conv(F.substring(digest, i, 8), 16, 10).cast("long").alias(f"_w{1 + i // 8}") for i in (1, 9)]


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where the group changes, with the group's values."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], batch.slice(start, i - start)
                start = i


def _types(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields)


def bootstrap_sums(clusters: DataFrame, by: Sequence[str], cluster: str, columns: Sequence[str], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """``by, draw, columns``: the sum of each column over clusters, counted by their copies in the draw. One row a cluster; no nulls."""
    by, columns = list(by), list(columns)
    rows = clusters.select(*by, *cluster_words(cluster), *[F.col(c).cast("double").alias(c) for c in columns])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, types = None, None, None

        def out() -> pa.RecordBatch:
            arrays = [pa.array([v] * draws, t) for v, t in zip(held, types, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(1, draws + 1, dtype=np.int32)), *map(pa.array, total.T.copy())], names=[*by, "draw", *columns])

        for key, part in _runs(batches, by):
            if key != held:
                if held is not None:
                    yield out()
                held, total, types = key, np.zeros((draws, len(columns))), [part.schema.field(c).type for c in by]
            words = np.stack([part.column(c).to_numpy() for c in ("_w1", "_w2")], axis=1).astype(np.uint32)
            sums = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            for i in range(0, len(words), 2048):
                total += draw_counts(words[i : i + 2048], draws, seed).T.astype(float) @ sums[i : i + 2048]
        if held is not None:
            yield out()

    schema = _types(clusters, by) + "draw int, " + ", ".join(f"`{c}` double" for c in columns)
    parts = rows.sortWithinPartitions(*by).mapInArrow(add, schema) if by else rows.mapInArrow(add, schema)
    return parts.groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in columns])


def cluster_index(clusters: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """Number the clusters of each group from 0, by hash order, with the group's count.

    Numbers are dense within 256 hash slices and shifted by the slices before, so no task
    orders a whole group.
    """
    ids = clusters.select(*by, cluster).distinct().withColumn("_h", F.xxhash64(cluster)).withColumn("_s", F.pmod("_h", F.lit(256)))
    inside = Window.partitionBy(*by, "_s").orderBy("_h", cluster)
    sizes = ids.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_s", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*by)).alias("n_clusters"))
    return ids.withColumn("_rn", F.row_number().over(inside) - 1).join(shifts, [*by, "_s"]).select(
        *by, cluster, (F.col("_rn") + F.col("_before")).alias("index"), "n_clusters"
    )


def bootstrap_weights(clusters: DataFrame, by: Sequence[str], cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """``by, draw, cluster, weight``: how often each cluster is drawn when a draw has exactly as many as there are (0 is left out).

    Each cluster's slot picks one cluster per draw; the picks are counted before they move. This makes clusters x draws rows:
    for results that need the draws themselves. Sums over draws are made by ``bootstrap_sums`` without them.
    """
    index = materialise(cluster_index(clusters, by, cluster))
    slots = index.select(*by, "index", "n_clusters", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picked = slots.withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "draw", "index"), F.col("n_clusters")))
    counts = picked.groupBy(*by, "draw", "pick").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(index.select(*by, cluster, F.col("index").alias("pick")), [*by, "pick"]).drop("pick")


def percentile_ci(stats: DataFrame, by: Sequence[str], stat: str = "stat", alpha: float = 0.05) -> DataFrame:
    """Percentile interval per group over draws, whose number is a parameter; non-finite draws are dropped."""
    sound = stats.where(finite(F.col(stat)))
    ends = F.percentile(stat, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return sound.groupBy(*by).agg(ends.alias("_ci")).select(*by, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def moment_r() -> Column:
    """r from weighted sums; null for a draw without clusters."""
    n = F.nullif(F.col("n"), F.lit(0.0))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    return F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))


def bootstrap_pearson(df: DataFrame, by: Sequence[str], cluster: str, x: str, y: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Pearson r per draw from per-cluster sums: only sums are weighted, not cells.

    Values are centred on their group means first, so the sums do not cancel.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, cluster, F.col(x).alias("_x"), F.col(y).alias("_y"))
    means = materialise(both.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my")))
    rows = _join_keys(both, means, by)
    rows = rows.withColumn("_x", F.col("_x") - F.col("_mx")).withColumn("_y", F.col("_y") - F.col("_my"))
    sums = rows.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum("_y").alias("sy"),
        F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_y") * F.col("_y")).alias("syy"), F.sum(F.col("_x") * F.col("_y")).alias("sxy"),
    )
    total = bootstrap_sums(sums, by, cluster, MOMENTS, draws, seed)
    return total.select(*by, "draw", *MOMENTS, moment_r().alias("stat"))


def _mid_ranks(sums: np.ndarray) -> np.ndarray:
    """The average rank of each class in each draw."""
    return np.cumsum(sums, axis=0) - (sums - 1) / 2.0


def _class_runs(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the cells by class, and for each class the bounds of its runs."""
    order = np.argsort(classes, kind="stable")
    present, starts = np.unique(classes[order], return_index=True)
    bounds = zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True)
    return order, [(k, i, min(i + _RUN, b)) for k, a, b in bounds for i in range(a, b, _RUN)]


def _pieces(table: pa.Table) -> list[tuple]:
    """Cells of a block by cluster, a piece at a time: words of the clusters, each cell's cluster by class of x and of y with the runs, and classes of y by class of x."""
    name = (table["_w1"].to_numpy().astype(np.uint64) << np.uint64(32)) | table["_w2"].to_numpy().astype(np.uint64)
    cx, cy, order = table["_cx"].to_numpy(), table["_cy"].to_numpy(), np.argsort(name, kind="stable")
    out = []
    for i in range(0, len(order), _PIECE):
        part = order[i : i + _PIECE]
        unique, which = np.unique(name[part], return_inverse=True)
        words = np.stack([unique >> np.uint64(32), unique & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        (at_x, runs_x), (at_y, runs_y) = _class_runs(cx[part]), _class_runs(cy[part])
        out.append((words, which[at_x], runs_x, which[at_y], runs_y, cy[part][at_x]))
    return out


def _class_sums(pieces: list[tuple], draws: int, seed: int, start: int) -> np.ndarray:
    """Copies in each class of x and of y in each draw of a stretch."""
    out = np.zeros((2, CLASSES, draws), np.int64)
    for words, which_x, runs_x, which_y, runs_y, _ in pieces:
        copies = draw_counts(words, draws, seed, start)
        for sums, which, runs in ((out[0], which_x, runs_x), (out[1], which_y, runs_y)):
            held = copies[which]
            for k, a, b in runs:
                sums[k] += held[a:b].sum(0, dtype=np.int32)
    return out


def _centred(sums: np.ndarray) -> np.ndarray:
    """Ranks of the classes less the middle rank of the draw, for x and for y."""
    return np.stack([_mid_ranks(s) - (s.sum(0) + 1) / 2.0 for s in sums])


def _class_moments(sums: np.ndarray) -> list[np.ndarray]:
    """What classes tell of MOMENTS: all but the cross product."""
    (a, b), (sx, sy) = _centred(sums), sums
    return [sx.sum(0).astype(float), (sx * a).sum(0), (sy * b).sum(0), (sx * a * a).sum(0), (sy * b * b).sum(0), np.zeros(a.shape[1])]


def _cross_products(pieces: list[tuple], seed: int, start: int, sums: np.ndarray) -> np.ndarray:
    """Sum over a block's cells of the product of both centred ranks, a value a draw."""
    a, b = _centred(sums)
    total = np.zeros(a.shape[1])
    for words, which, runs, _, _, cy in pieces:
        held = draw_counts(words, len(total), seed, start)[which]
        for k, i, j in runs:
            total += a[k] * np.einsum("cd,cd->d", held[i:j], b[cy[i:j]])
    return total


def bootstrap_spearman(df: DataFrame, by: Sequence[str], cluster: str, x: str, y: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Spearman rho per draw; every draw is ranked anew, by the copies in each of ``CLASSES`` classes of neighbouring ranks.

    Values of a class count as ties. A group with at most as many cells as classes is ranked exactly; on 3,000 cells rho is
    within 2e-4 of the exact one. A group's cells are dealt in blocks of whole clusters; a group of one block
    is ranked where it is, of others the blocks' class counts are added up and sent back.
    """
    if not by:  # one group
        return bootstrap_spearman(df.withColumn("_all", F.lit(1)), ["_all"], cluster, x, y, draws, seed).drop("_all")
    by = list(by)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, cluster, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(both, by, "x", "_rx"), by, "y", "_ry")
    sizes = materialise(both.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    share = F.greatest(F.lit(1.0), F.col("_n") / CLASSES)
    place = lambda r: F.least(F.floor((F.col(r) - 0.5) / share), F.lit(CLASSES - 1)).cast("int")
    blocks = F.ceil(F.col("_n") / CELLS).cast("int")
    cells = _join_keys(ranked, sizes, by).select(
        *by, *cluster_words(cluster), place("_rx").alias("_cx"), place("_ry").alias("_cy"), blocks.alias("_blocks"), F.pmod(F.xxhash64(cluster), blocks).cast("int").alias("_block"),
    )
    cells = materialise(cells)
    types = _types(cells, by)
    moments = types + "draw int, " + ", ".join(f"{m} double" for m in MOMENTS)

    starts = range(0, draws, _STRETCH)
    width = lambda start: min(_STRETCH, draws - start)

    def named(key: tuple, table: pa.Table, columns: dict, n: int) -> pa.Table:
        keys = {c: pa.array([v.as_py()] * n, table.schema.field(c).type) for c, v in zip(by, key, strict=False)}
        return pa.table(keys | columns)

    def result(key, table, start, parts) -> pa.Table:
        at = np.arange(start + 1, start + 1 + len(parts[0]), dtype=np.int32)
        return named(key, table, {"draw": at} | dict(zip(MOMENTS, parts, strict=True)), len(at))

    def crossed(key, table, pieces, start, sums) -> pa.Table:
        cross = _cross_products(pieces, seed, start, sums)
        return result(key, table, start, [*[np.zeros(len(cross))] * (len(MOMENTS) - 1), cross])

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        pieces, out = _pieces(table), []
        for start in starts:
            sums = _class_sums(pieces, width(start), seed, start)
            out += [result(key, table, start, _class_moments(sums)), crossed(key, table, pieces, start, sums)]
        return pa.concat_tables(out)

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        pieces = _pieces(table)
        sums = [_class_sums(pieces, width(s), seed, s).tobytes() for s in starts]
        return named(key, table, {"_start": pa.array(starts, pa.int32()), "_sums": pa.array(sums, pa.binary())}, len(sums))

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table["_sums"])
        return named(key, table, {"_start": pa.array([key[-1].as_py()], pa.int32()), "_sums": pa.array([total.tobytes()], pa.binary())}, 1)

    def held(start: int, b: bytes) -> np.ndarray:
        return np.frombuffer(b, np.int64).reshape(2, CLASSES, width(start))

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        rows = zip(table["_start"].to_pylist(), table["_sums"].to_pylist(), strict=True)
        return pa.concat_tables([result(key, table, start, _class_moments(held(start, b))) for start, b in rows])

    def placed(key: tuple, table: pa.Table, sums: pa.Table) -> pa.Table:
        pieces, rows = _pieces(table), zip(sums["_start"], sums["_sums"], strict=True)
        return pa.concat_tables([crossed(key, table, pieces, start.as_py(), held(start.as_py(), b.as_py())) for start, b in rows])

    single = cells.where("_blocks = 1").groupBy(*by, "_block").applyInArrow(whole, moments)
    many = cells.where("_blocks > 1")
    partial = many.groupBy(*by, "_block").applyInArrow(counted, types + "_start int, _sums binary")
    # A stretch of draws is 2 MB a block; they are added up in steps, so that no task holds all blocks of a group.
    partial = materialise(partial.withColumn("_part", F.spark_partition_id() % 64))
    for keys in ([*by, "_part", "_start"], [*by, "_start"]):
        partial = partial.groupBy(*keys).applyInArrow(added, types + "_start int, _sums binary")
    tables = materialise(partial)
    reach = materialise(many.select(*by, "_block").distinct())
    sent = tables.join(reach, by)
    far = many.groupBy(*by, "_block").cogroup(sent.groupBy(*by, "_block")).applyInArrow(placed, moments)
    far = far.unionByName(tables.groupBy(*by, "_start").applyInArrow(summed, moments))
    total = single.unionByName(far).groupBy(*by, "draw").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    return total.select(*by, "draw", *MOMENTS, moment_r().alias("stat"))


def bootstrap_sd(df: DataFrame, by: Sequence[str], cluster: str, value: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Sample SD per draw from per-cluster sums."""
    r = bootstrap_pearson(df.withColumn("_same", F.col(value)), by, cluster, value, "_same", draws, seed)
    n = F.when(F.col("n") > 1, F.col("n"))
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1)
    return r.select(*by, "draw", F.when(n.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("stat"))
