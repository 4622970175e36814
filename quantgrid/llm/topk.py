"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Vectors are cut into blocks, and a block keeps for each component the list of its vectors by value. For a query, a list is
read from its top where the query's component is positive and from its bottom where it is negative, all lists in step. What
has been read of a vector plus the last value read of each other list bounds its score from above; plus the worst
value of each other list, from below. Reading stops when few vectors can still reach the k-th score (the k-th
lower bound here, or the k-th score of the blocks before); only then are the final scores of those worked out. A block's
bounds are kept for all queries of a query block at once, as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrid.llm.common import materialise, ship

#: Vectors in a block of sorted lists, queries in a query block, blocks that one task searches for one query block.
BLOCK, QUERIES, SLICE = 1024, 4096, 64
#: Shares of each list after which bounds are compared.
DEPTHS = (0.5, 0.75, 0.875, 1.0)
#: Final scores are worked out once at most this share of a block can still be among the best.
FEW = 1 / 16

_LISTS = "block long, ids binary, vectors binary, lists binary"
_FOUND = "query long, query_id long, vec_id long, score long"


def whole_components(vector: Column, scale: int = 256) -> Column:
    """The components as whole numbers, floor(scale * x); null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """For each component the rows of ``vectors`` by ascending value."""
    return np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))


def search_block(vectors: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of all that can be among a query's best ``k`` in this block and score at least ``least``.

    ``own`` marks pairs of query and row that don't count. Queries whose candidates are few leave early.
    """
    n, d = vectors.shape
    values = vectors.astype(float)
    up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    # Sums of doubles round; bounds are widened by what they may lose.
    slack = 2.0**-40 * (np.abs(queries).astype(float) @ np.abs(values).max(axis=0))[:, None]
    across = np.arange(d)[:, None]
    ordered = values[lists, across]
    worst = (up @ ordered[:, 0] + down @ ordered[:, -1])[:, None]
    at = np.arange(len(queries))
    sums = np.zeros((len(queries), n))
    seen_top, seen_bottom = np.zeros((n, d)), np.zeros((n, d))
    depth, out = 0, []
    for share in DEPTHS:
        to = n if share >= 1 else int(n * share)
        if to > depth:
            for order, seen, weights in ((lists[:, ::-1], seen_top, up), (lists, seen_bottom, down)):
                rows = order[:, depth:to]
                fresh = np.zeros((n, d))
                fresh[rows, across] = values[rows, across]
                seen[rows, across] = 1
                sums += weights[at] @ fresh.T
            depth = to
        u, w = up[at], down[at]
        if depth < n:
            # What lists would give a vector that is still unread in them, less what of it has been read.
            edge_u, edge_w = u * ordered[:, min(n - depth, n - 1)], w * ordered[:, max(depth - 1, 0)]
            upper = sums + (edge_u.sum(1) + edge_w.sum(1))[:, None] - edge_u @ seen_top.T - edge_w @ seen_bottom.T + slack[at]
            lower = sums + worst[at] - (u * ordered[:, 0]) @ seen_top.T - (w * ordered[:, -1]) @ seen_bottom.T - slack[at]
        else:
            upper, lower = sums + slack[at], sums - slack[at]
        mine = own[at]
        upper[mine] = lower[mine] = -np.inf
        bar = least[at]
        if n >= k:
            bar = np.maximum(bar, np.partition(lower, n - k, axis=1)[:, n - k])
        live = (upper >= bar[:, None]) & ~mine
        done = live.sum(1) <= max(k, int(n * FEW)) if depth < n else np.ones(len(at), bool)
        if done.any():
            which, rows = np.nonzero(live[done])
            out.append((at[done][which], rows))
            at, sums = at[~done], sums[~done]
        if not len(at):
            break
    which, rows = (np.concatenate(x) for x in zip(*out, strict=True))
    scores = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), 1 << 16):  # final scores, a bounded number of pairs at a time
        part = slice(i, i + (1 << 16))
        scores[part] = (queries[which[part]] * vectors[rows[part]]).sum(1)
    return which, rows, scores


def _best(which: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then by id."""
    order = np.lexsort((ids, -scores, which))
    which, ids, scores = which[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, int)
    rank = np.arange(len(which)) - np.repeat(first, np.diff(np.r_[first, len(which)]))
    return which[rank < k], ids[rank < k], scores[rank < k]


def _packed(batches, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most ``most`` rows at a time; shorter vectors are filled up with zeros."""
    ids, rows = [], []
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            rows.append(v + [0] * (width - len(v)))
            if len(ids) == most:
                yield np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), width)
                ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), width)


def _build(table: DataFrame, width: int) -> DataFrame:
    """Blocks with their sorted lists, one row each."""

    def build(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for i, (ids, vectors) in enumerate(_packed(batches, width, BLOCK)):
            lists = sorted_lists(vectors)
            yield pa.RecordBatch.from_pylist([{"block": (task << 32) + i, "ids": ids.tobytes(), "vectors": vectors.tobytes(), "lists": lists.tobytes()}], pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("lists", pa.binary())]))

    return table.select("vec_id", "vector").mapInArrow(build, _LISTS)


def top_k(table: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``table`` where ``asked`` holds, the ``k`` rows of largest inner product.

    Of equal scores the smaller id comes first. A query's own row doesn't count, nor does another with its id; repeated rows of other
    ids count each, and a repeated query has ranks of its own. Rows with a null id or vector, or a component that is null or not finite,
    take no part. Shorter vectors count as filled up with zeros. Queries with fewer than ``k`` other rows get all of them; an empty
    table gives no rows. Other columns are left out.
    """
    spark = ship(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), whole_components(F.col(vector_col), scale).alias("vector"), asked.alias("asked"))
    rows = rows.where("vec_id is not null and vector is not null")
    about = rows.agg(F.max(F.size("vector")), F.count_if("asked"), F.count(F.lit(1))).first()
    width, n_queries, n = about[0] or 0, about[1] or 0, about[2]
    blocks = materialise(_build(rows, width))
    # Queries are dealt evenly into blocks; a slice is a bounded number of blocks, and there are enough for all tasks.
    n_query_blocks = max(1, -(-n_queries // QUERIES))
    n_blocks = max(1, blocks.count())
    slices = max(-(-n_blocks // SLICE), min(n_blocks, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // n_query_blocks)))
    queries = materialise(rows.where("asked").select("vec_id", "vector", F.monotonically_increasing_id().alias("query")))
    queries = queries.withColumn("part", F.pmod("query", F.lit(n_query_blocks)).cast("int"))
    queries = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    searched = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))

    def search(asked_rows: pa.Table, lists: pa.Table) -> pa.Table:
        names = np.array(asked_rows["query"].to_pylist(), np.int64)
        query_ids, vectors = next(_packed([asked_rows.select(["vec_id", "vector"])], width, asked_rows.num_rows + 1), (np.zeros(0, np.int64), np.zeros((0, width), np.int64)))
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ids, own, order in zip(*(lists[c].to_pylist() for c in ("ids", "vectors", "lists")), strict=True) if len(names) else ():
            ids = np.frombuffer(ids, np.int64)
            own, order = np.frombuffer(own, np.int64).reshape(len(ids), width), np.frombuffer(order, np.int32).reshape(width, len(ids))
            held = np.bincount(best[0], minlength=len(names)) == k
            least = np.full(len(names), -np.inf)
            ends = np.cumsum(np.bincount(best[0], minlength=len(names))) - 1
            least[held] = best[2][ends[held]]
            which, at, scores = search_block(own, order, vectors, query_ids[:, None] == ids[None, :], least, k)
            best = _best(np.r_[best[0], which], np.r_[best[1], ids[at]], np.r_[best[2], scores], k)
        return pa.table({"query": names[best[0]], "query_id": query_ids[best[0]], "vec_id": best[1], "score": best[2]})

    found = queries.groupBy("part", "slice").cogroup(searched.groupBy("part", "slice")).applyInArrow(search, _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_no_random_access_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
