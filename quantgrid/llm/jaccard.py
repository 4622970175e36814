"""Near-duplicate documents: Jaccard join on five-word shingles by the chosen-path method.

Documents with equal sets are one node. Each run gives a node the buckets of those of its shingles
whose hash is below c / n: a few of its n, and the same ones in nodes that share them. A bucket of up to
``SMALL`` nodes is compared by brute force; a larger one is split again in the same way, on the shingles of the
nodes' sketches and by a hash that also depends on the path. A bucket that doesn't fall apart, since its nodes are
alike, and one that is still large at the last level is compared in blocks, all with all. Runs are repeated
until a pair at the threshold is missed with a probability below 1 - recall.

Brute force takes two steps: sketches (the least shingle in each of 64 ranges of hashes) tell which nodes have a
partner at all, and only their whole sets are then fetched and compared exactly.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quantgrid.llm.common import NULL_ID, batch_of, documents, fields, key_of, materialise
from quantgrid.llm.components import components
from quantgrid.llm.shingles import common_counts, mix, set_key, shingle_set

THRESHOLD = 0.8
#: Expected number of shingles that a node follows at each level; a pair at the threshold shares twice 1 of them or more.
FOLLOWED = 2.5
SMALL, BLOCK, DEPTH = 2048, 1024, 4
#: A sketch's ranges; sets of fewer than SURE shingles are compared exactly at once; two sketches of which less than
#: LIKE agrees are no pair at the threshold, six standard deviations away.
SLOTS, SURE, LIKE = 64, 64, 0.5
RECALL = 0.99999
#: A pair at the threshold shares 16 first buckets or more on average, so it shares fewer than SHARED with a probability
#: below 2e-5. A node with fewer buckets that it shares with anyone has no partner.
SHARED = 3


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold is missed with at most 1 - recall, however deep its path."""
    share, hit = FOLLOWED * threshold, 1.0
    for _ in range(DEPTH):
        hit = 1 - math.exp(-share * hit)
    return math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _followed(shingles: np.ndarray, path: np.uint64) -> np.ndarray:
    """Children of ``path`` that the set goes on to."""
    own = mix(shingles ^ path)
    most = min(FOLLOWED / max(len(shingles), 1), 1.0)
    return mix(own[own <= np.uint64(int(most * (2**64 - 1)) & (2**64 - 1) if most < 1 else 2**64 - 1)] + path)


def _first_paths(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of each range by its upper 31 free bits and one, 0 where there is none."""
    bounds = np.arange(SLOTS + 1, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(shingles, bounds[:-1])
    end = np.append(at[1:], len(shingles))
    out = np.zeros(SLOTS, np.uint32)
    own = at < end
    out[own] = ((shingles[at[own]] >> np.uint64(27)) & np.uint64(0x7FFFFFFF)).astype(np.uint32) | np.uint32(1 << 31)
    return out


def nodes_of(base: DataFrame, runs: int) -> DataFrame:
    """Each row's set as a key, its size, its sketch and the buckets of all runs at the first level."""

    def run(batches):
        paths = _first_paths(runs)
        for batch in batches:
            node, n, sketches, buckets = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                node.append(set_key(s))
                n.append(len(s))
                sketches.append(sketch(s).tobytes())
                buckets.append(np.unique(np.concatenate([_followed(s, p) for p in paths])).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "node", "n", "sketch", "buckets"])

    return base.mapInArrow(run, "id long, node binary, n long, sketch binary, buckets array<long>")


def _sets_of(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The shingles of the wanted nodes (node, id), from the texts of those ids."""

    def run(batches):
        last, given = None, set()
        for batch in batches:
            nodes, sets = [], []
            for doc, text, node in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle_set(text)
                if doc != last:
                    last, given = doc, set()
                if node not in given and set_key(s) == node:  # rows that repeat give it once
                    given.add(node)
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return base.join(wanted, "id").select("id", "text", "node").mapInArrow(run, "node binary, shingles array<long>")


def _split(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, child, node) of the next level."""

    def run(batches):
        slots = np.arange(SLOTS, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            parent, child, node = [], [], []
            for b, who, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(values, np.uint32)
                own = _followed((slots | values)[values > 0], np.int64(b).view(np.uint64)).view(np.int64)
                parent += [b] * len(own)
                child += own.tolist()
                node += [who] * len(own)
            if parent:
                yield pa.RecordBatch.from_arrays([pa.array(parent, pa.int64()), pa.array(child, pa.int64()), pa.array(node, pa.binary())], names=["parent", "child", "node"])

    return members.join(nodes, "node").select("bucket", "node", "sketch").mapInArrow(run, "parent long, child long, node binary").distinct()


def _grouped(batches, names: list[str], extra: str | None = None):
    """The rows of each cell, which arrive one after another; ``extra`` is a list column that becomes an array."""
    held, key = [], None
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(extra)) if extra else None
        for i, row in enumerate((batch.drop_columns([extra]) if extra else batch).to_pylist()):
            if extra:
                row[extra] = lists[i].values.to_numpy(zero_copy_only=False)
            if (own := tuple(row[c] for c in names)) != key:
                if held:
                    yield held
                held, key = [], own
            held.append(row)
    if held:
        yield held


CELL = ["bucket", "low", "high"]


def _connected(linked: np.ndarray) -> np.ndarray:
    """The least index that each row is connected to."""
    label = np.arange(len(linked))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        if (lower == label).all():
            return label
        label = lower


def _promising(cells: DataFrame, threshold: float) -> DataFrame:
    """Those members of each cell that have a partner there, as far as sizes and sketches tell.

    ``part`` is what they are connected to by such partners, so that whole sets are compared among them only.
    """
    schema = "bucket long, node binary, low int, high int, block int, part int"

    def run(batches):
        out: list[tuple] = []
        for rows in _grouped(batches, CELL):
            n = np.array([r["n"] for r in rows])
            maybe = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
            np.fill_diagonal(maybe, False)
            if rows[0]["low"] != rows[0]["high"]:
                side = np.array([r["block"] for r in rows])
                maybe &= side[:, None] != side[None, :]
            values = np.stack([np.frombuffer(r["sketch"], np.uint32) for r in rows])
            equal, none = np.zeros(maybe.shape, np.int16), np.zeros(maybe.shape, np.int16)
            for v in values.T:
                equal += v[:, None] == v[None, :]
                none += (v[:, None] == 0) & (v[None, :] == 0)
            alike = equal - none >= LIKE * (SLOTS - none)
            maybe &= alike | (np.minimum(n[:, None], n[None, :]) < SURE)
            found = zip(rows, maybe.any(1), _connected(maybe).tolist(), strict=True)
            out += [(r["bucket"], r["node"], r["low"], r["high"], r["block"], part) for r, has, part in found if has]
            if len(out) >= 20_000:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, schema)


def _compare(rows: list[dict], threshold: float) -> list[tuple[bytes, bytes, int]]:
    """Brute force in a cell: for each node with a link the first node that it is connected to here, and its links that count here.

    A pair counts in the first bucket that its two nodes share. In a cell of two blocks only pairs across count.
    """
    rows = list({r["node"]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    bucket = rows[0]["bucket"]
    sets = [r["shingles"] for r in rows]
    n = np.array([len(x) for x in sets])
    common = common_counts(sets)
    union = n[:, None] + n[None, :] - common
    linked = common >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    side = np.array([r["block"] for r in rows])
    if rows[0]["low"] != rows[0]["high"]:
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return []
    earlier = [np.array([b for b in r["owned"] if b < bucket], np.int64) for r in rows]
    counted = linked & (common_counts(earlier) == 0) if any(map(len, earlier)) else linked
    links = counted @ np.array([r["copies"] for r in rows], np.int64)
    label = _connected(linked)
    return [(r["node"], rows[label[i]]["node"], int(links[i])) for i, r in enumerate(rows) if linked[i].any()]


def _cells(cells: DataFrame, threshold: float) -> DataFrame:
    """Compare the nodes of each cell, which holds two blocks of nodes at most."""
    schema = "node binary, root binary, links long"

    def run(batches):
        out: list[tuple] = []
        for rows in _grouped(batches, [*CELL, "part"], "shingles"):
            out += _compare(rows, threshold)
            if len(out) >= 10_000:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    return cells.repartition(*CELL, "part").sortWithinPartitions(*CELL, "part").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links.

    ``n_links`` is the number of other rows whose sets of five-word shingles have a Jaccard similarity of at
    least ``threshold`` to this one's, copies included; ``class_id`` is the least doc_id of all that are
    connected by such links. A text of one to four words is one shingle; null, empty and blank texts have equal
    empty sets and are copies of each other. A null doc_id is below all others, and gives a null class_id. An empty
    table gives no rows. Other columns are left out.
    """
    return _classes(docs, threshold, recall, id_col, text_col).select(_real("id", "doc_id"), _real("class_id", "class_id"), "n_links")


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """``id, node, label, class_id, n_links`` of each row: ``node`` is the key of its set, ``label`` tells its class from all others."""
    runs = runs_for(recall, threshold)
    base = fields(docs, id_col, text_col).select(key_of("doc_id").alias("id"), "text")
    table = materialise(nodes_of(base, runs))
    nodes = materialise(table.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "sketch", "buckets")]))
    member = nodes.select(F.explode("buckets").alias("bucket"), "node")
    sizes = materialise(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    member = materialise(member.join(sizes, "bucket").drop("size"))
    enough = member.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    member = member.join(materialise(enough.select("node")), "node", "left_semi")
    sizes = materialise(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    member = materialise(member.join(sizes, "bucket"))
    sketches = nodes.select("node", "n", "sketch")

    small, stuck = [member.where(F.col("size") <= SMALL).select("bucket", "node")], []
    large = member.where(F.col("size") > SMALL)
    for level in range(DEPTH):
        if not large.limit(1).count():
            break
        if level == DEPTH - 1:
            stuck.append(large)
            break
        children = materialise(_split(large.select("bucket", "node"), sketches))
        counts = children.groupBy("parent", "child").agg(F.count("*").alias("n"))
        counts = materialise(counts.where("n > 1").join(large.select(F.col("bucket").alias("parent"), "size").distinct(), "parent"))
        whole = materialise(counts.groupBy("parent").agg(F.max(F.col("n") / F.col("size")).alias("most")).where("most >= 0.5").select("parent"))
        stuck.append(large.join(whole.withColumnRenamed("parent", "bucket"), "bucket", "left_semi"))
        apart = children.join(counts.join(whole, "parent", "left_anti"), ["parent", "child"])
        apart = materialise(apart.select(F.col("child").alias("bucket"), "node", F.col("n").alias("size")))
        small.append(apart.where(F.col("size") <= SMALL).select("bucket", "node"))
        large = apart.where(F.col("size") > SMALL)

    # Many small buckets have the same nodes: one of them is enough.
    groups = reduce(DataFrame.unionAll, small).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    groups = groups.groupBy("nodes").agg(F.min("bucket").alias("bucket"))
    cells = groups.select("bucket", F.explode("nodes").alias("node"), F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block"))
    for rows in stuck:
        k = F.ceil(F.col("size") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("node"), k).cast("int")
        dealt = rows.select("bucket", "node", block.alias("block"), F.explode(F.sequence(F.lit(0), k - 1)).alias("other"))
        cells = cells.unionAll(dealt.select("bucket", "node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block"))
    cells = materialise(_promising(cells.join(sketches, "node"), threshold))
    owned = cells.groupBy("node").agg(F.collect_set("bucket").alias("owned"))
    sets = _sets_of(base, nodes.join(cells.select("node").distinct(), "node", "left_semi").select("node", "id"))
    about = nodes.select("node", "copies").join(owned, "node").join(sets, "node")
    found = materialise(_cells(cells.join(about, "node"), threshold))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = nodes.drop("n", "sketch", "buckets").join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = materialise(nodes.select("node", "label", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = nodes.groupBy("label").agg(F.min("id").alias("class_id"))
    nodes = nodes.join(least, "label").select("node", "label", "class_id", "n_links")
    return table.select("id", "node").join(nodes, "node").select("id", "node", "label", "class_id", "n_links")


def _real(col: str, name: str) -> Column:
    return F.when(F.col(col) > NULL_ID, F.col(col)).alias(name)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class of near duplicates keeps one: a row of its least doc_id.

    A null doc_id is below all others. Rows of one doc_id whose texts are of different classes are kept or dropped each by its
    class: only for ids that repeat with different sets are those worked out again.
    """
    found = materialise(_classes(docs, threshold, RECALL, id_col, text_col).select("id", "node", "label"))
    keepers = materialise(found.groupBy("label").agg(F.min(F.struct("id", "node")).alias("_k")).select("_k.id", "_k.node"))
    mixed = materialise(found.where(F.col("id") > NULL_ID).groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("id"))

    def with_keys(batches):
        for batch in batches:
            nodes = [set_key(shingle_set(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, "_node"])

    columns = [F.col(c) for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("_row"), key_of(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    single = keyed.where(F.col("_id") > NULL_ID).join(mixed, F.col("_id") == mixed["id"], "left_anti")
    single = single.join(keepers.select("id").distinct(), F.col("_id") == F.col("id"), "left_semi").dropDuplicates(["_id"])
    several = keyed.where(F.col("_id") == NULL_ID).unionByName(keyed.where(F.col("_id") > NULL_ID).join(mixed, F.col("_id") == mixed["id"], "left_semi"))
    several = several.mapInArrow(with_keys, StructType([*several.schema.fields, StructField("_node", BinaryType())]))
    several = several.join(keepers, (F.col("_id") == F.col("id")) & (F.col("_node") == F.col("node")), "left_semi").dropDuplicates(["_id", "_node"])
    return single.select("_row.*").unionByName(several.select("_row.*"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
