"""A Merkle manifest of a table: a digest for each row, a tree for each source and one root over all sources.

Nodes of a tree come in aligned blocks of ``FANOUT ** LEVELS``. A block keeps each of its levels as one string of
concatenated hex digests (as bytes, so that a place is found without counting characters). The hashes of its
fixed-width substrings are the parents, the substrings that flank a node in its run are its siblings. The roots of
blocks are the nodes of the next round, and so on until one node is left; then the siblings go down the other way.
No text is shuffled: only digests are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrid.llm.common import documents, materialise
from quantgrid.llm.crc import CRC_SQL, crc_sql

FANOUT = 16
LEVELS = 3
WIDTH = 64
#: Fixed: the columns that a leaf covers, in this order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: dict[str, Column]) -> Column:
    """The digest of a row's values, each with its length before it; a null is a dash."""

    def part(value: Column) -> Column:
        s = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in values.values()]), 256)


def fold(leaf: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings lead to; ``sides`` has the bytes left and right of it, level by level."""
    up = lambda node, x: F.sha2(F.concat(x.left, node.cast("binary"), x.right), 256)
    return F.aggregate(sides, leaf, up)


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``idx``, the place of each node in its tree by ``order``, and ``n``, the number of nodes there.

    Nodes are dealt in ranges, so one tree may cover many tasks; only the counts of a range and tree meet.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("_range", F.shiftright("_at", 33)))
    runs = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select("tree", "_range", (F.col("_first") - before).alias("_shift"), F.sum("_rows").over(tree).alias("n")))
    return placed.join(runs, ["tree", "_range"]).withColumn("idx", F.col("_at") - F.col("_shift")).drop("_range", "_at", "_shift")


def _parents(level: Column) -> Column:
    """The next level: the hash of each run of FANOUT digests."""
    run = FANOUT * WIDTH
    starts = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each aligned block: its nodes, its levels but the last, and its root."""
    size = FANOUT**LEVELS
    rows = nodes.groupBy("tree", "n", F.floor(F.col("idx") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "node", *carry))).alias("nodes"))
    depth = sum((F.col("n") > FANOUT**i).cast("int") for i in range(LEVELS))
    leaves = F.array(F.array_join(F.transform("nodes", lambda x: x.node), "").cast("binary")).cast("array<binary>")
    steps = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), F.lit(1), depth)
    levels = F.aggregate(steps, leaves, lambda got, _: F.concat(got, F.array(_parents(F.element_at(got, -1)))).cast("array<binary>"))
    rows = rows.withColumn("_all", levels)
    return rows.select("tree", "n", "block", "nodes", F.slice("_all", F.lit(1), F.size("_all") - 1).alias("levels"), F.element_at("_all", -1).cast("string").alias("root"))


def _climb(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """Blocks of all rounds; those of the last hold whole trees."""
    rounds = []
    while True:
        blocks = materialise(_blocks(nodes, carry))
        rounds.append(blocks)
        if (blocks.agg(F.max("n")).first()[0] or 0) <= FANOUT**LEVELS:
            return rounds
        count = F.ceil(F.col("n") / FANOUT**LEVELS)
        nodes, carry = blocks.select("tree", F.col("block").alias("idx"), count.alias("n"), F.col("root").alias("node")), []


def _sides(levels: Column, place: Column) -> Column:
    """The strings left and right of a node and of those above it, within their runs."""
    widths = F.array(*[F.lit(FANOUT**i) for i in range(LEVELS)])

    def flank(level: Column, i: Column) -> Column:
        at = F.floor(place / F.element_at(widths, i + 1)).cast("int")
        own = at % FANOUT
        left = F.substring(level, (at - own) * WIDTH + 1, own * WIDTH)
        return F.struct(left.alias("left"), F.substring(level, (at + 1) * WIDTH + 1, (FANOUT - 1 - own) * WIDTH).alias("right"))

    return F.transform(levels, flank)


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with their siblings up to the root; ``above`` has those of a tree's root and what to pass down."""
    passed = [c for c in above.columns if c not in ("tree", "sides")]
    for depth, blocks in reversed(list(enumerate(rounds))):
        met = blocks.join(above, ["tree"] if depth == len(rounds) - 1 else ["tree", "block"])
        own = F.transform("nodes", lambda x: F.struct(x.alias("x"), F.concat(_sides(F.col("levels"), (x.idx % FANOUT**LEVELS).cast("int")), F.col("sides")).alias("sides")))
        out = met.select("tree", *passed, F.inline(own)).select("tree", *passed, "x.*", "sides")
        above = out if depth == 0 else materialise(out.select("tree", *passed, F.col("idx").alias("block"), "sides"))
    return above


def manifest(docs: DataFrame, source: str = "source", id_col: str = "doc_id", covered: tuple[str, ...] = COVERED, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, sides, subroot, root and the columns computed for ``carry``, which are kept small.

    ``sides`` are the siblings level by level up to the root (``fold`` takes them). Leaves ascend by id in their source,
    a null id first, equal ids by digest; rows that repeat are leaves of their own. A null source is one more source, before
    all others. Empty texts differ from null ones. A source of one row has its leaf as subroot; a table of
    one source has the subroot as root. An empty table gives no rows. Columns not named are left out, so their names can't clash.
    """
    carry = carry or {}
    tree = F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0"))
    own = [v.alias(f"_carry_{k}") for k, v in carry.items()]
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest({c: F.col(c) for c in covered}).alias("node"), F.rand(7).alias("tie"), *own)
    kept = ["doc_id", *[f"_carry_{k}" for k in carry]]
    by_source = _climb(_numbered(materialise(leaves), ["doc_id", "node", "tie"]), kept)
    subroots = by_source[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_of"), F.col("root").alias("node"))
    over_all = _climb(_numbered(subroots, ["_of"]), ["_of"])
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    top = over_all[-1].select("tree", F.col("root").alias("_root"), none.alias("sides"))
    tops = materialise(_descend(over_all, top).select(F.col("_of").alias("tree"), F.col("node").alias("subroot"), F.col("_root"), "sides"))
    found = _descend(by_source, tops)
    return found.select("doc_id", F.col("node").alias("leaf"), "sides", "subroot", F.col("_root").alias("root"), *[F.col(f"_carry_{k}").alias(k) for k in carry])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {c: F.col(c) for c in COVERED}
    tampered = leaf_digest(values | {"text": F.translate("text", UPPER, LOWER)})
    challenge = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered)
    found = manifest(documents(spark, sf_dir), carry={"challenge": challenge})
    proof = F.array_join(F.transform("sides", lambda x: F.concat(x.left, x.right).cast("string")), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold(F.coalesce("challenge", "leaf"), F.col("sides")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _part(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(c if c != "text" else text) for c in COVERED) + ")"


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
leaves AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
    {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS lowered FROM documents),
up AS (SELECT source, 0 AS lvl, idx, n, leaf AS node FROM leaves
  UNION ALL SELECT source, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY source, lvl, idx // 16, (n + 15) // 16),
heights AS (SELECT source, lvl AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, idx, n, subroot AS node FROM heights
  UNION ALL SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 16, (n + 15) // 16),
own AS (SELECT l.doc_id, l.source, l.idx, l.leaf, h.subroot, h.height, h.idx AS place, (SELECT node FROM top WHERE n = 1) AS root,
    CASE WHEN {crc_sql("l.doc_id::varchar", "c.t")} % 5 = 0 THEN l.lowered ELSE l.leaf END AS start
  FROM leaves l CROSS JOIN crc_table c JOIN heights h ON l.source IS NOT DISTINCT FROM h.source),
sides AS (SELECT o.doc_id, u.lvl, u.idx, u.node, u.idx < o.idx // (16 ** u.lvl)::bigint AS before, u.idx = o.idx // (16 ** u.lvl)::bigint AS self
    FROM own o JOIN up u ON u.source IS NOT DISTINCT FROM o.source AND u.n > 1 AND u.idx // 16 = o.idx // (16 ** (u.lvl + 1))::bigint
  UNION ALL SELECT o.doc_id, o.height + t.lvl, t.idx, t.node, t.idx < o.place // (16 ** t.lvl)::bigint, t.idx = o.place // (16 ** t.lvl)::bigint
    FROM own o JOIN top t ON t.n > 1 AND t.idx // 16 = o.place // (16 ** (t.lvl + 1))::bigint),
flanks AS (SELECT doc_id, lvl, coalesce(string_agg(node, '' ORDER BY idx) FILTER (WHERE before), '') AS l, coalesce(string_agg(node, '' ORDER BY idx) FILTER (WHERE NOT before AND NOT self), '') AS r
  FROM sides GROUP BY doc_id, lvl),
folded AS (SELECT doc_id, 0 AS lvl, start AS node FROM own
  UNION ALL SELECT f.doc_id, f.lvl + 1, sha256(k.l || f.node || k.r) FROM folded f JOIN flanks k ON k.doc_id = f.doc_id AND k.lvl = f.lvl),
proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY lvl) AS proof FROM flanks GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(node, lvl) AS folded_root FROM folded GROUP BY doc_id)
SELECT o.doc_id, o.leaf, o.subroot, o.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = o.root AS verified
FROM own o JOIN ends e USING (doc_id) LEFT JOIN proofs p USING (doc_id)"""
