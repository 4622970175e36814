"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches of ascending doc_id. The runs hold each key of the batches so far with the
smallest doc_id that holds it. A batch's keys are merge-joined with the runs: keys that are there keep
their owner, the others (the anti-join) are written as a new run. When a level has ``fanout`` runs they
are compacted into one of the next level. Keys are 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import documents, key_of, materialise
from quantgrid.session import shared_dir

SPACES = b" \t\n\x0b\x0c\r"
SHORTEST = 10


def line_key(line: bytes) -> bytes | None:
    """The hash of a line's key, None if the key is too short to count."""
    import xxhash

    key = line.strip(SPACES).lower()  # of bytes: only A-Z change
    if len(key) < SHORTEST or len(key) < 4 * SHORTEST and len(key.decode()) < SHORTEST:
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """Sorted runs of (hi, lo, owner) below ``folder``, by level."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3) -> None:
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("_hi long, _lo long, owner long").parquet(*paths)

    def seen(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.read(paths) if paths else None

    def write(self, keys: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{level}-{uuid.uuid4().hex}"
        keys.select("_hi", "_lo", "owner").repartition("_hi", "_lo").sortWithinPartitions("_hi", "_lo").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.write(self.read(old), level + 1)
            for p in old:  # a run that went into a higher level isn't read any more
                at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add(self, pairs: DataFrame) -> DataFrame:
        """Take in a batch of (_hi, _lo, _id); return its keys that are in 2 documents or more, with their owner."""
        fresh = pairs.groupBy("_hi", "_lo").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
        seen = self.seen()
        if seen is None:
            met = fresh.withColumn("owner", F.lit(None).cast("long"))
        else:
            met = fresh.hint("merge").join(seen, ["_hi", "_lo"], "left")
        met = materialise(met)
        self.write(met.where("owner is null").select("_hi", "_lo", F.col("first").alias("owner")), 0)
        return met.where("owner is not null or first < last").select("_hi", "_lo", F.coalesce("owner", "first").alias("owner"))


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text (or its sha256), with the columns named in ``carry``.

    A null or empty text is one empty line. Rows with one doc_id are one document, a null doc_id is
    below all others. Other columns are left out, so their names can't clash. An empty table gives no rows.
    ``batches`` is only how the work is cut; the result is the same for any number.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/quantgrid/lines-{uuid.uuid4().hex}"
    base = docs.select(key_of(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *carry)
    shares = [i / batches for i in range(1, batches)]
    cuts = (base.agg(F.percentile_approx("_id", shares, 1000)).first()[0] or []) if shares else []

    def keys(rows):
        for batch in rows:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k in map(line_key, text.encode().split(b"\n")) if k is not None}
                ids += [doc] * len(own)
                hashes += own
            if ids:
                halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                at = np.searchsorted(np.array(cuts, np.int64), np.array(ids, np.int64), "left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64())], names=["batch", "_hi", "_lo", "_id"])

    base.select("_id", "_text").mapInArrow(keys, "batch int, _hi long, _lo long, _id long").write.partitionBy("batch").parquet(f"{folder}/keys")
    pairs = spark.read.schema("_hi long, _lo long, _id long, batch int").parquet(f"{folder}/keys")
    runs, lost = LineRuns(spark, folder, fanout), []
    for i in range(batches):
        own = pairs.where(F.col("batch") == i).drop("batch")
        repeated = runs.add(own)
        lost.append(own.join(repeated, ["_hi", "_lo"]).where("_id > owner").select("_id", "_hi", "_lo"))
    by_doc = reduce(DataFrame.unionAll, lost).groupBy("_id").agg(F.collect_list("_hi").alias("_his"), F.collect_list("_lo").alias("_los"))
    out = [f.simpleString() for f in docs.select(*carry).schema.fields] if carry else []
    types = ", ".join(["doc_id long", "n_lines long", "n_dropped long", "kept_sha256 string" if digest else "text string", *(x.replace(":", " ", 1) for x in out)])

    def drop(rows):
        for batch in rows:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n_lines, n_dropped, kept = [], [], []
            for text, his, los in zip(col["_text"].to_pylist(), col["_his"].to_pylist(), col["_los"].to_pylist(), strict=True):
                lines = text.encode().split(b"\n")
                stay = lines
                if his:
                    gone = {a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True) for a, b in zip(his, los, strict=True)}
                    stay = [x for x in lines if line_key(x) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(hashlib.sha256(b"\n".join(stay)).hexdigest() if digest else b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays([col["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), *(col[c] for c in carry)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256" if digest else "text", *carry])

    return base.join(by_doc, "_id", "left").mapInArrow(drop, types)


def op3_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), digest=True)


OP3_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id > d.owner, false) AS lost FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
