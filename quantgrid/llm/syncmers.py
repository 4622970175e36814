"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the least of the hashes of its inner s-mers stands at its first or last
place. That depends on the k-mer alone, so equal passages give equal anchors wherever they stand. A
fingerprint holds the hashes of all of a text's anchors, each with its first place; two of them give
the share of common anchors and, from the places, the shift between the two texts. Short texts have anchors of
short k-mers besides, which are compared where both texts are short.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import batch_of, documents, fields, key_of
from quantgrid.llm.shingles import mix

K, S = 24, 8
#: Texts of fewer than SHORT code points have anchors of shorter k-mers too.
SHORT, SHORT_K, SHORT_S = 96, 6, 2
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(n)], np.uint64)


def _whole(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(points)
    whole = mix((points * _powers(n)).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else points
    return np.zeros(len(whole), np.int64), whole


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers; a text in which no k-mer is chosen is one anchor as a whole, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(points)
    if n < k:
        return _whole(points)
    step = _powers(k)
    small = points[: n - s + 1].copy()
    for i in range(1, s):
        small += points[i : n - s + 1 + i] * step[i]
    inner = k - s + 1  # s-mers in a k-mer
    order = mix(small)
    low, width = order, 1
    while width < inner:  # least of each window, in steps that double
        more = min(width, inner - width)
        low = np.minimum(low[: len(low) - more], low[more:])
        width += more
    count = n - k + 1
    place = np.nonzero((order[:count] == low) | (order[inner - 1 : inner - 1 + count] == low))[0]
    if not len(place):
        return _whole(points)
    whole = np.zeros(len(place), np.uint64)
    for i in range(0, k - s + 1, s):  # a k-mer's hash from those of s-mers that cover it
        whole += small[place + i] * step[i]
    if k % s:
        whole += small[place + k - s] * step[k - s]
    return place, mix(whole)


Part = tuple[np.ndarray, np.ndarray]


def _part(text: str, k: int, s: int) -> Part:
    """Ascending hashes of a text's anchors and the first place of each."""
    place, hashes = anchors(text, k, s)
    hashes, first = np.unique(hashes, return_index=True)
    return hashes, place[first]


def _printed(text: str) -> list[Part]:
    parts = [_part(text, K, S)]
    return parts + [_part(text, SHORT_K, SHORT_S)] if 0 < len(text) < SHORT else parts


def _shown(parts: list[Part]) -> str:
    return "|".join(" ".join(map("%016x:%d".__mod__, zip(*(x.tolist() for x in part), strict=True))) for part in parts)


def _parsed(shown: str) -> list[Part]:
    pairs = [[x.split(":") for x in part.split()] for part in shown.split("|")]
    return [(np.array([int(h, 16) for h, _ in x], np.uint64), np.array([int(p) for _, p in x], np.int64)) for x in pairs]


def fingerprint(text: str) -> str:
    """The hashes of all anchors in 16 hexadecimal digits, ascending, each with its first place; empty for an empty text.

    A text of fewer than ``SHORT`` code points has those of its short k-mers after a bar.
    """
    return _shown(_printed(text))


def _alike(one: list[Part], other: list[Part]) -> tuple[float, int | None]:
    (a, at), (b, bt) = list(zip(one, other))[-1]  # the shortest k-mers that both have
    if not len(a) or not len(b):
        return float(not len(a) and not len(b)), None
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0, None
    shifts, times = np.unique(bt[j] - at[i], return_counts=True)
    return 2 * len(common) / (len(a) + len(b)), int(shifts[np.lexsort((shifts, np.abs(shifts), -times))[0]])


def likeness(one: str, other: str) -> tuple[float, int | None]:
    """Share of common anchors (2 common / both, 0 to 1), and the shift of the places that most of them agree on.

    Two empty fingerprints are alike; an empty and another one are not.
    """
    return _alike(_parsed(one), _parsed(other))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row; null and empty texts have the empty one."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return fields(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_shift long"


def _compared(doc_id: int | None, text: str, own: list[Part], after: str, after_print: list[Part]) -> tuple:
    n = len(text)
    cut = n // 4
    edited = text[: n - cut] + after[:cut]
    edited_print = own if edited == text else _printed(edited)
    near, shift = _alike(own, edited_print)
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), _shown(own), _shown(edited_print), near, _alike(own, after_print)[0], shift


def _ranges(docs: DataFrame, n: int) -> DataFrame:
    """The documents with ``pid``, the range of doc_id a row falls in, at most ``n`` of them; and once more, with ``ends``, the first text of each range as the last row of the range before.

    Only a key a range comes to the driver; texts stay in the tasks.
    """
    keyed = docs.withColumn("_key", key_of("doc_id"))
    cuts = keyed.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])  # a bisection
    pid = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(edges, at + step - 1) <= F.col("_key"), step).otherwise(0)) if cuts else F.lit(0)
    keyed = keyed.withColumn("known", F.col("doc_id").isNotNull()).withColumn("pid", pid)
    firsts = sorted((r.pid, r["_first"].known, r["_first"]["_key"]) for r in keyed.groupBy("pid").agg(F.min(F.struct("known", "_key")).alias("_first")).collect())
    starts = docs.sparkSession.createDataFrame([(firsts[i - 1][0], known, key) for i, (_, known, key) in enumerate(firsts)], "pid int, known boolean, _key long")
    found = keyed.drop("pid").join(F.broadcast(starts), ["known", "_key"]).groupBy("pid").agg(F.min("text").alias("text"))
    rows = keyed.select("pid", "doc_id", "text", F.lit(False).alias("ends"))
    return rows.unionByName(found.select("pid", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("ends")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose last quarter is the beginning of the next document.

    Documents follow each other by ascending doc_id (null first) and, where equal, by text; after the last
    comes the first. Null texts are empty. ``near_edited`` and ``near_next`` are the likenesses to the edit and
    to the next document, ``edited_shift`` the shift between text and edit, null without common anchors. An empty table
    gives no rows; other columns are left out.

    Texts are dealt once, in ranges of doc_id, and a task pairs the texts that follow each other there. The first text of
    each range is dealt to the range before it too, as its last row, so that all texts meet their next one there.
    """
    dealt = _ranges(fields(docs, id_col, text_col), n := int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        held, out, size = None, [], 0
        for batch in batches:
            for doc_id, text, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _printed(text)
                if held:
                    out.append(_compared(*held, text, own))
                    size += len(held[1])
                held = None if ends else (doc_id, text, own)
                if len(out) >= 2000 or size > 4_000_000:
                    yield batch_of(out, _RESULT)
                    out, size = [], 0
        if out:
            yield batch_of(out, _RESULT)

    ordered = dealt.repartitionById(n, "pid").sortWithinPartitions("ends", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.select("doc_id", "text", "ends").mapInArrow(run, _RESULT)


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
