"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

The packing depends on piece lengths only, and there are at most ``capacity`` of them. So the
histogram of lengths (that many rows at most) is packed on the driver: bins with equal room are
handled as ranges of bin numbers, and a segment tree over the remaining capacities finds the
tightest room that fits. The result, ranges of ranks within a length mapped to ranges of bins, is
applied to the pieces by Spark.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrid.llm.common import fields, materialise
from quantgrid.llm.tokens import encoder, vocabulary

SEQUENCE = 2048


class RoomTree:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.base)

    def set(self, room: int, is_open: bool) -> None:
        i = self.base + room
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least open capacity of at least ``need``."""
        i = self.base + need
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> tuple[dict[int, np.ndarray], int]:
    """Best-fit decreasing of ``counts`` pieces by length.

    Returns for each length the rows (first rank, first bin, offset) in order of the rank: the
    pieces from that rank on go to bins numbered from there, at that offset. And the number of bins.
    """
    tree, rooms = RoomTree(capacity), defaultdict(list)
    steps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    bins = 0

    def leave(room: int, first: int, n: int) -> None:
        if room:
            rooms[room].append((first, n))
            tree.set(room, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            each = (room or capacity) // length  # a bin just used is the tightest for the next piece, until it is full
            need = -(-left // each)
            if room is None:
                room, first, n = capacity, bins, need
                bins += n
            else:
                first, held = rooms[room].pop()
                n = min(held, need)
                if n < held:
                    rooms[room].append((first + n, held - n))
                if not rooms[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            last = left - full * each if n > full else 0  # pieces in a last bin that isn't filled
            for k in range(each):
                if m := full + (k < last):
                    steps[length].append((rank, first, capacity - room + k * length))
                    rank += m
            left -= full * each + last
            if full:
                leave(room - each * length, first, full)
            if last:
                leave(room - last * length, first + full, 1)
    return {k: np.array(v, np.int64) for k, v in steps.items()}, bins


def token_pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; ``pid`` and ``rank`` number equal lengths within a task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long" + (", ids array<int>" if keep_ids else "")
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of, pid, seen = encoder(path).ids, TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row = [doc_id, piece, at // 4, n, zlib.crc32(part), pid, seen[n]] + [np.frombuffer(part, "<i4")] * keep_ids
                    seen[n] += 1
                    for k, v in enumerate(row):
                        out[k].append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in sorted(out)], names=[x.split()[0] for x in schema.split(", ")])

    return fields(docs, id_col, text_col).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each piece of each document with its sequence and its place there.

    A document is its ids and ``end_id``; only longer ones than ``capacity`` are cut. Null and empty
    texts are the one id ``end_id``. Rows that repeat, also with equal or null doc_id, are packed one
    by one; an empty table gives no rows. Extra columns are left out.
    """
    pieces = materialise(token_pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids))
    by_task = materialise(pieces.groupBy("length", "pid").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    steps, _ = plan(counts, capacity)
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).drop("n")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, s = length == n, steps[int(n)]
                k = np.searchsorted(s[:, 0], rank[own], "right") - 1
                seq[own], off[own] = s[k, 1] + rank[own] - s[k, 0], s[k, 2]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            more = [batch.column(batch.schema.get_field_index("ids"))] * keep_ids
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off), *more], names=[x.split()[0] for x in schema.split(", ")])

    ranked = pieces.join(before, ["length", "pid"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "pid")
    return ranked.mapInArrow(place, schema)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from quantgrid.llm.common import documents

    return pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
