"""Documents as files of compressed token ids, and back."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quantgrid.llm.common import documents, fields, offsets_by_partition, sorted_by_id
from quantgrid.llm.idcoder import SEGMENT, decode_blocks, encode_blocks
from quantgrid.llm.tokens import encoder, vocabulary
from quantgrid.session import shared_dir

#: A row is a segment: whole documents, and their ids one after another in blocks, which can be read alone.
SEGMENTS = "pid int, first long, total long, doc_ids array<long>, lengths array<long>, blocks array<binary>"


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text, add ``end_id`` and write all ids to ``folder`` in ascending doc_id order.

    Null and empty texts are the end id alone. Rows that repeat are written as often; equal ids are
    ordered by text, a null doc_id comes first. Extra columns are left out; an empty table
    gives an empty folder. Documents are dealt in ranges of doc_id, one file a range, so the order is
    that of ``pid`` and, within it, ``first``.
    """
    def run(batches):
        encode, pid = encoder(path).ids_of, TaskContext.get().partitionId()
        first, held, lengths, names = 0, [], [], []

        def segment():
            ids = np.concatenate(held)
            row = [[pid], [first], [len(ids)], [names], [lengths], [encode_blocks(ids)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            ids, n = encode(batch.column(1))
            ends = np.cumsum(n)
            ids, n = np.insert(ids, ends, end_id), n + 1
            ends += np.arange(1, len(n) + 1)
            doc_ids, begin = batch.column(0).to_pylist(), 0
            while begin < len(n):
                # As many documents as the segment has room for, one at least.
                done = int(ends[begin] - n[begin])
                stop = int(np.searchsorted(ends, done + SEGMENT - sum(lengths), "right"))
                if stop <= begin and not held:
                    stop = begin + 1
                if stop > begin:
                    held.append(ids[done : int(ends[stop - 1])])
                    names += doc_ids[begin:stop]
                    lengths += n[begin:stop].tolist()
                    begin = stop
                if begin < len(n):
                    yield segment()
                    first, held, lengths, names = first + sum(lengths), [], [], []
        if held:
            yield segment()

    sorted_by_id(fields(docs, id_col, text_col)).mapInArrow(run, SEGMENTS).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and its ids, or their crc32."""
    before = offsets_by_partition(spark.read.schema(SEGMENTS).parquet(folder).select("pid", "total"))
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = np.concatenate(decode_blocks(r["blocks"])).astype("<u4")
                ends = np.cumsum(r["lengths"])
                parts = np.split(ids, ends[:-1])
                what = pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
                start = before[r["pid"]] + r["first"] + ends - r["lengths"]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(r["lengths"], pa.int64()), what], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.schema(SEGMENTS).parquet(folder).mapInArrow(run, schema)


def op6_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/quantgrid/ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"))
    return read_ids(spark, folder, digest=True)
