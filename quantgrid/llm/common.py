"""What the text operators share: internal keys, shared tables, bounded offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.session import materialise, ship

__all__ = ["batch_of", "documents", "fields", "key_of", "map_batches", "materialise", "offsets_by_partition", "ship", "sorted_by_id"]

#: A null doc_id counts as the one below all others.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def key_of(id_col: str) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def fields(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, a null text as the empty one; other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """``fn`` takes and returns columns as lists, for one Arrow batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.to_pydict())
            if out:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Tuples as an Arrow batch of the schema ``name type, ...``."""
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(v), _ARROW[t]) for v, (_, t) in zip(zip(*rows, strict=True), columns, strict=True)], names=[n for n, _ in columns])


def sorted_by_id(docs: DataFrame) -> DataFrame:
    """Documents dealt in ranges of ascending doc_id, sorted within each; equal ids stay together."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


def offsets_by_partition(totals: DataFrame) -> dict[int, int]:
    """Sum of ``total`` over all partitions before each ``pid``; one row a partition reaches the driver."""
    out, at = {}, 0
    for row in sorted(totals.groupBy("pid").agg(F.sum("total").alias("total")).collect()):
        out[row.pid] = at
        at += row.total
    return out
