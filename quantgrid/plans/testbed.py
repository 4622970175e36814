"""The driver tables seen as measurement data (see ``TESTDATA.md``).

feature = part, sample = supplier number modulo 8, value = revenue, count = line items,
fraction = count / part size rescaled to sum 1 in a sample. Conditions alternate, pairs
are neighbouring samples and the last two samples form a second batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.functions.numeric import order_free_sum
from quantgrid.model import CELL_KEY, FEATURE, SAMPLE, STUDY, tag_scale

N_SAMPLES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study_key(kind: str) -> Column:
    """``one``: a constant; ``three``: part modulo 3; ``flag``: the return flag (sparse)."""
    return {
        "one": F.lit("s0"),
        "three": F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string")),
        "flag": F.col("l_returnflag"),
    }[kind]


def sample_key(sparse: bool) -> Column:
    number = F.col("l_suppkey") if sparse else F.col("l_suppkey") % N_SAMPLES
    return F.concat(F.lit("r"), number.cast("string"))


def base_cells(spark: SparkSession, sf_dir: str, study: str = "one", sparse: bool = False) -> DataFrame:
    """``study_id, feature_id, sample_id, value, count``."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    keyed = line.select(
        study_key(study).alias(STUDY),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias(FEATURE),
        sample_key(sparse).alias(SAMPLE),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_v"),
    )
    return keyed.groupBy(*CELL_KEY).agg(order_free_sum(F.col("_v")).alias("value"), F.count(F.lit(1)).alias("count"))


def cells(spark: SparkSession, sf_dir: str, study: str = "one", sparse: bool = False) -> DataFrame:
    return tag_scale(base_cells(spark, sf_dir, study, sparse).select(*CELL_KEY, "value"), "linear")


def samples(spark: SparkSession, sf_dir: str, study: str = "one", sparse: bool = False) -> DataFrame:
    """The sample sheet, derived from the samples that occur."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    seen = line.select(study_key(study).alias(STUDY), (F.col("l_suppkey") if sparse else F.col("l_suppkey") % N_SAMPLES).cast("int").alias("n")).distinct()
    n = F.col("n")
    return seen.select(
        STUDY,
        F.concat(F.lit("r"), n.cast("string")).alias(SAMPLE),
        F.when(n % 2 == 1, "treated").otherwise("control").alias("condition"),
        F.concat(F.lit("P"), F.floor(n / 2).cast("string")).alias("candidate_pair"),
        F.when(n < 6, "B1").otherwise("B2").alias("batch"),
        n.alias("seq_number"),
        (n + 1).alias("sample_number"),
        F.when(n < 6, n + 1).otherwise(n - 5).alias("run_position_within_batch"),
    )


def features(spark: SparkSession, sf_dir: str, study: str = "one") -> DataFrame:
    """One row per study and part that occurs, with part attributes."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    seen = line.select(study_key(study).alias(STUDY), "l_partkey").distinct()
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    joined = seen.join(part, seen["l_partkey"] == part["p_partkey"], "left")
    return joined.select(
        STUDY,
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias(FEATURE),
        "p_brand",
        "p_size",
        "p_type",
        F.coalesce(F.col("p_size") >= 48, F.lit(False)).alias("is_contaminant"),
    )
