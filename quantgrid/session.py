"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "quantgrid", cores: str = "*", **conf: str) -> SparkSession:
    """A small session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per session."""
    context = spark.sparkContext
    if not getattr(context, "_quantgrid_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        archive = os.path.join(folder, "quantgrid_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for root, _, files in os.walk(here):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(root, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(archive)
        context._quantgrid_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster a
    machine-local folder would be lost with its executor, so there it is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor reaches")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores: a small file is one task, however long its rows take."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    The scan has no lineage behind it and carries its true size, so Catalyst broadcasts
    it in a join only while it is below ``spark.sql.autoBroadcastJoinThreshold`` and
    shuffles otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quantgrid/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
