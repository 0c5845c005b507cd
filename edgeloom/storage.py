"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = f"edgeloom-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names.

    Where nothing is set, a local master (tests, a laptop) gets a temporary folder of its
    own; on a cluster executors couldn't see each other's files there, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in this program's part of the shared folder."""
    return f"{shared_dir(spark)}/{_FOLDER}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts lineage, keeps what was computed when executors are lost, and computes each
    row once however often it is used. ``release`` deletes these tables.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this program has written by ``durable``: for when its results are stored elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_FOLDER}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
