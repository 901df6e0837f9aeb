"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs in one process, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir). A cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share.")
        root = FALLBACK_DIR
    return f"{root.rstrip('/')}/wayfold-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether the rows are read from a table of the shared folder as they are."""
    return "written_to" in df.__dict__


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; rows that were never written stay as they are."""
    for df in tables:
        if path := df.__dict__.pop("written_to", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
