"""Tables written between steps: computed once, read again by every task, and removed when nothing reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, prefix: str = "query") -> str:
    """A new folder in spark.checkpoint.dir; where it is unset, a temporary one on a single machine and an error on a cluster."""
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='panelwright-')}"
    return f"{shared}/{prefix}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to a scratch folder and read from there, and the folder."""
    path = scratch_dir(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
