"""Tables between jobs: in the shared folder, where a lost executor does not take them along."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where tables between jobs go: the session's spark.checkpoint.dir. Where that is unset a local master (tests) gets
    a temporary folder; on a cluster it is an error, since each executor would write to its own disk."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: for tables too wide to checkpoint as rows."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
