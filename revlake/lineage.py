"""Intermediate tables in the folder that driver and executors share; they cut lineage, so a lost executor costs little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a temporary one on a local master, else an error."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation of what led to it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
