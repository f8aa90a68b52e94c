"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all work is done on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-patchloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/patchloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes df as Parquet and reads it back, which cuts its lineage and survives lost executors."""
    path, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spread(df: DataFrame, key: str, name: str = "spread") -> DataFrame:
    """df stored, in as many files at least as tasks run side by side, so that costly work over a small table uses them all.

    Where there are fewer, rows are dealt out by the hash of key and sorted by it, so reruns meet the same rows in the same order.
    """
    out, wanted = stored(df, name), df.sparkSession.sparkContext.defaultParallelism
    return out if len(out.inputFiles()) >= wanted else stored(out.repartition(wanted, key).sortWithinPartitions(key), name)
