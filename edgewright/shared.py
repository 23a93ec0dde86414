"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint directory; only a plain ``local`` master (tests) has a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    app = spark.sparkContext.applicationId
    if not root and app not in _LOCAL:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="edgewright-")
    return (root or _LOCAL[app]).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: computed once, and no lineage behind it."""
    path = f"{shared_folder(df.sparkSession)}/edgewright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages that nothing refers to any more; the last plan that ran stays referenced until another has run."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()
