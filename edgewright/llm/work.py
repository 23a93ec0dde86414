"""Shared working folder and written intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    This is ``spark.checkpoint.dir`` of the session, or else the checkpoint
    directory set on the context. Only a plain ``local`` master (tests), where
    driver and executors are one process, falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="edgewright-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/edgewright-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here,
    and a lost executor costs no more than the tasks that were running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Empty tables that ``written`` gave and that nothing will read again; their files go."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


#: Rows of one number each that a broadcast may hold: some 50 MB.
SMALL_ROWS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has SMALL_ROWS rows or fewer; beyond that Spark joins by shuffle."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


def hash_bound(rows: int, of: int) -> int:
    """Bound on a hash of 63 bits below which some 1.2 ``rows`` + 100 of ``of`` rows lie: all bits count, so it holds however many rows there are."""
    return min(2**63 - 1, int(2**63 * (1.2 * rows + 100) / max(1, of)))


def hash63(column: str, salt: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(salt)), 1)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has in any case of letters."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of stages that nothing refers to any more.

    The last plan that ran stays referenced until another has run.
    """
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of ``rows`` unless the session asks for another number than Spark's default: a batch of 10,000 texts takes tens of MB several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))
