"""Tables in the shared folder: written and read again, so that lineage is cut and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset one that only executors on the driver's machine share."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(shared)
    return f"{shared}/{context.applicationId}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Lets Spark hand rows to Python in batches of `size`, where the session has its default of 64 MB: as objects a batch takes many times its bytes, in each of an executor's workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, size)


def checkpointed(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
