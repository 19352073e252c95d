"""A journal as a stream: JSON lines are appended to a folder, the last entry of each uid is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, uid string, t string, uv int"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of all files, also of those to come. Lines that aren't entries are left out."""
    lines = spark.readStream.text(folder)
    return lines.select(F.from_json("value", SCHEMA).alias("x")).select("x.*").filter("uid is not null and t is not null")


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each uid; state holds one row a uid. Write it in update or complete mode."""
    return entries.groupBy("uid").agg(F.max_by(F.struct("t", "uv"), "seq").alias("x")).select("uid", "x.t", "x.uv")
