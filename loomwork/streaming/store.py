"""Projects on disk: versions of all units, and between them a change log that tasks, jobs and streams append to.

    folder/v=3/units   the units as JSON lines, folder/v=3/meta: their schema, what the project says of itself, and which
                       batches of the log are in them; a version without its meta was never finished and isn't seen
    folder/log/batch=7 entries of one append as JSON lines {uid, t, uv, i}: i is an entry's place in its batch

A batch gets its number by a claim that only one writer can make, and its entries are there once it has succeeded; the
last entry of a uid is that of the largest (batch, i), whatever tasks wrote it and whichever ended first. A stream's
micro-batch is a batch with a name of its own, so one that is run again after a restart has the same number and is
written once. compact() writes a new version and only then deletes the batches that it has read; those appended
meanwhile stay. If it breaks off, the old version and all batches count, or the new one without the batches it names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.operators import reconcile

#: In place of the number of a named batch that has been written and dropped.
GONE = 0
ENTRY = "uid string, t string, uv int, i long"


class Folder:
    """The few calls of Hadoop's file systems that the store needs: small files and names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.has(name) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def claim(self, name: str) -> bool:
        """Makes an empty file; false if it is there already."""
        self.fs.mkdirs(self._at(name).getParent())
        try:
            self.fs.create(self._at(name), False).close()
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: it gets its name when it is complete."""
        part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(self._at(name), False)
        self.fs.rename(part, self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def placed(entries: DataFrame, order: str | Column | None) -> DataFrame:
    """entries (uid, t, uv) that have a text, with their place i: by order, or as they stand."""
    i = F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order
    uv = F.col("uv") if "uv" in entries.columns else F.lit(0)
    return entries.select("uid", "t", F.when(uv == 1, F.lit(1)).alias("uv"), i.cast("long").alias("i")).filter("uid is not null and t is not null")


class Log:
    """The change log in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path, Folder(spark, path)

    def done(self) -> list[int]:
        """Batches that have succeeded."""
        return sorted(int(n[6:]) for n in self.folder.names("") if n.startswith("batch=") and self.folder.has(f"{n}/_SUCCESS"))

    def _number(self) -> int:
        n = 1 + max([0, *(int(x) for x in self.folder.names("_claims") if x.isdigit())])
        while not self.folder.claim(f"_claims/{n}"):
            n += 1
        return n

    def append(self, entries: DataFrame, name: str | None = None, order: str | Column | None = None) -> int:
        """Adds entries (uid, t, uv) as one batch and returns how many have a text; uv is written only where it is 1. A batch whose name has been written already is left alone (-1)."""
        if name and self.folder.has(f"_names/{name}"):
            n = int(self.folder.read(f"_names/{name}"))
            if n == GONE or self.folder.has(f"batch={n}/_SUCCESS"):
                return -1
        else:
            n = self._number()
            if name:
                self.folder.write(f"_names/{name}", str(n))
        seen = Observation()
        rows = placed(entries, order).observe(seen, F.count("*").alias("n"))
        rows.write.mode("overwrite").json(f"{self.path}/batch={n}")
        return seen.get["n"]

    def read(self, without: list[int] | None = None) -> DataFrame:
        """Rows (uid, t, uv, seq) of all batches that have succeeded; what isn't an entry is left out."""
        some = [n for n in self.done() if n not in set(without or [])]
        if not some:
            return self.spark.createDataFrame([], "uid string, t string, uv int, seq struct<batch: long, i: long>")
        lines = self.spark.read.schema(ENTRY).option("basePath", self.path).json([f"{self.path}/batch={n}" for n in some])
        rows = lines.filter("uid is not null and t is not null")
        return rows.select("uid", "t", F.coalesce("uv", F.lit(0)).alias("uv"), F.struct(F.col("batch").cast("long").alias("batch"), "i").alias("seq"))

    def drop(self, batches: list[int]) -> None:
        """Deletes batches. The largest claim stays, as numbers have to grow; of the names of a stream's batches its last, which it may run again."""
        last: dict[str, int] = {}
        for name in self.folder.names("_names"):
            if int(self.folder.read(f"_names/{name}")) in batches:
                self.folder.write(f"_names/{name}", str(GONE))
            stream, _, number = name.rpartition("-")
            if number.isdigit():
                last[stream] = max(last.get(stream, 0), int(number))
        for name in self.folder.names("_names"):
            stream, _, number = name.rpartition("-")
            if number.isdigit() and int(number) < last[stream] and int(self.folder.read(f"_names/{name}")) == GONE:
                self.folder.delete(f"_names/{name}")
        for n in batches:
            self.folder.delete(f"batch={n}")
        claims = sorted(int(x) for x in self.folder.names("_claims") if x.isdigit())
        for n in claims[:-1]:
            if n in batches:
                self.folder.delete(f"_claims/{n}")


class Project:
    """Units with a key uid and a target, saved whole and changed by entries of the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder, self.log = spark, path, Folder(spark, path), Log(spark, f"{path}/log")

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self.folder.names("") if n.startswith("v=") and self.folder.has(f"{n}/meta"))

    def _meta(self) -> dict:
        found = self.versions()
        return json.loads(self.folder.read(f"v={found[-1]}/meta")) if found else {}

    def meta(self) -> dict:
        """What the project says of itself, without reading its units; empty if there is none."""
        return self._meta().get("meta", {})

    def save(self, units: DataFrame, meta: dict | None = None, holds: list[int] | None = None) -> int:
        """Writes units as the next version, with all their columns and types; holds: batches that are in them. Returns its number."""
        n = 1 + max([0, *self.versions()])
        units.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.path}/v={n}/units")
        self.folder.write(f"v={n}/meta", json.dumps({"meta": self.meta() | (meta or {}), "schema": units.schema.jsonValue(), "holds": holds or []}, ensure_ascii=False))
        return n

    def saved(self) -> DataFrame:
        """The units of the last version."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no project in {self.path}")
        return self.spark.read.schema(StructType.fromJson(self._meta()["schema"])).json(f"{self.path}/v={found[-1]}/units")

    def load(self) -> DataFrame:
        """The units with the log's last entries written in, and whether they broke a rule (unverified)."""
        return self._replayed(self.log.read(self._meta().get("holds")))

    def _replayed(self, entries: DataFrame) -> DataFrame:
        units = self.saved()
        was = F.col("unverified") if "unverified" in units.columns else F.lit(False)
        last = reconcile.latest(entries).select(F.col("uid").alias("_uid"), F.col("t").alias("_t"), (F.col("uv") == 1).alias("_uv"))
        out = units.join(last, units["uid"] == F.col("_uid"), "left")
        return out.withColumns({"target": F.coalesce("_t", "target"), "unverified": F.coalesce("_uv", was, F.lit(False))}).drop("_uid", "_t", "_uv")

    def compact(self, meta: dict | None = None) -> int:
        """A new version with all that the log has now; then the batches read and older versions go. Returns the version's number."""
        holds, before = self._meta().get("holds", []), self.versions()
        read = self.log.done()
        n = self.save(self._replayed(self.log.read(holds)), meta, sorted({*holds, *read}))
        self.log.drop(read)
        for v in before[:-1]:  # the last before this one stays, as somebody may be reading it
            self.folder.delete(f"v={v}")
        return n

    def finish(self, meta: dict | None = None) -> bool:
        """Compacts and marks the project as finished if all units, of which there must be some, have a target; else does nothing."""
        units = self.load()
        filled = F.coalesce(F.col("target"), F.lit("")) != ""
        total, done, open_ = units.agg(F.count("*"), F.count_if(filled), F.count_if(filled & F.col("unverified"))).first()
        if not total or done < total:
            return False
        self.compact({**(meta or {}), "units": total, "filled": done, "unverified": open_, "finished": True})
        return True


def into(entries: DataFrame, log: Log, name: str, checkpoint: str, order: str | None = None):
    """A query that appends a stream's entries to the log, each micro-batch once, whatever restarts come between. Start it."""

    def add(batch: DataFrame, number: int) -> None:
        log.append(batch, f"{name}-{number}", order)

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
