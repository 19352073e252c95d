"""A sink for files: rows (rel, data) become files below a folder, each written only if its content differs.

A Spark data source: each task compares a row's content with the file that lies in its place, and writes new contents
to a folder of its attempt. The job's commit moves what the successful attempts wrote into place, file by file, each by
one rename; contents never go through the driver. A task or job that fails leaves no file half written, and none in
place; what was staged goes with abort(). A second run finds all files alike and writes nothing, so times of files stay,
and after a commit that broke off it moves what is missing. Staged files and reports lie in folders beside the folder;
a report has for each file whether it was written, and whether it differs from the file of that name below `source`,
which is what a package has to ship.

The folder has to be seen by the driver and all executors. Two rows of one rel, and a rel that leaves the folder, fail
the job before anything is moved.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

REPORT = "rel string, size long, sha1 string, written boolean, changed boolean"


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _same(path: str, data: bytes) -> bool:
    try:
        if os.path.getsize(path) != len(data):
            return False
        with open(path, "rb") as f:
            return f.read() == data
    except FileNotFoundError:
        return False


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    rows: int


class FileWriter(DataSourceWriter):
    def __init__(self, dest: str, source: str | None, run: str):
        self.dest, self.source, self.staging = dest, source, f"{dest}.staging-{run}"
        self.report = f"{dest}.report-{run}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        own = f"{self.staging}/{uuid.uuid4().hex}"
        os.mkdir(own)  # not its parent: a task that outlives its job's abort() ends here
        n = 0
        with open(f"{own}/report", "w", encoding="utf-8") as report:
            for n, row in enumerate(iterator, 1):
                rel, data = row["rel"], row["data"]
                data = data.encode() if isinstance(data, str) else bytes(data or b"")
                if not rel or rel.startswith("/") or any(p in ("", ".", "..") for p in rel.split("/")):
                    raise ValueError(f"not a path below the folder: {rel!r}")
                written = not _same(f"{self.dest}/{rel}", data)
                if written:
                    with open(f"{own}/{n}", "wb") as f:
                        f.write(data)
                changed = self.source is None or not _same(f"{self.source}/{rel}", data)
                report.write(json.dumps({"rel": rel, "n": n, "size": len(data), "sha1": hashlib.sha1(data).hexdigest(), "written": written, "changed": changed}) + "\n")
        return Staged(own, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves what is staged; the driver sees names, no contents."""
        parts = [m.folder for m in messages if m and m.rows]
        seen: set[str] = set()
        for part in parts:
            for r in self._reported(part):
                if r["rel"] in seen:
                    self.abort(messages)
                    raise ValueError(f"two rows of one path: {r['rel']!r}")
                seen.add(r["rel"])
        os.makedirs(self.report, exist_ok=True)
        for part in parts:
            for r in self._reported(part):
                if r["written"]:
                    to = f"{self.dest}/{r['rel']}"
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    os.replace(f"{part}/{r['n']}", to)
            os.replace(f"{part}/report", f"{self.report}/{os.path.basename(part)}.json")
        shutil.rmtree(self.staging, ignore_errors=True)

    def _reported(self, part: str) -> Iterator[dict]:
        with open(f"{part}/report", encoding="utf-8") as f:
            yield from map(json.loads, f)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FileSink(DataSource):
    """df.write.format("text_files").mode("append").option("dest", folder).save() for df (rel, data); options source and run."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if not {"rel", "data"} <= set(schema.names):
            raise ValueError("rows need the columns rel and data")
        source = self.options.get("source")
        out = FileWriter(_local(self.options["dest"]).rstrip("/"), _local(source) if source else None, self.options.get("run") or uuid.uuid4().hex)
        os.makedirs(out.staging, exist_ok=True)
        return out


def write_files(files: DataFrame, dest: str, source: str | None = None) -> DataFrame:
    """Writes files (rel, data) below dest. Rows (rel, size, sha1, written, changed), one for each: whether it was written, and whether it differs from its file below source (true without source)."""
    spark, run = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileSink)
    dest = dest.rstrip("/")
    os.makedirs(_local(dest), exist_ok=True)
    out = files.select("rel", "data").write.format("text_files").mode("append").option("dest", dest).option("run", run)
    (out.option("source", source) if source else out).save()
    return spark.read.schema(REPORT).json(f"{dest}.report-{run}")


def sink_stats(report: DataFrame) -> DataFrame:
    """One row of write_files(): files, files_written, unchanged and the names of changed ones, sorted."""
    return report.agg(F.count("*").alias("files"), F.count_if("written").alias("files_written"), F.count_if(~F.col("changed")).alias("unchanged"), F.count_if("changed").alias("changed"))
