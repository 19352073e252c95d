"""Listings of folders, level by level: bounded by depth, number of files and time, with the reason where a bound ended one.

Each level's folders are a table whose rows are dealt out to the tasks, which list them and give the next level's; so
many roots, or a root with many folders, are listed at once, and shallow files come first. Files of a root are numbered
by level, then folder, then name; the bound on their number keeps the first. Folders have to be seen by all executors.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.tables import checkpointed

# Folders of tools, of their outputs and backups; endings of backups.
SKIPPED_FOLDERS = ["__pycache__", ".git", ".svn", ".hg", "node_modules", "$RECYCLE.BIN", "System Volume Information", "_work", "_汉化输出", "_hanhua_output", "_汉化备份_原版"]
TOOL_BEGINNINGS, TOOL_ENDINGS = ["_汉化", "_hanhua"], ["_汉化补丁包"]
BACKUPS = [".bak", ".old", ".orig"]

FOUND = "root string, folder string, name string, is_folder boolean, size long, mtime double, late boolean"


def entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """Name, whether a folder, size and time of what a folder holds; links aren't followed, what can't be read is left out."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        yield e.name, True, 0, 0.0
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield e.name, False, s.st_size, s.st_mtime
                except OSError:  # went meanwhile
                    continue
    except OSError:  # isn't ours to read: no files, as said above
        return


def _listed(folders: DataFrame, lister, until: float, rows: int = 10_000) -> DataFrame:
    """FOUND of folders (root, folder); a folder whose turn comes after `until` gives one row, late."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for frame in frames:
            out = []
            for root, folder in zip(frame["root"], frame["folder"], strict=True):
                if time.time() >= until:
                    out.append((root, folder, "", False, 0, 0.0, True))
                    continue
                for e in lister(f"{root}/{folder}" if folder else root):
                    out.append((root, folder, *e, False))
                    if len(out) >= rows:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    return folders.mapInPandas(run, FOUND)


def _is_tools(name: Column) -> Column:
    out = name.isin(SKIPPED_FOLDERS)
    for x in TOOL_BEGINNINGS:
        out |= name.startswith(x)
    for x in TOOL_ENDINGS:
        out |= name.endswith(x)
    return out


def suffix(name: Column) -> Column:
    """A name's ending with its dot, lower-cased; empty without one, or where the dot comes first."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def listing(roots: DataFrame, depth: int = 4, most: int = 40_000, seconds: float = 20.0, lister=entries) -> tuple[DataFrame, DataFrame]:
    """Files (root, rel, depth, size, mtime, nth) of roots (root), and for each root (root, files, folders, truncated, reason).

    A root's own files have depth 0; folders deeper than `depth`, tools' folders and backups are left out. reason is
    `files` where a root has more than `most` files, `seconds` where time ran out before all its folders were listed.
    Roots that aren't there have no files. Repeated roots count once.
    """
    until = time.time() + seconds
    every = roots.select("root").filter("root is not null").distinct()
    folders = checkpointed(every.withColumn("folder", F.lit("")))
    levels = []
    for level in range(depth + 1):
        found = checkpointed(_listed(folders, lister, until).withColumn("depth", F.lit(level)))
        levels.append(found)
        deeper = found.filter(F.col("is_folder") & ~_is_tools(F.col("name")))
        path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
        folders = deeper.select("root", path.alias("folder"))
        if level == depth or folders.isEmpty():
            break
        folders = checkpointed(folders.repartition("root", "folder"))
    all_ = levels[0]
    for x in levels[1:]:
        all_ = all_.union(x)
    files = all_.filter(~F.col("is_folder") & ~F.col("late") & ~suffix(F.col("name")).isin(BACKUPS))
    # Numbers by counts of folders, so that only the files of one folder are sorted in a task.
    counts = files.groupBy("root", "depth", "folder").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("root").orderBy("depth", "folder").rowsBetween(W.unboundedPreceding, -1))
    counts = checkpointed(counts.withColumn("before", F.coalesce(before, F.lit(0))))
    nth = F.col("before") + F.row_number().over(W.partitionBy("root", "depth", "folder").orderBy("name"))
    some = files.join(counts.filter(F.col("before") < most).drop("n"), ["root", "depth", "folder"]).withColumn("nth", nth).filter(F.col("nth") <= most)
    rel = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    sums = counts.groupBy("root").agg(F.sum("n").alias("n"))
    seen = all_.groupBy("root").agg(F.count_if(F.col("is_folder") & ~_is_tools(F.col("name")) & (F.col("depth") < depth)).alias("folders"), F.bool_or("late").alias("late"))
    out = every.join(sums, "root", "left").join(seen, "root", "left")
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n > most, "files").when(F.coalesce("late", F.lit(False)), "seconds").otherwise("")
    out = out.select("root", F.least(n, F.lit(most)).alias("files"), F.coalesce("folders", F.lit(0)).alias("folders"), (reason != "").alias("truncated"), reason.alias("reason"))
    return some.select("root", rel.alias("rel"), "depth", "size", "mtime", "nth"), out


def of_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files whose ending (with its dot, any case) is one of suffixes."""
    return files.filter(suffix(F.element_at(F.split("rel", "/"), -1)).isin([s.lower() for s in suffixes]))


def first_of_suffix(files: DataFrame) -> DataFrame:
    """Rows (root, suffix, rel): the first file of each ending."""
    ending = suffix(F.element_at(F.split("rel", "/"), -1))
    return files.filter(ending != "").groupBy("root", ending.alias("suffix")).agg(F.min_by("rel", "nth").alias("rel"))


def candidates(files: DataFrame, suffixes: list[str], skipped: list[str], skipped_endings: list[str], most: int = 400, largest: int = 8 << 20) -> DataFrame:
    """Files that may hold plain texts: at most `most` of a root in the order of the listing, without those of names or endings to skip and those larger than `largest`."""
    name = F.lower(F.element_at(F.split("rel", "/"), -1))
    ok = suffix(name).isin(suffixes) & ~name.isin(skipped) & (F.col("size") <= largest)
    for x in skipped_endings:
        ok &= ~name.endswith(x)
    nth = F.row_number().over(W.partitionBy("root").orderBy("nth"))
    return files.filter(ok).withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
