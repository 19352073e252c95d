"""Sinks' plans: texts put back into their places, packages, full exports, repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines_back(files: DataFrame, units: DataFrame, key: str = "path") -> DataFrame:
    """files (key, text) with n_replaced, units (key, line, start, original, target) put in; lines and starts count from 0.

    A unit whose place doesn't hold its original is left out. Within a line the last place comes first, so that
    starts stay right. Line ends and marks at a file's start are kept, as they belong to the lines.
    """
    edits = units.filter("target is not null").groupBy(key, "line").agg(F.sort_array(F.collect_list(F.struct("start", "original", "target")), asc=False).alias("edits"))
    lines = files.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "raw")).join(edits, [key, "line"], "left")

    def put(acc, e):
        size = F.length(e["original"])
        fits = F.substr(acc["raw"], e["start"] + 1, size) == e["original"]
        new = F.concat(F.substr(acc["raw"], F.lit(1), e["start"]), e["target"], F.substr(acc["raw"], e["start"] + size + 1))
        return F.struct(F.when(fits, new).otherwise(acc["raw"]).alias("raw"), (acc["n"] + fits.cast("int")).alias("n"))

    start = F.struct(F.col("raw"), F.lit(0).alias("n"))
    done = lines.withColumn("x", F.coalesce(F.aggregate("edits", start, put), start))
    out = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "x.raw"))).alias("x"), F.sum("x.n").alias("n_replaced"))
    return out.select(key, F.array_join("x.raw", "\n").alias("text"), "n_replaced")


def package_lines(units: DataFrame) -> DataFrame:
    """Rows (value): a package's JSON lines, of units (uid, source_file, original, target) that are filled; write them with .text()."""
    filled = units.filter("target <> ''")
    return filled.select(F.to_json(F.struct(F.col("uid").alias("u"), F.col("source_file").alias("f"), F.col("original").alias("o"), F.col("target").alias("t"))).alias("value"))


def read_package(lines: DataFrame) -> DataFrame:
    """Rows (uid, source_file, original, target) of package_lines(); lines that aren't entries are left out."""
    x = lines.select(F.from_json("value", "u string, f string, o string, t string").alias("x"))
    return x.filter("x.u is not null and x.t is not null").selectExpr("x.u uid", "x.f source_file", "x.o original", "x.t target")


def manifest(units: DataFrame) -> DataFrame:
    """One row: units, filled, files, progress and whether all are filled (of which there must be some)."""
    filled = F.count_if(F.coalesce("target", F.lit("")) != "")
    share = F.when(F.count("*") == 0, "0%").otherwise(F.format_string("%.1f%%", 100.0 * filled / F.count("*")))
    return units.agg(F.count("*").alias("units"), filled.alias("filled"), F.countDistinct("source_file").alias("files"), share.alias("progress"), ((F.count("*") > 0) & (filled == F.count("*"))).alias("complete"))


def export_plan(base: DataFrame, over: DataFrame, present: DataFrame) -> DataFrame:
    """Rows (rel, size, mtime, side) to be copied: what lies over wins over base; files that are present with the same size and second are left out."""
    a, b = (df.select("rel", F.struct("size", F.col("mtime").cast("long").alias("mtime")).alias(n)) for df, n in ((base, "a"), (over, "b")))
    wanted = a.join(b, "rel", "full").select("rel", F.coalesce("b", "a").alias("x"), F.when(F.col("b").isNull(), "base").otherwise("over").alias("side")).select("rel", "x.size", "x.mtime", "side")
    return wanted.join(present.select("rel", "size", F.col("mtime").cast("long").alias("mtime")), ["rel", "size", "mtime"], "left_anti")


def repository_names(packages: DataFrame) -> DataFrame:
    """Rows (stem, content_hash, name): packages (stem, content, seq) without repeated contents; later ones of a stem are called -2, -3 and so on."""
    first = packages.groupBy("stem", F.sha1(F.col("content").cast("binary")).alias("content_hash")).agg(F.min("seq").alias("seq"))
    nth = F.row_number().over(W.partitionBy("stem").orderBy("seq"))
    return first.select("stem", "content_hash", F.when(nth == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", nth.cast("string"))).alias("name"))
