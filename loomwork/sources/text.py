"""Sources of text units, all of them scans with generators: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T


def document_units(docs: DataFrame) -> DataFrame:
    """Rows (uid, source_file, doc_id, line, original): a unit for each line with a letter."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    units = lines.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_file"), "doc_id", "line", T.strip(F.col("raw")).alias("original")).filter(F.col("original").rlike(r"\p{L}"))
    return units.select(T.uid(F.col("source_file"), F.col("line").cast("string"), F.col("original")).alias("uid"), "source_file", "doc_id", "line", "original")


def html_units(pages: DataFrame) -> DataFrame:
    """Rows (page_id, ord, original): what stands between two tags and holds a letter."""
    nodes = F.regexp_extract_all("html", F.lit(">([^<>]+)<"), F.lit(1))
    out = pages.select("page_id", F.posexplode(nodes).alias("ord", "raw"))
    return out.select("page_id", "ord", T.strip(F.col("raw")).alias("original")).filter(F.col("original").rlike(r"\p{L}"))


def subtitle_cues(files: DataFrame) -> DataFrame:
    """Rows (path, cue, original) of files (path, text) whose cues are a number, a time line and texts, apart by empty lines."""
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n{2,}")).alias("cue", "block"))
    lines = F.split("block", "\n")
    body = F.filter(lines, lambda x: ~x.rlike("^[0-9]+$|-->") & (T.strip(x) != ""))
    return blocks.select("path", "cue", F.array_join(body, "\n").alias("original")).filter("original <> ''")


def catalog_entries(files: DataFrame) -> DataFrame:
    """Rows (path, ord, msgid, msgstr) of gettext catalogs (path, text)."""
    found = F.regexp_extract_all("text", F.lit(r'(?m)^msgid "(.*)"\s*\nmsgstr "(.*)"'), F.lit(0))
    rows = files.select("path", F.posexplode(found).alias("ord", "x"))
    part = lambda i: F.regexp_extract("x", r'(?s)^msgid "(.*)"\s*\nmsgstr "(.*)"', i)
    return rows.select("path", "ord", part(1).alias("msgid"), part(2).alias("msgstr")).filter("msgid <> ''")


def flat_json(files: DataFrame) -> DataFrame:
    """Rows (path, key, original) of files (path, text) that hold an object of strings or of objects of strings."""
    top = files.select("path", F.explode(F.from_json("text", "map<string,string>")).alias("k", "v"))
    inner = F.from_json("v", "map<string,string>")
    leaf = top.filter(~F.col("v").startswith("{")).select("path", F.col("k").alias("key"), F.col("v").alias("original"))
    nested = top.filter(F.col("v").startswith("{")).select("path", "k", F.explode(inner).alias("k2", "v2")).select("path", F.concat_ws(".", "k", "k2").alias("key"), F.col("v2").alias("original"))
    return leaf.union(nested).filter(T.strip(F.col("original")) != "")
