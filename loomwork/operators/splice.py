"""Targets put back into dialogue files, and what was put back read again: an edit after which a line isn't the same kind of statement, of the same speaker, with just the target as its text, is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.sources import game_data
from loomwork.sources.scripts import LINE_END
from loomwork.tables import checkpointed


def _put(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows (path, text) of files, edits (path, line, from, size, target) put into their lines; line ends stay as they are."""
    listed = edits.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", F.struct("from", "size", "target").alias("e")))).alias("_edits"))
    rows = files.join(listed, "path", "left")
    ends = F.concat(F.regexp_extract_all("text", F.lit(f"({LINE_END})"), F.lit(1)), F.array(F.lit("")))
    e = lambda i: F.col("_edits")[i + 1]
    new = F.transform(F.split("text", LINE_END, -1), lambda raw, i: F.when(F.col("_edits").isNull() | e(i).isNull(), raw).otherwise(F.concat(F.substring(raw, F.lit(1), e(i)["from"]), e(i)["target"], F.substring(raw, e(i)["from"] + e(i)["size"] + 1, F.length(raw)))))
    whole = F.array_join(F.zip_with(new, ends, lambda a, b: F.concat(a, b)), "")
    return rows.select("path", F.when(F.col("_edits").isNull(), F.col("text")).otherwise(whole).alias("text"))


def statements_back(files: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, text, n_replaced), and edits (path, line, target, why) of units (path, line, body, target), whose target takes the place of a statement's body.

    why is null for what was put in, else the diagnosis: `moved` (no such statement with that body), `lines` (a line break in
    the target), `structure` (the line would end or begin a node), `gone` (no statement any more), `form`, `speaker`, `text`
    (a part of the target would be a tag, command or comment). Files are read again once with all edits that are left.
    A target that is the body changes nothing and is put in. Repeated units of a line count once, the largest target; units without a target are no edits.
    """
    found = checkpointed(game_data.dialogue_statements(files))
    start = F.col("start") + F.length("original") - F.length("body")
    known = found.select("path", "line", "form", "speaker", F.col("body").alias("_body"), start.alias("from"))
    wanted = units.filter("target <> ''").groupBy("path", "line", "body").agg(F.max("target").alias("target"))
    rows = wanted.join(known, ["path", "line"], "left").withColumn("size", F.length("body"))
    raw = files.select("path", F.posexplode(F.split("text", LINE_END, -1)).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line"), "raw")
    rows = rows.join(raw, ["path", "line"], "left")
    changed = T.strip(F.concat(F.substring("raw", F.lit(1), F.col("from")), "target"))
    why = F.when(~F.col("_body").eqNullSafe(F.col("body")), "moved").when(F.col("target").rlike(LINE_END), "lines").when(changed.rlike("^(===|---)"), "structure")
    rows = checkpointed(rows.withColumn("why", why).drop("raw", "_body"))
    again = game_data.dialogue_statements(_put(files, rows.filter("why is null"))).select("path", "line", F.col("form").alias("_form"), F.col("speaker").alias("_speaker"), F.col("body").alias("_new"))
    judged = rows.join(again, ["path", "line"], "left")
    late = F.when(F.col("_form").isNull(), "gone").when(F.col("_form") != F.col("form"), "form").when(F.col("_speaker") != F.col("speaker"), "speaker").when(F.col("_new") != F.col("target"), "text")
    judged = checkpointed(judged.withColumn("why", F.coalesce("why", late)))
    kept = judged.filter("why is null")
    n = kept.groupBy("path").agg(F.count("*").alias("n_replaced"))
    out = _put(files, kept).join(n, "path", "left").select("path", "text", F.coalesce("n_replaced", F.lit(0).cast("long")).alias("n_replaced"))
    return out, judged.select("path", "line", "target", "why")
