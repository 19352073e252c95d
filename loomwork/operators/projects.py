"""Projects of units: counts, what to show of a game, prompts, reviews by a function, and the change log as files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import ordered, reconcile
from loomwork.operators.terms import matching
from loomwork.streaming import store

def is_filled() -> Column:
    return F.coalesce(F.col("target"), F.lit("")) != ""


def stats(units: DataFrame) -> DataFrame:
    """One row of units (original, target, kind): total, filled, progress, chars, kinds (a map of counts)."""
    kinds = units.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.count_if(is_filled()).alias("f"), F.sum(F.length("original")).alias("c"))
    share = F.when(F.sum("n") > 0, F.format_string("%.1f%%", 100.0 * F.sum("f") / F.sum("n"))).otherwise("0%")
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))  # as many entries as there are kinds
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("f"), F.lit(0)).alias("filled"), share.alias("progress"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), counts.alias("kinds"))


def unverified(units: DataFrame) -> DataFrame:
    """Units that have a target which broke a rule and was kept."""
    return units.filter(is_filled() & F.coalesce(F.col("unverified"), F.lit(False)))


def open_examples(units: DataFrame, order: str, most: int = 5) -> DataFrame:
    """The first units without a target."""
    return units.filter(~is_filled()).orderBy(order).limit(most)


def status(games: DataFrame) -> DataFrame:
    """games (patched, verdict, units, done, engine) with status: the first that holds of patched, ready, translated, progress, unknown, new."""
    n, done = F.coalesce("units", F.lit(0)), F.coalesce("done", F.lit(0))
    shown = F.when(F.coalesce("patched", F.lit(False)), "patched").when(F.col("verdict").isin("match", "partial"), "ready")
    shown = shown.when((n > 0) & (done >= n), "translated").when((n > 0) & (done > 0), "progress").when(F.col("engine") == "unknown", "unknown")
    return games.withColumn("status", shown.otherwise("new"))


def summary(games: DataFrame) -> DataFrame:
    """One row of status(): how many games in all and of each status; what is translated counts as progress."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    return games.agg(F.count("*").alias("total"), of("patched").alias("patched"), of("ready").alias("ready"), of("progress", "translated").alias("progress"), of("new").alias("new"), of("unknown").alias("unknown"))


def batch_size(units: DataFrame, size: int = 8, least: float = 32.0) -> int:
    """How many texts to send at once: 1 where different texts are shorter than `least` on average."""
    mean = units.select("original").distinct().agg(F.avg(F.length("original"))).first()[0] or 0
    return size if mean >= least else 1


def token_difference(source: Column, target: Column) -> Column:
    """Numbers of placeholders that a target lacks and that it has too many, each once, sorted."""
    a, b = T.tokens(source), T.tokens(target)
    return F.struct(F.array_sort(F.array_except(a, b)).alias("missing"), F.array_sort(F.array_except(b, a)).alias("extra"))


def byte_sums(units: DataFrame, group: str, text: str = "original") -> DataFrame:
    """Rows (group, bytes): the UTF-8 bytes of each group's texts."""
    return units.groupBy(group).agg(F.sum(F.octet_length(text).cast("long")).alias("bytes"))


# Parts of a prompt.
SPEAKER, SCENE, TERMS, LANGUAGE, SOURCE, ONLY = "说话人：", "场景：", "术语（必须遵守）：", "目标语言：", "原文：", "请只输出译文："


def prompts(units: DataFrame, glossary: DataFrame, language: str, most: int = 20) -> DataFrame:
    """Rows (uid, prompt) of units (uid, original, speaker, scene): who speaks, where, the text's longest glossary terms in the glossary's order, the language, the text."""
    hits = matching(units.select("uid", "original"), glossary.filter("term <> ''"), "original")
    nth = F.row_number().over(W.partitionBy("uid").orderBy(F.desc(F.length("term")), "ord"))
    kept = hits.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("ord", "term", "want"))).alias("g"))
    named = F.array_join(F.transform("g", lambda g: F.concat(g["term"], F.lit(" => "), g["want"])), "；")
    head = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    lines = [head(SPEAKER, F.col("speaker")), head(SCENE, F.col("scene")), head(TERMS, named), F.lit(LANGUAGE + language), F.lit(""), F.lit(SOURCE), F.col("original"), F.lit(""), F.lit(ONLY)]
    return units.join(kept, "uid", "left").select("uid", F.concat_ws("\n", *lines).alias("prompt"))


def flags(reply: Column) -> Column:
    """The numbers in a reply: an array of them, an object that holds one or whose keys are true, alone, fenced or inside other words; null if there is none."""
    s = T.strip(F.regexp_replace(T.strip(reply), "^`{3,}(?:json)?|`{3,}$", ""))
    number = lambda xs: F.transform(F.filter(xs, lambda x: T.strip(x).rlike("^[0-9]+$")), lambda x: T.strip(x).cast("int"))
    listed = lambda x: number(F.from_json(x, "array<string>"))
    held = F.from_json(s, "map<string,string>")
    inner = F.get(F.filter(F.map_values(held), lambda v: v.startswith("[")), F.lit(0))
    yes = number(F.map_keys(F.map_filter(held, lambda _, v: v.isin("true", "yes", "1"))))
    loose = F.regexp_extract(s, r"(?s)\[.*\]", 0)
    return F.when(s.startswith("["), listed(s)).when(s.startswith("{"), F.when(inner.isNotNull(), listed(inner)).otherwise(yes)).when(loose != "", listed(loose))


def review(units: DataFrame, call: Callable[[list[tuple[int, str, str]]], str], order: str, rate: float = 0.1, size: int = 20, failures: tuple = (OSError, ValueError)) -> DataFrame:
    """Rows (uid, code, failed) of an even sample of units with a target: code model_flag where call names the unit's number, null else.

    call gets up to `size` (number from 1, source, target) and returns a reply as flags() reads it. Where it fails or says
    nothing that can be read, failed is true and nothing is said about the texts.
    """
    pool = units.filter(T.strip(F.col("target")) != "")
    chosen = ordered.global_rank(ordered.sample_stride(pool, order, rate), order)
    src = F.coalesce(F.nullif(F.col("protected_form"), F.lit("")), "original") if "protected_form" in units.columns else F.col("original")
    rows = chosen.select("uid", src.alias("src"), T.strip(F.col("target")).alias("dst"), F.floor(F.col("rank") / size).alias("batch"), (F.col("rank") % size + 1).cast("int").alias("i"))

    def ask(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        try:
            reply = call(list(zip(f["i"], f["src"], f["dst"], strict=True)))
        except failures:  # of a service: the batch counts as not looked at
            reply = None
        return f.assign(reply=reply)[["uid", "i", "reply"]]

    asked = rows.groupBy("batch").applyInPandas(ask, "uid string, i int, reply string").withColumn("named", flags(F.col("reply")))
    return asked.select("uid", F.when(F.array_contains("named", F.col("i")), "model_flag").alias("code"), F.col("named").isNull().alias("failed"))


def append(entries: DataFrame, path: str) -> int:
    """Adds entries (uid, t, uv) with a text to the change log at path, as JSON lines; uv is written only where it is 1. Returns how many."""
    return store.Log(entries.sparkSession, path).append(entries) if not entries.isEmpty() else 0


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows (uid, t, uv, seq) of a change log; seq is the order of appends, and of the rows in them; lines that aren't entries are left out."""
    return store.Log(spark, path).read()


def compact(spark: SparkSession, units: DataFrame, log: str, out: str) -> DataFrame:
    """units (uid, target) with the log's last entries written in, saved at out with all columns; then the batches that were read are deleted, and a log without others."""
    entries = store.Log(spark, log)
    read = entries.done()
    done = reconcile.replay(units.drop("unverified"), entries.read())
    done.write.option("ignoreNullFields", "false").json(out)
    entries.drop(read)
    if not entries.done() and not [n for n in entries.folder.names("") if n.startswith("batch=")]:
        entries.folder.delete("")
    return spark.read.schema(done.schema).json(out)
