"""Units of scripts and listings: dialogue scripts, subtitles, key-value files, tagged scripts, and what a folder's listing says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as T

# Line ends, string literals, words that begin a statement.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
STRING = r'"((?:[^"\\]|\\.)*)"'
KEYWORDS = "label jump call menu if elif else while for return pass scene show hide play stop queue pause with init define default python image transform style screen translate voice window nvl from import class def set at".split()
TOOL_DIRS = ["node_modules", "__pycache__", ".git"]


def lines(files: DataFrame, *more: str) -> DataFrame:
    """Rows (path, more, line, raw) of files (path, text); lines count from 1."""
    return files.select("path", *more, F.posexplode(F.split("text", LINE_END, -1)).alias("i", "raw")).select("path", *more, (F.col("i") + 1).alias("line"), "raw")


def dialogue_lines(files: DataFrame) -> DataFrame:
    """Rows (path, line, form, speaker, original) of dialogue scripts: names of characters, options of menus, lines of a speaker, narration."""
    name, option = r"Character\s*\(\s*" + STRING, r"^\s*" + STRING + r"\s*:\s*$"
    spoken, plain = r"^\s*([A-Za-z_]\w*)\s+" + STRING + r"\s*(?:with\s+\w+)?\s*$", r'^\s*"[^"]*"\s*(?:with\s+\w+)?\s*$'
    raw = F.col("raw")
    form = F.when(raw.rlike(name), "name").when(raw.rlike(option), "option").when(raw.rlike(spoken), "spoken").when(raw.rlike(plain) & ~raw.rlike(rf"^\s*(?:{'|'.join(KEYWORDS)}|\$)\b"), "narration")
    rows = lines(files).filter(~T.strip(raw).rlike("^(#|$)")).withColumn("form", form).filter("form is not null")
    body = F.when(F.col("form") == "name", F.regexp_extract("raw", name, 1)).when(F.col("form") == "spoken", F.regexp_extract("raw", spoken, 2)).otherwise(F.regexp_extract("raw", STRING, 1))
    body = F.replace(F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    speaker = F.when(F.col("form") == "spoken", F.regexp_extract("raw", spoken, 1))
    return rows.select("path", "line", "form", speaker.alias("speaker"), body.alias("original")).filter(T.strip(F.col("original")).rlike(r"[\p{L}\p{N}]|[^\u0000-\u2e80]"))


def styled_cues(files: DataFrame) -> DataFrame:
    """Rows (path, line, start, original) of styled subtitles: the tenth field of dialogue lines, without effects in braces, where the line holds it whole."""
    rows = lines(files).filter(F.col("raw").rlike(r"^Dialogue:"))
    payload = F.get(F.split(F.regexp_replace("raw", r"^Dialogue:\s*", ""), ",", 10), F.lit(9))
    rows = rows.withColumn("original", T.strip(F.regexp_replace(payload, r"\{[^{}]*\}", "")))
    return rows.withColumn("start", F.instr("raw", F.col("original")) - 1).filter(F.col("original").rlike(r"\p{L}") & (F.col("start") >= 0)).select("path", "line", "start", "original")


def key_values(files: DataFrame) -> DataFrame:
    """Rows (path, line, key, original) of lines `key: value`; blocks, anchors and nulls are left out, quotes taken off."""
    pair = r"^\s*([^\s:#][^:]*):\s+(.*)$"
    rows = lines(files).filter(F.col("raw").rlike(pair)).select("path", "line", F.trim(F.regexp_extract("raw", pair, 1)).alias("key"), T.strip(F.regexp_extract("raw", pair, 2)).alias("v"))
    rows = rows.filter(~F.col("v").rlike(r"^[|>*&]|^(~|null)$"))
    return rows.select("path", "line", "key", F.regexp_replace(F.regexp_replace("v", '^"+|"+$', ""), "^'+|'+$", "").alias("original")).filter(F.col("original").rlike(r"\p{L}"))


def tagged_lines(files: DataFrame) -> DataFrame:
    """Rows (path, line, speaker, original) of tagged scripts: tags with arguments are taken out, the last [name="..."] above is the speaker, script blocks and lines of comments, labels and commands are left out."""
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col("raw").rlike(r"^\s*\[iscript\]"), True).when(F.col("raw").rlike(r"^\s*\[endscript\]"), False)
    rows = lines(files).withColumn("_mark", mark).withColumn("_in", F.coalesce(F.last("_mark", ignorenulls=True).over(w), F.lit(False)))
    rows = rows.withColumn("_skip", F.col("_in") | F.col("_mark").isNotNull() | F.col("raw").rlike(r"^\s*[;*@]"))
    named = F.when(~F.col("_skip"), F.nullif(F.regexp_extract("raw", r'\[name\s*=\s*"([^"]*)"', 1), F.lit("")))
    rows = rows.withColumn("speaker", F.last(named, ignorenulls=True).over(w)).filter("not _skip")
    body = F.regexp_replace("raw", r"\[(?:/[^\]]*|[^\]]*[ =][^\]]*|r|l|p|cm|er|end[^\]]*)\]", "")
    return rows.select("path", "line", "speaker", body.alias("original")).filter(F.col("original").rlike(r"\p{L}"))


def listed(files: DataFrame, depth: int = 4, suffixes: list[str] | None = None) -> DataFrame:
    """Rows of a listing (root, rel, ...) whose folders are at most `depth` deep and aren't tools' or backups; with suffixes only theirs."""
    folders = F.slice(F.split(F.lower("rel"), "/"), 1, F.greatest(F.size(F.split("rel", "/")) - 1, F.lit(0)))
    ok = (F.size(folders) <= depth) & ~F.arrays_overlap(folders, F.array(*map(F.lit, TOOL_DIRS))) & ~F.lower("rel").rlike(r"\.(bak|old|orig)$")
    out = files.filter(ok)
    return out.filter(F.lower(F.regexp_extract("rel", r"\.[^./]+$", 0)).isin(suffixes)) if suffixes else out


def engines(files: DataFrame) -> DataFrame:
    """Rows (root, engine, files): the first rule that a root's listing (root, rel, size) fits. An aggregate of flags, combined before the shuffle."""
    rel = F.lower("rel")
    any_ = lambda pattern: F.coalesce(F.bool_or(rel.rlike(pattern)), F.lit(False))
    texts = rel.rlike(r"\.(txt|json|csv|xml|ya?ml|po|srt|ass|lang)$") & (F.col("size") >= 64)
    plain = any_(r"^([^/]+/)?[^/]+\.exe$") & (F.count_if(texts) >= 3) & (F.coalesce(F.sum(F.when(texts, F.least("size", F.lit(8 << 20)))), F.lit(0)) >= 1024)
    engine = (
        F.when(any_(r"^[^/]+\.xp3$"), "kirikiri").when(any_(r"^(www/)?data/(system|mapinfos|commonevents)\.json$"), "rpgmaker_mv").when(any_(r"\.rpyc?$") | any_(r"\.rpa$"), "renpy")
        .when(any_(r"^[^/]+_data/") | any_("^unityplayer[.]dll$"), "unity").when(plain, "plaintext").otherwise("unknown")
    )
    return files.groupBy("root").agg(engine.alias("engine"), F.count("*").alias("files"))
