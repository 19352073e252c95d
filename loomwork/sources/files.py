"""Text files as units: read, told apart by suffix, cut into units with their places, and written back.

Files are rows (path, text). Formats of lines are built-in functions over each line; tables and trees are read whole by
a small function of one file inside the tasks. A file that its format can't read gives no units and stops no other.
"""

from __future__ import annotations

import csv
import io
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from loomwork.functions import placeholders
from loomwork.functions import text as T
from loomwork.sources.scripts import lines

# Suffixes by format, names and endings that hold no texts.
FORMS = {
    "line": ["txt", "text", "lang", "strings", "loc", "md"], "srt": ["srt"], "ass": ["ass", "ssa"], "yaml": ["yaml", "yml"], "po": ["po"], "xml": ["xml"],
    "csv": ["csv", "tsv"], "json": ["json"],
}
SKIPPED = """
readme.txt readme.md license.txt licence.txt copying notice changelog.txt changes.txt version.txt eula.txt credits.txt thanks.txt
install.txt uninstall.txt output_log.txt player.log player-prev.log error.log 使用说明.txt 安装说明.txt package.json manifest.json
projectversion.txt boot.config app.info tsconfig.json package-lock.json yarn.lock launch.json settings.json editorconfig
""".split()
SKIPPED_ENDINGS = [".min.json", ".min.js", ".map"]
LARGEST = 8 << 20
# As types, not as strings: Python workers import this without a session.
TREE = ArrayType(StructType().add("key", ArrayType(StringType())).add("original", "string"))
CELLS = ArrayType(StructType().add("row", "integer").add("col", "integer").add("original", "string"))
PLACES = ArrayType(StructType().add("start", "integer").add("original", "string"))


def read_files(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """Rows (path, text, bom, newline, trailing) of the files at a path or pattern; text is null for what isn't UTF-8. Empty files and files above `largest` bytes aren't read."""
    raw = spark.read.format("binaryFile").load(path).filter(F.col("length") <= largest)
    said = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(said), F.regexp_replace(said, "^\ufeff", ""))
    out = raw.select("path", text.alias("text"), said.startswith("\ufeff").alias("bom"))
    return out.select("path", "text", "bom", F.when(F.contains("text", F.lit("\r\n")), "\r\n").otherwise("\n").alias("newline"), F.endswith("text", F.lit("\n")).alias("trailing"))


def form(path: Column) -> Column:
    """A file's format by its name; null for what holds no texts."""
    name = F.lower(F.substring_index(path, "/", -1))
    suffix = F.substring_index(name, ".", -1)
    out = F.lit(None).cast("string")
    for kind, suffixes in FORMS.items():
        out = F.when(suffix.isin(suffixes), kind).otherwise(out)
    skipped = name.isin(SKIPPED) | ~name.contains(".")
    for ending in SKIPPED_ENDINGS:
        skipped = skipped | name.endswith(ending)
    return F.when(~skipped, out)


def _from_right(raw: Column, part: Column) -> Column:
    return F.length(raw) - F.instr(F.reverse(raw), F.reverse(part)) + 1 - F.length(part)


def _at(start: Column, original: Column) -> Column:
    """One place, if it is one and holds a letter."""
    found = F.struct(start.cast("int").alias("start"), original.alias("original"))
    return F.when((start >= 0) & T.translatable(original), F.array(found))


@F.pandas_udf(PLACES)
def _nodes(raw: pd.Series) -> pd.Series:
    """What stands between two tags of a line."""

    def of(line: str) -> list[dict]:
        found = [(m.start(1), m[1]) for m in re.finditer(">([^<>]+)<", line or "")]
        return [{"start": a + len(x) - len(x.lstrip()), "original": x.strip()} for a, x in found if any(c.isalpha() for c in x)]

    return raw.map(of)


def line_places(raw: Column, kind: Column) -> Column:
    """The places (start, original) of a line of a file of this format that hold texts."""
    s = T.strip(raw)
    whole = _at(F.length(raw) - F.length(F.ltrim(raw, F.lit(T.SPACES))), s)
    timed = s.rlike(r"^[0-9]{1,3}$") | s.rlike(r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}(?U:\s)*-->")
    fields = F.split(F.regexp_extract(raw, r"(?Ui)^\s*Dialogue\s*:\s*(.*)$", 1), ",", 10)
    said = T.strip(F.regexp_replace(F.get(fields, F.lit(9)), r"\{[^{}]*\}", ""))
    pair = r"(?U)^\s*(?:-\s+)?[\w\-.$]+\s*:\s*(\S.*)$"
    value = T.strip(F.regexp_extract(raw, pair, 1))
    plain = F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")
    quoted = F.regexp_extract(raw, r'(?U)^\s*msgstr\s+(".*")\s*$', 1)
    inner = F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))
    return (
        F.when(kind == "line", whole).when((kind == "srt") & ~timed, whole)
        .when(kind == "ass", _at(F.instr(raw, said) - 1, said))
        .when((kind == "yaml") & ~value.rlike(r"^[|>*&]|^(~|null)$"), _at(_from_right(raw, plain), plain))
        .when(kind == "po", _at(F.instr(raw, quoted), inner))
    )


def line_units(files: DataFrame) -> DataFrame:
    """Rows (path, form, line, start, original) of files whose format goes by lines; lines count from 1, starts from 0."""
    rows = lines(files.withColumn("form", form(F.col("path"))).filter(F.col("form").isin("line", "srt", "ass", "yaml", "po", "xml")), "form")
    flat = rows.filter("form <> 'xml'").withColumn("x", F.explode(line_places(F.col("raw"), F.col("form"))))
    tags = rows.filter("form = 'xml' and contains(raw, '<')").withColumn("x", F.explode(_nodes("raw")))
    return flat.union(tags).select("path", "form", "line", "x.start", "x.original")


@lru_cache(1024)
def _sniffed(begins: str):
    """A table's dialect by its beginning, None if it can't be told. Kept, as writing a file asks again."""
    try:
        return csv.Sniffer().sniff(begins, delimiters=",\t;")
    except csv.Error:
        return None


def _dialect(path: str, text: str):
    return _sniffed(text[:4096]) or (csv.excel_tab if path.lower().endswith(".tsv") else csv.excel)


def _rows(path: str, text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline=""), _dialect(path, text)))


@F.pandas_udf(CELLS)
def _cells(path: pd.Series, text: pd.Series) -> pd.Series:
    def of(name: str, said: str) -> list[dict] | None:
        try:
            return [{"row": i, "col": j, "original": x} for i, row in enumerate(_rows(name, said)) for j, x in enumerate(row) if any(c.isalpha() for c in x)]
        except csv.Error:
            return None

    return pd.Series([of(p, t) if t is not None else None for p, t in zip(path, text, strict=True)], dtype=object)


def walked(node, key: tuple = ()):
    """All (key, string) below a node, keys as strings, in document order; without recursion, so any depth will do."""
    open_ = [(key, node)]
    while open_:
        at, x = open_.pop()
        if isinstance(x, str):
            yield at, x
        elif isinstance(x, (dict, list)):
            inside = x.items() if isinstance(x, dict) else enumerate(x)
            open_ += reversed([((*at, str(k)), v) for k, v in inside])


@F.pandas_udf(TREE)
def _leaves(text: pd.Series) -> pd.Series:
    def of(said: str | None) -> list[dict] | None:
        try:
            return [{"key": list(k), "original": s} for k, s in walked(json.loads(said)) if any(c.isalpha() for c in s)]
        except (ValueError, TypeError, RecursionError):
            return None

    return text.map(of)


def cell_units(files: DataFrame) -> DataFrame:
    """Rows (path, row, col, original): all cells with a letter of tables; the separator is found from a table's beginning."""
    some = files.filter(form(F.col("path")) == "csv")
    return some.select("path", F.explode(_cells("path", "text")).alias("x")).select("path", "x.row", "x.col", "x.original")


def tree_units(files: DataFrame) -> DataFrame:
    """Rows (path, key, original): all strings with a letter of JSON files, at any depth, key being the way to them."""
    some = files.filter(form(F.col("path")) == "json")
    return some.select("path", F.explode(_leaves("text")).alias("x")).select("path", "x.key", "x.original")


def file_units(files: DataFrame) -> DataFrame:
    """Unit rows of files of all formats: uid, source_file, kind, form, line, start, row, col, key, original, protected_form, protected.

    One row type for all: places that a format doesn't have are null. uid is the first 16 hex digits of the SHA-1 of
    file, place (as JSON, keys in order) and original.
    """
    quoted = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    place = F.when(F.col("form") == "csv", F.format_string('{"col": %d, "form": "csv", "row": %d}', "col", "row"))
    numbers = F.array_join(F.transform("key", lambda k: F.when(k.rlike("^[0-9]+$"), k).otherwise(F.concat(F.lit('"'), quoted(k), F.lit('"')))), ", ")
    place = place.when(F.col("form") == "json", F.concat(F.lit('{"form": "json", "key_path": ['), numbers, F.lit("]}")))
    place = place.otherwise(F.format_string('{"form": "line", "line": %d, "span": [%d, %d]}', "line", "start", F.col("start") + F.length("original")))
    none = lambda kind: F.lit(None).cast(kind)
    names = ["path", "form", "line", "start", "row", "col", "key", "original"]
    rows = line_units(files).withColumns({"row": none("int"), "col": none("int"), "key": none("array<string>")}).select(names)
    rows = rows.union(cell_units(files).withColumns({"form": F.lit("csv"), "line": none("int"), "start": none("int"), "key": none("array<string>")}).select(names))
    rows = rows.union(tree_units(files).withColumns({"form": F.lit("json"), "line": none("int"), "start": none("int"), "row": none("int"), "col": none("int")}).select(names))
    kind = F.when(F.col("form").isin("line", "srt", "ass"), "dialogue").otherwise("other")
    rows = rows.select(T.uid(F.col("path"), place, F.col("original")).alias("uid"), F.col("path").alias("source_file"), kind.alias("kind"), *names[1:])
    out = placeholders.protect(rows, "original")
    return out.withColumnsRenamed({"protected": "protected_form", "parts": "protected"})


def _spliced(said: str, edits: list[dict], newline: str) -> tuple[str, int]:
    """Lines with originals replaced at their places, the last place of a line first; all line ends become `newline`."""
    rows, done = said.splitlines(), 0
    for e in sorted(edits, key=lambda e: (e["line"], e["start"]), reverse=True):
        i, a = e["line"] - 1, e["start"]
        b = a + len(e["original"])
        if 0 <= i < len(rows) and rows[i][a:b] == e["original"]:
            rows[i] = rows[i][:a] + e["target"] + rows[i][b:]
            done += 1
    return newline.join(rows) + (newline if said.endswith("\n") else ""), done


def _refilled(path: str, said: str, edits: list[dict], newline: str) -> tuple[str, int]:
    rows, done = _rows(path, said), 0
    for e in edits:
        if e["row"] < len(rows) and e["col"] < len(rows[e["row"]]) and rows[e["row"]][e["col"]] == e["original"]:
            rows[e["row"]][e["col"]] = e["target"]
            done += 1
    out = io.StringIO(newline="")
    csv.writer(out, _dialect(path, said), lineterminator=newline).writerows(rows)
    return out.getvalue(), done


def step(node, key: str):
    """The child of an object or array, None if it has none."""
    if isinstance(node, dict):
        return node.get(key)
    return node[int(key)] if isinstance(node, list) and key.isdigit() and int(key) < len(node) else None


def _regrown(said: str, edits: list[dict]) -> tuple[str, int]:
    tree, done = json.loads(said), 0
    for e in edits:
        above, *_ = [tree] if len(e["key"]) else [None]
        for k in e["key"][:-1]:
            above = step(above, k)
        last = e["key"][-1] if len(e["key"]) else ""
        if step(above, last) == e["original"]:
            above[last if isinstance(above, dict) else int(last)] = e["target"]
            done += 1
    return json.dumps(tree, ensure_ascii=False, indent=2 if re.search(r"\n\s+\S", said) else None), done


@F.pandas_udf(StructType().add("text", "string").add("n", "integer"))
def _written(path: pd.Series, text: pd.Series, kind: pd.Series, newline: pd.Series, edits: pd.Series) -> pd.DataFrame:
    out = []
    for p, t, k, nl, e in zip(path, text, kind, newline, edits, strict=True):
        e = [] if e is None else [{c: int(v) if c in ("line", "start", "row", "col") and v == v and v is not None else v for c, v in x.items()} for x in e]  # numbers beside nulls come as floats
        try:
            new, n = (_regrown(t, e) if k == "json" else _refilled(p, t, e, nl) if k == "csv" else _spliced(t, e, nl)) if e else (t, 0)
        except (ValueError, csv.Error, RecursionError):  # not what its name says: the file stays as it is
            new, n = t, 0
        out.append((new if n else t, n))
    return pd.DataFrame(out, columns=["text", "n"])


def write_back(files: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (path, text, n_replaced, changed): files with the targets of units (as of file_units(), with target) in their places.

    Numbers in a target become the protected parts again. A unit whose place doesn't hold its original any more is left
    out. The units of a file meet it in one row, as the file itself is one; files without any stay as they are.
    """
    names = ["form", "line", "start", "row", "col", "key", "original"]
    done = units.filter("target <> ''").withColumn("target", placeholders.restore(F.col("target"), F.col("protected")))
    edits = done.groupBy(F.col("source_file").alias("path")).agg(F.collect_list(F.struct(*names, "target")).alias("edits"))
    newline = F.when(F.contains("text", F.lit("\r\n")), "\r\n").otherwise("\n")
    rows = files.join(edits, "path", "left").withColumn("_x", _written("path", "text", form(F.col("path")), newline, "edits"))
    return rows.select("path", F.col("_x.text").alias("text"), F.col("_x.n").alias("n_replaced"), (~F.col("_x.text").eqNullSafe(F.col("text"))).alias("changed"))
