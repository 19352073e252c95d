"""String tables: texts of entries `key=LineCodeData{... Text=value; ...}`, read, filled anew within a budget of bytes.

One pattern matches an entry up to the end of its value, so that what lies between values is what the text is split by:
no entry is looked for inside another's value, and a table is put together again from the pieces between and the values,
without a byte changed elsewhere. A value is written as it was, bare or quoted; bare ones get quotes only where they hold
a sign that would end them.

Filling has a budget for each table. A ladder of rewrites makes texts shorter, wide signs narrow ones, and the first of
its steps at which the whole table fits is taken for all its texts; if none does, the texts that add most go back to
their originals, one by one, until it fits. Names of tables may be shared: the units of a name go to the first of its
tables in which one of them is found.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomwork.functions import placeholders
from loomwork.functions import text as T
from loomwork.operators import ordered
from loomwork.tables import checkpointed

# The format's marks and reaches, languages by name, keys without texts, the macro of a button, the steps of the ladder.
HEAD, MARK = "StringTable{", "\x00"
VALUE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|(?!")[^;]*+'
ENTRY = rf"(?s)(([A-Za-z0-9_]+)=LineCodeData\{{.{{0,80}}?Text=)({VALUE})(?:(?=.{{0,79}}?Character=([^;]*+);)|)"
SKIPPED_KEYS = ["CMAP", "FONT"]
OTHER_LANGUAGES = "french german italian spanish portuguese polish russian japanese korean chinese tchinese schinese leet dede frfr itit eses ptbr ruru jajp kokr zhcn zhtw".split()
ENGLISH = ["usenglish", "ukenglish", "english", "enus", "engb"]
MACRO = "/[A-Z][A-Za-z0-9_]{1,30}/"
STEPS = [
    {"“": '"', "”": '"', "‘": "'", "’": "'", "（": "(", "）": ")", "《": "<", "》": ">", "【": "[", "】": "]", "、": ",", "：": ":", "；": ";"},
    {"！": "!", "？": "?"},
    {"，": ",", "。": "."},
]
BARE_ENDS = r'[;"\\{}\[\]\r\n\t]'


def language_gate(name: Column) -> Column:
    """Why a table of this name isn't taken: another language's, or no language in it; null if it is English."""
    low = F.lower(name)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(has(OTHER_LANGUAGES), "other").when(has(ENGLISH), None).otherwise("unknown")


def unescaped(raw: Column) -> Column:
    """A value without its quotes, escapes resolved; unknown escapes and a last backslash stay."""
    inner = F.when((F.length(raw) >= 2) & raw.startswith('"') & raw.endswith('"'), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    out = F.replace(inner, F.lit("\\\\"), F.lit(MARK))
    for sign, real in {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'"}.items():
        out = F.replace(out, F.lit("\\" + sign), F.lit(real))
    return F.replace(out, F.lit(MARK), F.lit("\\"))


def emitted(text: Column, raw: Column) -> Column:
    """A value as it is written: bare where the one before was and nothing in it ends a bare value, else quoted and escaped."""
    out = text
    for real, sign in {"\\": "\\\\", '"': '\\"', "\r": "\\r", "\n": "\\n", "\t": "\\t"}.items():
        out = F.replace(out, F.lit(real), F.lit(sign))
    return F.when(~raw.startswith('"') & ~text.rlike(BARE_ENDS), text).otherwise(F.concat(F.lit('"'), out, F.lit('"')))


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(pieces: pd.Series, raws: pd.Series) -> pd.Series:
    """Where values start, of the lengths of the pieces between them (one more) and their own."""
    return pd.Series([None if p is None or r is None else np.cumsum(p[: len(r)]) + np.cumsum(r) - r for p, r in zip(pieces, raws, strict=True)], dtype=object)


def entries(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Rows (key, n, name, raw, value, speaker, start, end) of tables (key, text): their entries from 0 with the places of their raw values. Texts that don't begin as a table have none."""
    said = F.col(text)
    group = lambda i: F.regexp_extract_all(said, F.lit(ENTRY), F.lit(i))
    rows = files.filter(T.strip(said).startswith(HEAD) & ~said.contains(MARK))
    rows = rows.select(F.col(key).alias("key"), F.split(F.regexp_replace(said, ENTRY, f"$1{MARK}"), MARK, -1).alias("pieces"), group(2).alias("names"), group(3).alias("raws"), group(4).alias("speakers"))
    starts = _starts(F.transform("pieces", F.length), F.transform("raws", F.length))
    rows = rows.withColumn("starts", starts).select("key", F.posexplode(F.arrays_zip("names", "raws", "speakers", "starts")).alias("n", "x"))
    speaker = F.regexp_replace(T.strip(F.coalesce(F.col("x.speakers"), F.lit(""))), '^"+|"+$', "")
    return rows.select("key", "n", F.col("x.names").alias("name"), F.col("x.raws").alias("raw"), unescaped(F.col("x.raws")).alias("value"), speaker.alias("speaker"), F.col("x.starts").alias("start"), (F.col("x.starts") + F.length("x.raws")).alias("end"))


def table_units(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Rows (key, n, name, original, speaker, protected, parts): what people read of English tables; files whose key names no English table have none."""
    english = files.filter(language_gate(F.col(key)).isNull())
    rows = entries(english, key, text)
    skipped = reduce(lambda a, b: a | b, [F.upper("name").startswith(p) for p in SKIPPED_KEYS])
    rows = rows.filter(~skipped & T.strip(F.col("value")).rlike(r"\p{L}"))
    rows = rows.select(F.col("key").alias(key), "n", "name", F.col("value").alias("original"), F.when(F.col("speaker") != "Text", F.col("speaker")).otherwise("").alias("speaker"))
    return protected(rows, "original")


def protected(rows: DataFrame, text: str) -> DataFrame:
    """rows with protected and parts as of placeholders.protect(), macros of buttons taken out before all else."""
    return placeholders.protect(rows, text, [MACRO, *placeholders.PATTERNS.values()])


def without_stray_brackets(new: Column, old: Column) -> Column:
    """new without the brackets that it has more of than old, each kind from the last one on."""

    def bounded(said: Column, sign: Column) -> Column:
        held = F.coalesce(F.length(old) - F.length(F.replace(old, sign, F.lit(""))), F.length(said))
        head = F.call_function("substring_index", said, sign, held + 1)
        return F.concat(head, F.replace(F.substr(said, F.length(head) + 1), sign, F.lit("")))

    # A fold, not one column inside the next: each names its text several times, so that four of them would hold it thousands of times.
    return F.aggregate(F.array(*map(F.lit, "{}[]")), new, bounded)


def narrowed(text: Column, steps: int) -> Column:
    """text after the first `steps` steps of the ladder."""
    every = reduce(lambda a, b: a | b, STEPS[:steps], {})
    return F.translate(text, "".join(every), "".join(every.values())) if every else text


def slots(offsets: DataFrame, group: str, offset: str, end: Column) -> DataFrame:
    """offsets with slot: the bytes up to the next offset of the group, for the last one up to end."""
    return offsets.withColumn("slot", F.coalesce(F.lead(offset).over(W.partitionBy(group).orderBy(offset)), end) - F.col(offset))


def fitted(values: DataFrame, budgets: DataFrame, key: str = "key") -> DataFrame:
    """Rows (key, n, raw_new, step, dropped) of values (key, n, raw, new) that change something, for tables with budgets (key, size, budget).

    size is what the table has in bytes, budget what it may have (null or 0: anything). step is how many steps of the ladder a table took;
    dropped values go back to their originals. Sums are aggregates of a table's rows; the values themselves stay where they are.
    """
    made = values
    for i in range(len(STEPS) + 1):
        made = made.withColumn(f"_v{i}", emitted(narrowed(F.col("new"), i), F.col("raw")))
        made = made.withColumn(f"_d{i}", (F.octet_length(f"_v{i}") - F.octet_length("raw")).cast("long"))
    sums = made.groupBy(key).agg(*[F.sum(f"_d{i}").alias(f"_s{i}") for i in range(len(STEPS) + 1)])
    sums = sums.join(budgets.select(key, "size", "budget"), key)
    free = F.coalesce("budget", F.lit(0)) == 0
    step = F.when(free, 0)
    for i in range(len(STEPS) + 1):
        step = step.when(F.col("size") + F.col(f"_s{i}") <= F.col("budget"), i)
    sums = sums.select(key, step.otherwise(len(STEPS)).alias("step"), F.when(~free, F.col("budget") - F.col("size")).alias("_room"))
    at = lambda name: F.element_at(F.array(*[F.col(f"{name}{i}") for i in range(len(STEPS) + 1)]), F.col("step") + 1)
    rows = made.join(sums, key).select(key, "n", "raw", at("_v").alias("raw_new"), at("_d").alias("_delta"), "step", "_room").filter("raw_new <> raw")
    return trimmed(rows).select(key, "n", "raw_new", "step", "dropped")


def trimmed(rows: DataFrame, key: str = "key") -> DataFrame:
    """rows (key, n, _delta, _room) with dropped: from the largest growth down, until what is left of a table is within its room; ties go by n. Of a table that can't be made to fit all are dropped."""
    cut = checkpointed(ordered.budget_trim(rows.withColumn("_room", F.coalesce("_room", F.lit(1 << 60))), key, "_delta", "n", "_room"))
    left = cut.groupBy(F.col(key).alias("_key")).agg((F.sum(F.when(F.col("dropped"), 0).otherwise(F.col("_delta"))) <= F.max("_room")).alias("_fits"))
    return cut.join(left, F.col(key).eqNullSafe(F.col("_key"))).withColumn("dropped", F.col("dropped") | ~F.col("_fits")).drop("_key", "_fits")


def claimed(units: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of units (name, key, original, ...) with place: the first of the tables that share a unit's name in which any unit of that name is found, key and text alike; units that aren't in it are left out.

    held (name, place, key, value, ...) has the tables' entries. The join is on name, key and text at once, so a name that
    very many tables or units share makes no pairs but those that fit; the first table is an aggregate.
    """
    pairs = units.alias("u").join(held.alias("h"), [F.col("u.name").eqNullSafe(F.col("h.name")), F.col("u.key").eqNullSafe(F.col("h.key")), F.col("u.original") == F.col("h.value")])
    pairs = checkpointed(pairs.select("u.*", F.col("h.place").alias("place")))
    first = pairs.groupBy(F.col("name").alias("_name")).agg(F.min("place").alias("_place"))
    return pairs.join(first, F.col("name").eqNullSafe(F.col("_name")) & (F.col("place") == F.col("_place")), "left_semi")


def refilled(files: DataFrame, units: DataFrame, budgets: DataFrame | None = None, key: str = "path", text: str = "text") -> DataFrame:
    """Rows (key, text, n_replaced, step, n_dropped): tables with the targets of units (key, name, original, target) in the places of their entries.

    An entry is filled if it is the last of its name and still has the original; a target that is the original changes
    nothing. budgets (key, budget) bound a table's bytes (null or 0: don't), as said above.
    """
    found = checkpointed(entries(files, key, text))
    last = found.withColumn("_last", F.max("n").over(W.partitionBy("key", "name"))).filter("n = _last").drop("_last")
    given = units.filter("target is not null").groupBy(F.col(key).alias("key"), "name", "original").agg(F.max("target").alias("target"))
    new = last.join(given, ["key", "name"]).filter("value = original").withColumn("new", without_stray_brackets(F.col("target"), F.col("value"))).filter("new <> value").select("key", "n", "raw", "new")
    sizes = files.select(F.col(key).alias("key"), F.octet_length(text).cast("long").alias("size"))
    budgets = sizes.withColumn("budget", F.lit(None).cast("long")) if budgets is None else sizes.join(budgets.select(F.col(key).alias("key"), F.col("budget").cast("long").alias("budget")), "key", "left")
    done = checkpointed(fitted(checkpointed(new), budgets))
    made = found.select("key", "n", "raw").join(done.filter("not dropped").select("key", "n", "raw_new"), ["key", "n"], "left")
    put = made.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("raw_new", "raw").alias("v")))).alias("put"), F.count("raw_new").alias("n_replaced")).filter("n_replaced > 0")
    told = done.groupBy("key").agg(F.max("step").alias("step"), F.count_if("dropped").alias("n_dropped"))
    said = F.col(text)
    rows = files.join(told.join(put, "key", "left"), F.col(key) == F.col("key"), "left")
    pieces = F.split(F.regexp_replace(said, ENTRY, f"$1{MARK}"), MARK, -1)
    whole = F.array_join(F.zip_with(pieces, "put.v", lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    return rows.select(key, F.when(F.col("put").isNull(), said).otherwise(whole).alias("text"), F.coalesce("n_replaced", F.lit(0)).alias("n_replaced"), F.coalesce("step", F.lit(0)).alias("step"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"))
