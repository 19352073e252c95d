"""Units of game data: event lists and object tables (JSON), plug-in parameters and literals of scripts, dialogue nodes, line tables.

Trees are walked by small functions of one file; everything that goes by lines is built-in functions.
"""

from __future__ import annotations

import csv
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from loomwork.functions import text as T
from loomwork.sources import json_places
from loomwork.sources.scripts import lines

# Files without texts; fields, lists and texts of objects; codes of event commands; what in scripts is for people.
SKIPPED = ["MapInfos.json", "Tilesets.json", "Animations.json", "TilesetFlags.json", "PluginConfig.json", "Pictures.json"]
FIELDS = {"name": "name", "description": "description", "message1": "system", "message2": "system", "message3": "system", "message4": "system", "title": "ui", "profile": "description"}
SYSTEM_LISTS = {"armorTypes": "ui", "weaponTypes": "ui", "skillTypes": "ui", "elements": "name"}
SYSTEM_TEXTS = ["gameTitle", "currencyUnit"]
MESSAGE, CONTINUED, CHOICES, WHEN = 401, 405, 102, 402
FOR_PEOPLE = r"[぀-ヿｦ-ﾟ一-鿿Ａ-Ｚａ-ｚ０-９]"
FOR_MACHINES = r"^[A-Za-z0-9_./\\:\-+@#%*()\[\]{}<>$,;=~^|!?'\" ]+$"
# As types, not as strings: Python workers import this without a session.
UNIT = ArrayType(StructType().add("place", ArrayType(StringType())).add("kind", "string").add("speaker", "string").add("original", "string"))


def _readable(x) -> bool:
    return isinstance(x, str) and any(c.isalnum() or ord(c) > 0x2E80 for c in x)


def _unit(place: list, kind: str, original: str, speaker: str | None = None) -> dict:
    return {"place": [str(p) for p in place], "kind": kind, "speaker": speaker, "original": original}


def _command(node: dict) -> list[dict]:
    """What an event command shows: a message and who says it, choices, the heading of a choice's branch."""
    code, given = node.get("code"), node.get("parameters") or []
    if code == MESSAGE:
        said = [x if isinstance(x, str) else "" for x in given[:2]]
        speaker, body = said if len(said) == 2 else ("", *said) if said else ("", "")
        out = [_unit([code], "dialogue", body, speaker or None)] if _readable(body) else []
        return out + ([_unit([code, "speaker"], "name", speaker)] if _readable(speaker) else [])
    if code == CHOICES:
        return [_unit([code, i], "ui", x) for i, x in enumerate(given[0] if given and isinstance(given[0], list) else []) if _readable(x)]
    return [_unit([code], "ui", given[1])] if code == WHEN and len(given) > 1 and _readable(given[1]) else []


def _event_units(tree) -> list[dict]:
    """Units of all commands at any depth; place: the way to the command, its code, the part."""
    out, open_ = [], [((), tree)]
    while open_:
        at, x = open_.pop()
        inside = list(x.items() if isinstance(x, dict) else enumerate(x))
        if isinstance(x, dict):
            out += [{**u, "place": [*map(str, at), *u["place"]]} for u in _command(x)]
            if x.get("code") in (MESSAGE, CONTINUED, CHOICES, WHEN):
                inside = [(k, v) for k, v in inside if k != "parameters"]
        open_ += reversed([((*at, k), v) for k, v in inside if isinstance(v, (dict, list))])
    return out


def _object_units(tree, system: bool) -> list[dict]:
    """Units of an array of objects or of one: named fields, groups of terms, and of the system file its lists and texts."""
    objects = [([i], x) for i, x in enumerate(tree) if isinstance(x, dict)] if isinstance(tree, list) else [([], tree)] if isinstance(tree, dict) else []
    out = []
    for at, x in objects:
        out += [_unit([*at, f], kind, x[f]) for f, kind in FIELDS.items() if _readable(x.get(f))]
        terms = x.get("terms")
        for group, held in terms.items() if isinstance(terms, dict) else []:
            inside = enumerate(held) if isinstance(held, list) else held.items() if isinstance(held, dict) else []
            out += [_unit([*at, "terms", group, k], "ui" if isinstance(held, list) else "system", v) for k, v in inside if _readable(v)]
    for at, x in objects[:1] if system else []:
        out += [_unit([*at, f, i], kind, v) for f, kind in SYSTEM_LISTS.items() if isinstance(x.get(f), list) for i, v in enumerate(x[f]) if _readable(v)]
        out += [_unit([*at, f], "ui", x[f]) for f in SYSTEM_TEXTS if _readable(x.get(f))]
    return out


@F.pandas_udf(UNIT)
def _data(name: pd.Series, text: pd.Series) -> pd.Series:
    def of(file: str, said: str | None) -> list[dict] | None:
        try:
            tree = json.loads(said)
        except (ValueError, TypeError, RecursionError):
            return None
        return _event_units(tree if isinstance(tree, (dict, list)) else []) if file.startswith(("CommonEvents", "Map")) else _object_units(tree, file == "System.json")

    return pd.Series([of(n, t) for n, t in zip(name, text, strict=True)], dtype=object)


def data_units(files: DataFrame) -> DataFrame:
    """Rows (path, ord, place, kind, speaker, original) of data files (path, text): event lists by their names, object tables else. Files that aren't JSON give none."""
    name = F.substring_index("path", "/", -1)
    some = files.filter(name.endswith(".json") & ~name.isin(SKIPPED))
    return some.select("path", F.posexplode(_data(name, F.col("text"))).alias("ord", "x")).select("path", "ord", "x.*")


def script_text(value: Column) -> Column:
    """Whether a literal of a script is for people: 2 to 120 characters, some of them kana, hanzi or full width, no address."""
    s = T.strip(value)
    return F.length(s).between(2, 120) & s.rlike(FOR_PEOPLE) & ~s.rlike(FOR_MACHINES) & ~s.rlike("^(https?://|data:|file:)")


@F.pandas_udf(ArrayType(StructType().add("start", "integer").add("original", "string")))
def _literals(text: pd.Series) -> pd.Series:
    return text.map(lambda said: [{"start": m.start(2), "original": m[2]} for m in re.finditer(r"""(['"])((?:\\.|(?!\1)[^\\\n])*)\1""", said or "")])


def script_literals(files: DataFrame) -> DataFrame:
    """Rows (path, start, original) of script files: quoted strings within a line that are for people; starts count characters of the file."""
    found = files.select("path", F.explode(_literals("text")).alias("x")).select("path", "x.start", "x.original")
    return found.filter(script_text(F.col("original")))


@F.pandas_udf(ArrayType(StructType().add("place", ArrayType(StringType())).add("original", "string").add("as_key", "boolean")))
def _settings(text: pd.Series) -> pd.Series:
    def held(x):
        """The tree inside a string that holds one, else None."""
        try:
            return json.loads(x) if x.strip()[:1] in ("{", "[") else None
        except (ValueError, RecursionError):
            return None

    def of(said: str | None) -> list[dict] | None:
        try:
            plugins = json.loads(said)
        except (ValueError, TypeError, RecursionError):
            return None
        out: list[dict] = []
        for plugin in plugins if isinstance(plugins, list) else []:
            given = plugin.get("parameters") if isinstance(plugin, dict) else None
            open_ = [([str(plugin.get("name") or ""), str(k)], v, 0) for k, v in given.items()][::-1] if isinstance(given, dict) else []
            while open_:
                at, x, depth = open_.pop()
                tree = x if isinstance(x, (dict, list)) else held(x) if isinstance(x, str) and depth < 6 else None
                if isinstance(tree, dict):
                    out += [{"place": [*at, k], "original": k, "as_key": True} for k in tree]
                if isinstance(tree, (dict, list)):
                    inside = tree.items() if isinstance(tree, dict) else enumerate(tree)
                    open_ += [([*at, str(k)], v, depth + 1) for k, v in inside][::-1] if depth < 6 else []
                elif isinstance(x, str):
                    out.append({"place": at, "original": x, "as_key": False})
        return out

    return text.map(of)


def plugin_settings(files: DataFrame) -> DataFrame:
    """Rows (path, place, original, as_key) of plug-in lists (`var $plugins = [...];` with comment lines): strings for people among parameters, also inside strings that hold JSON, six levels deep; place: plug-in, parameter, way."""
    body = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"(?m)^\s*//.*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)^.*?var\s+\$plugins\s*=\s*", ""), r";?\s*$", "")
    found = files.select("path", F.explode(_settings(body)).alias("x")).select("path", "x.*")
    return found.filter(script_text(F.col("original")))


# Keys in the head of a dialogue node.
HEAD_KEYS = ["title", "tags", "colorid", "position", "when", "file", "style", "tracking", "subtitle", "line_group", "language", "linetype"]
_TAIL = r"(?:[ \t]*(?:<<.*?>>|#[^\s#$<]+))+[ \t]*$"
_SPEAKER = r"^([A-Za-z](?U:[\w '\-.]){0,40}?)(?<!\\):[ \t]*(?=(.*)$)"


def speaker_prefix(text: Column) -> Column:
    """What stands before a line's body: the speaker's name, colon and blanks; "" if nobody is named or the colon is escaped."""
    return F.when(F.contains(F.substring_index(text, " ", 1), F.lit("\\:")), "").otherwise(F.regexp_extract(text, _SPEAKER, 0))


def dialogue_statements(files: DataFrame) -> DataFrame:
    """Rows (path, line, form, start, original, speaker, body) of dialogue node files: lines, `->` options, `=>` groups and `[[text|node]]`.

    Heads, commands, comments and tags aren't part of a text; what stands before `start` and behind the text stays where
    it is when it's put back. Files without a `---` count as bodies, in which known keys of heads are left out.
    """
    raw, s = F.col("raw"), F.col("s")
    w = W.partitionBy("path")
    mark = F.when(s.startswith("==="), False).when(s.startswith("---"), True)
    rows = lines(files).withColumn("s", T.strip(raw)).withColumn("_mark", mark)
    inside = F.last("_mark", ignorenulls=True).over(w.orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_in", F.coalesce(inside, ~F.max(F.coalesce("_mark", F.lit(False))).over(w)))
    key = F.regexp_replace(F.lower(T.strip(F.regexp_extract("s", r"^([A-Za-z_](?U:[\w\- ]){0,24})\s*:", 1))), " ", "")
    structure = s.rlike(r"^(//|===|---|#|<[A-Za-z_][^<>]*>>([ \t]|$))") | (s == "") | key.isin(HEAD_KEYS)
    rows = rows.filter(F.col("_in") & ~structure)
    bracket, arrow, group = r"^[ \t]*\[\[(.+?)\|[^\]]*\]\]", r"^[ \t]*->[ \t]*", r"^[ \t]*=>[ \t]*"
    form = F.when(raw.rlike(bracket), "bracket").when(raw.rlike(arrow), "option").when(raw.rlike(group), "group").otherwise("line")
    rows = rows.withColumn("form", form)
    before = F.when(F.col("form") == "bracket", F.regexp_extract(raw, r"^[ \t]*\[\[", 0)).when(F.col("form") == "option", F.regexp_extract(raw, arrow, 0)).when(F.col("form") == "group", F.regexp_extract(raw, group, 0))
    rows = rows.withColumn("_before", before.otherwise(F.regexp_extract(raw, r"^(?:[ \t]*<<.*?>>[ \t]*)*", 0)))
    rest = F.substring(raw, F.length("_before") + 1, F.length(raw))
    rows = rows.withColumn("_rest", F.when(F.col("form") == "bracket", F.regexp_extract(raw, bracket, 1)).otherwise(rest)).filter(~((F.col("form") == "line") & T.strip(F.col("_rest")).startswith("//")))
    plain = F.regexp_replace(F.regexp_replace("_rest", "[ \t]//.*$", ""), _TAIL, "")
    rows = rows.withColumn("_rest", F.when(F.col("form") == "bracket", F.col("_rest")).otherwise(plain)).withColumn("original", T.strip(F.col("_rest"))).filter("original <> ''")
    lead = F.length("_rest") - F.length(F.ltrim("_rest", F.lit(T.SPACES)))
    rows = rows.withColumn("_said", F.when(F.col("form") == "bracket", "").otherwise(speaker_prefix(F.col("original"))))
    return rows.select("path", "line", "form", (F.length("_before") + lead).alias("start"), "original", T.strip(F.substring_index("_said", ":", 1)).alias("speaker"), F.substring("original", F.length("_said") + 1, F.length("original")).alias("body"))


@F.pandas_udf(ArrayType(StringType()))
def _fields(line: pd.Series) -> pd.Series:
    return line.map(lambda x: next(csv.reader([x]), []) if x else [])


def line_table(files: DataFrame) -> DataFrame:
    """Rows (path, line, code, speaker, original) of tables of lines (`line:code,text,comment`): a name in front of a text is the speaker."""
    rows = lines(files).withColumn("s", T.strip(F.col("raw"))).filter(F.col("s").startswith("line:") | F.col("s").startswith('"line:'))
    rows = rows.withColumn("f", _fields("s")).filter(F.size("f") >= 2).withColumn("said", T.strip(F.get("f", F.lit(1))))
    pair = r"^([A-Za-z](?U:[\w ])*):\s*(.+)$"
    named = F.col("said").rlike(pair)
    body = F.when(named, T.strip(F.regexp_extract("said", pair, 2))).otherwise(F.col("said"))
    rows = rows.select("path", "line", F.get("f", F.lit(0)).alias("code"), F.when(named, T.strip(F.regexp_extract("said", pair, 1))).otherwise("").alias("speaker"), body.alias("original"))
    return rows.filter(F.col("code").startswith("line:") & T.translatable(F.col("original")))


def _command_way(place: list[str], ways: set) -> tuple[str, ...]:
    """The way to the text of an event command's unit, in its parameters."""
    for k in (len(place) - 1, len(place) - 2):
        node, rest = tuple(place[:k]), place[k + 1 :]
        if k >= 0 and (*node, "parameters") in ways and (*node, "code") in ways:
            given = (*node, "parameters")
            if place[k] == str(MESSAGE):
                return (*given, "0") if rest == ["speaker"] or (*given, "1") not in ways else (*given, "1")
            return (*given, "0", *rest) if place[k] == str(CHOICES) else (*given, "1")
    return tuple(place)


@F.pandas_udf(StructType().add("text", "string").add("n", "integer"))
def _data_back(name: pd.Series, text: pd.Series, edits: pd.Series) -> pd.DataFrame:
    def of(file: str, said: str | None, own) -> tuple[str | None, int]:
        if said is None or own is None:
            return said, 0
        events = file.startswith(("CommonEvents", "Map"))
        try:
            json.loads(said)
            ways = json_places.places(said)[2] if events else set()
            return json_places.spliced(said, [(_command_way(list(e["place"]), ways) if events else tuple(e["place"]), False, e["original"], e["target"]) for e in own], 0)
        except (ValueError, RecursionError):  # not what its name says: the file stays as it is
            return said, 0

    return pd.DataFrame([of(*x) for x in zip(name, text, edits, strict=True)], columns=["text", "n"])


@F.pandas_udf(StructType().add("text", "string").add("n", "integer"))
def _settings_back(text: pd.Series, edits: pd.Series) -> pd.DataFrame:
    def of(said: str | None, own) -> tuple[str | None, int]:
        m = re.search(r"var\s+\$plugins\s*=\s*", said or "")
        if own is None or not m:
            return said, 0
        body = re.sub(r";?\s*$", "", said[m.end() :])
        try:
            plugins = json.loads(body)
            names = [str(p.get("name") or "") if isinstance(p, dict) else None for p in plugins]
            moved = [((str(i), "parameters", *e["place"][1:]), bool(e["as_key"]), e["original"], e["target"]) for e in own for i, n in enumerate(names) if n == e["place"][0]]
            new, n = json_places.spliced(body, moved)
        except (ValueError, RecursionError):  # as above
            return said, 0
        return said[: m.end()] + new + said[m.end() + len(body) :], n

    return pd.DataFrame([of(*x) for x in zip(text, edits, strict=True)], columns=["text", "n"])


def data_back(files: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (path, text, n_replaced, changed): data files and plug-in lists with the targets of units (path, place, original, target, as_key of plug-ins') where their originals stand.

    Strings are replaced in the text itself: numbers, repeated keys, blanks and the order of keys stay. Targets inside
    strings that hold JSON are written as JSON again, level by level. Units without a target, whose place is gone or
    holds another text, are left out; a file's units meet it in one row, files without any stay as they are.
    """
    as_key = F.coalesce("as_key", F.lit(False)) if "as_key" in units.columns else F.lit(False)
    edits = units.filter("target <> ''").groupBy("path").agg(F.collect_list(F.struct("place", as_key.alias("as_key"), "original", "target")).alias("_edits"))
    rows = files.join(edits, "path", "left")
    is_list = F.col("path").endswith("plugins.js")
    x = F.when(is_list, _settings_back(F.when(is_list, F.col("text")), "_edits")).otherwise(_data_back(F.substring_index("path", "/", -1), F.when(~is_list, F.col("text")), "_edits"))
    out = rows.withColumn("_x", x)
    return out.select("path", F.col("_x.text").alias("text"), F.col("_x.n").alias("n_replaced"), (~F.col("_x.text").eqNullSafe(F.col("text"))).alias("changed"))
