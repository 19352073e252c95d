"""Registered queries over files that are made of whole tables, so that SQL can tell what has to come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import audit, projects, reconcile, terms
from loomwork.plans.queries import _KANA, _PREFIX, _STRIP, _TOKENS, _UNITS, glossary_of, register, table, units_of
from loomwork.sources import files as formats
from loomwork.sources import game_data


def _parts(spark, sf_dir) -> DataFrame:
    """Parts with what a text format needs: key, name, brand, type, size."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("size"))


def _file(rows: DataFrame, suffix: str, text) -> DataFrame:
    return rows.select(F.concat(F.lit("d/"), F.col("k").cast("string"), F.lit(suffix)).alias("path"), text.alias("text"))


def _said(*parts) -> F.Column:
    return F.concat(*[F.lit(p[1:]) if p.startswith("'") else F.col(p) for p in parts])


def _files(rows: DataFrame, texts: dict) -> DataFrame:
    """Several files of each row, by suffix: one generator over one scan. Rows are dealt out first: a table of a few MB is read in as few tasks, however many files it makes."""
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "k")
    path = lambda suffix: F.concat(F.lit("d/"), F.col("k").cast("string"), F.lit(suffix)).alias("path")
    return rows.select(F.inline(F.array(*[F.struct(path(suffix), text.alias("text")) for suffix, text in texts.items()])))


def _line_texts() -> dict:
    return {
        ".txt": _said("'  ", "p_name", "' \r\n12345\r\n\r\n\t", "p_type", "'\r\n"),
        ".srt": _said("'1\n00:00:01,000 --> 00:00:02,000\n", "p_name", "'\n\n2\n00:00:03,000 --> 00:00:04,000\n", "p_type", "'\n"),
        ".ass": _said("'[Events]\ndialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\an8}", "p_name", "', ", "p_type", "'\nComment: x\n"),
        ".yaml": _said("'name: \"", "p_name", "'\"\nempty: ''\nblock: |\nsize: ", "size", "'\n- kind.of: ", "p_type", "'\nnone: null\n"),
        ".po": _said("'msgid \"", "p_type", "'\"\nmsgstr \"", "p_name", "'\"\n"),
        ".xml": _said("'<a><b>", "p_name", "'</b><c> ", "p_type", "' </c>\n<d>12</d></a>\n"),
        "/readme.txt": F.col("p_name"),
    }


def _line_files(spark, sf_dir) -> DataFrame:
    return _files(_parts(spark, sf_dir), _line_texts())


_LINE_UNITS = """p AS (SELECT 'd/' || p_partkey AS d, p_name AS a, p_type AS b FROM part), u(path, form, line, start, original) AS (
    SELECT d || '.txt', 'line', 1, 2, a FROM p UNION ALL SELECT d || '.txt', 'line', 4, 1, b FROM p
    UNION ALL SELECT d || '.srt', 'srt', 3, 0, a FROM p UNION ALL SELECT d || '.srt', 'srt', 7, 0, b FROM p
    UNION ALL SELECT d || '.ass', 'ass', 2, 56, a || ', ' || b FROM p
    UNION ALL SELECT d || '.yaml', 'yaml', 1, 7, a FROM p UNION ALL SELECT d || '.yaml', 'yaml', 5, 11, b FROM p
    UNION ALL SELECT d || '.po', 'po', 2, 8, a FROM p
    UNION ALL SELECT d || '.xml', 'xml', 1, 6, a FROM p UNION ALL SELECT d || '.xml', 'xml', 1, 6 + length(a) + 8, b FROM p)"""


@register(f"WITH {_LINE_UNITS} SELECT path, form, line, start, original FROM u")
def file_line_units(spark, sf_dir):
    """Six formats of lines, with places; a readme holds no texts."""
    return formats.line_units(_line_files(spark, sf_dir))


def _table_texts() -> dict:
    lines = F.array(F.struct(F.struct(F.col("p_type").alias("deep"), F.lit(5).alias("n")).alias("in")), F.struct(F.struct(F.col("p_brand").alias("deep"), F.lit(6).alias("n")).alias("in")))
    return {
        ".csv": _said("'id,name,kind\r\n", "size", "',\"", "p_name", "', big\",", "p_type", "'\r\n"),
        ".tsv": _said("'id\tname\n", "size", "'\t", "p_type", "'\n"),
        ".json": F.to_json(F.struct(F.struct(F.col("p_name").alias("start")).alias("menu"), F.col("size"), lines.alias("list"))),
        ".bad.json": _said("'{\"a\": ", "p_name"),
    }


def _tables(spark, sf_dir) -> DataFrame:
    return _files(_parts(spark, sf_dir), _table_texts())


@register("""SELECT path, row, col, original FROM (SELECT 'd/' || p_partkey || '.csv' AS path, unnest([0, 0, 0, 1, 1]) AS row, unnest([0, 1, 2, 1, 2]) AS col, unnest(['id', 'name', 'kind', p_name || ', big', p_type]) AS original FROM part)
    UNION ALL SELECT path, row, col, original FROM (SELECT 'd/' || p_partkey || '.tsv' AS path, unnest([0, 0, 1]) AS row, unnest([0, 1, 1]) AS col, unnest(['id', 'name', p_type]) AS original FROM part)""")
def file_cell_units(spark, sf_dir):
    return formats.cell_units(_tables(spark, sf_dir))


@register("""SELECT 'd/' || p_partkey || '.json' AS path, unnest(['menu/start', 'list/0/in/deep', 'list/1/in/deep']) AS place, unnest([p_name, p_type, p_brand]) AS original FROM part""")
def file_tree_units(spark, sf_dir):
    """Strings at any depth; a file that isn't JSON gives none."""
    return formats.tree_units(_tables(spark, sf_dir)).select("path", F.array_join("key", "/").alias("place"), "original")


@register(f"""WITH {_LINE_UNITS}, c AS (SELECT 'd/' || p_partkey || '.csv' AS path, unnest([0, 0, 0, 1, 1]) AS row, unnest([0, 1, 2, 1, 2]) AS col, unnest(['id', 'name', 'kind', p_name || ', big', p_type]) AS original FROM part
        UNION ALL SELECT 'd/' || p_partkey || '.tsv' AS path, unnest([0, 0, 1]), unnest([0, 1, 1]), unnest(['id', 'name', p_type]) FROM part),
    j AS (SELECT 'd/' || p_partkey || '.json' AS path, unnest(['"menu", "start"', '"list", 0, "in", "deep"', '"list", 1, "in", "deep"']) AS place, unnest([p_name, p_type, p_brand]) AS original FROM part),
    a AS (SELECT path, form, '{{"form": "line", "line": ' || line || ', "span": [' || start || ', ' || (start + length(original)) || ']}}' AS place, original FROM u
        UNION ALL SELECT path, 'csv', '{{"col": ' || col || ', "form": "csv", "row": ' || row || '}}', original FROM c
        UNION ALL SELECT path, 'json', '{{"form": "json", "key_path": [' || place || ']}}', original FROM j)
    SELECT substr(sha1(path || '|' || place || '|' || original), 1, 16) AS uid, path AS source_file, form, CASE WHEN form IN ('line', 'srt', 'ass') THEN 'dialogue' ELSE 'other' END AS kind, original FROM a""")
def file_unit_rows(spark, sf_dir):
    """Unit rows of all formats, with ids that follow from file, place and text."""
    return formats.file_units(_files(_parts(spark, sf_dir), _line_texts() | _table_texts())).select("uid", "source_file", "form", "kind", "original")


@register(r"""WITH p AS (SELECT 'd/' || p_partkey AS d, p_name AS a, p_type AS b, p_brand AS c, CAST(p_size AS VARCHAR) AS s FROM part), f(path, text, n_replaced) AS (
    SELECT d || '.txt', '  <' || a || '> \r\n12345\r\n\r\n\t<' || b || '>\r\n', 2 FROM p
    UNION ALL SELECT d || '.srt', '1\n00:00:01,000 --> 00:00:02,000\n<' || a || '>\n\n2\n00:00:03,000 --> 00:00:04,000\n<' || b || '>\n', 2 FROM p
    UNION ALL SELECT d || '.ass', '[Events]\ndialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{!an8}<' || a || ', ' || b || '>\nComment: x\n', 1 FROM p
    UNION ALL SELECT d || '.yaml', 'name: "<' || a || '>"\nempty: ''''\nblock: |\nsize: ' || s || '\n- kind.of: <' || b || '>\nnone: null\n', 2 FROM p
    UNION ALL SELECT d || '.po', 'msgid "' || b || '"\nmsgstr "<' || a || '>"\n', 1 FROM p
    UNION ALL SELECT d || '.xml', '<a><b><' || a || '></b><c> <' || b || '> </c>\n<d>12</d></a>\n', 2 FROM p
    UNION ALL SELECT d || '/readme.txt', a, 0 FROM p
    UNION ALL SELECT d || '.csv', '<id>,<name>,<kind>\r\n' || s || ',"<' || a || ', big>",<' || b || '>\r\n', 5 FROM p
    UNION ALL SELECT d || '.tsv', '<id>\t<name>\n' || s || '\t<' || b || '>\n', 3 FROM p
    UNION ALL SELECT d || '.json', '{"menu": {"start": "<' || a || '>"}, "size": "' || s || '", "list": [{"in": {"deep": "<' || b || '>", "n": 5}}, {"in": {"deep": "<' || c || '>", "n": 6}}]}', 3 FROM p
    UNION ALL SELECT d || '.bad.json', '{"a": ' || a, 0 FROM p)
    SELECT path, replace(replace(replace(replace(text, '\r', chr(13)), '\n', chr(10)), '\t', chr(9)), '!', chr(92)) AS text, CAST(n_replaced AS INTEGER) AS n_replaced, n_replaced > 0 AS changed FROM f""")
def file_write_back(spark, sf_dir):
    """Every unit's text in angle brackets, back in its file of its format."""
    files = _files(_parts(spark, sf_dir), _line_texts() | _table_texts())
    units = formats.file_units(files)
    return formats.write_back(files, units.withColumn("target", F.concat(F.lit("<"), "original", F.lit(">"))))


def _events(spark, sf_dir) -> DataFrame:
    """Each conversation as an event list: turns are messages with a speaker, a system turn is one without."""
    said = F.when(F.col("role") == "system", F.array("text")).otherwise(F.array("role", "text"))
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", F.struct("turn", F.struct(F.lit(401).alias("code"), said.alias("parameters")).alias("c")).alias("x"))
    files = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("list"))
    return files.select(F.concat(F.lit("data/Map"), F.col("conv_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(F.array(F.struct(F.struct("list").alias("pages"))).alias("events"))).alias("text"))


@register(r"""WITH t AS (SELECT 'data/Map' || conv_id || '.json' AS path, 'events/0/pages/list/' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '/401' AS place, role, text FROM conversations WHERE text IS NOT NULL)
    SELECT path, place, 'dialogue' AS kind, CASE WHEN role <> 'system' THEN role END AS speaker, text AS original FROM t WHERE regexp_matches(text, '[\p{L}\p{N}]|[^\x{0}-\x{2e80}]')
    UNION ALL SELECT path, place || '/speaker', 'name', NULL, role FROM t WHERE role <> 'system'""")
def event_list_units(spark, sf_dir):
    return game_data.data_units(_events(spark, sf_dir)).select("path", F.array_join("place", "/").alias("place"), "kind", "speaker", "original")


@register(r"""SELECT 'data/Items' || p_partkey || '.json' AS path, unnest(['1/name', '1/description', '1/terms/basic/0', '1/terms/messages/hit']) AS place, unnest(['name', 'description', 'ui', 'system']) AS kind, unnest([p_name, p_type, p_brand, p_name || '!']) AS original FROM part""")
def object_table_units(spark, sf_dir):
    p = _parts(spark, sf_dir)
    terms_ = F.struct(F.array("p_brand", F.lit("--")).alias("basic"), F.struct(F.concat("p_name", F.lit("!")).alias("hit"), F.lit("").alias("miss")).alias("messages"))
    one = F.to_json(F.struct(F.col("k").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("note"), terms_.alias("terms")))
    text = F.concat(F.lit("[null,"), one, F.lit("]"))
    return game_data.data_units(p.select(F.concat(F.lit("data/Items"), F.col("k").cast("string"), F.lit(".json")).alias("path"), text.alias("text"))).select("path", F.array_join("place", "/").alias("place"), "kind", "original")


@register("""SELECT 'js/p' || p_partkey || '.js' AS path, unnest(['クエスト' || p_name, '設定' || p_brand]) AS original, unnest([9, 9 + 4 + length(p_name) + 9]) AS start FROM part""")
def script_literal_units(spark, sf_dir):
    p = _parts(spark, sf_dir)
    text = _said("'var a = 'クエスト", "p_name", "'';b('x',\"設定", "p_brand", "'\",'あ');//'")
    return game_data.script_literals(p.select(F.concat(F.lit("js/p"), F.col("k").cast("string"), F.lit(".js")).alias("path"), text.alias("text")))


@register("""SELECT 'js/plugins' || p_partkey || '.js' AS path, unnest(['Menu/label', 'Menu/nested/0/name']) AS place, unnest(['表示' || p_name, '項目' || p_brand]) AS original, false AS as_key FROM part""")
def plugin_setting_units(spark, sf_dir):
    p = _parts(spark, sf_dir)
    nested = F.to_json(F.array(F.struct(F.concat(F.lit("項目"), "p_brand").alias("name"))))
    given = F.struct(F.concat(F.lit("表示"), "p_name").alias("label"), F.lit("true").alias("on"), nested.alias("nested"))
    body = F.to_json(F.array(F.struct(F.lit("Menu").alias("name"), given.alias("parameters"))))
    text = F.concat(F.lit("// made by a tool\nvar $plugins =\n"), body, F.lit(";\n"))
    return game_data.plugin_settings(p.select(F.concat(F.lit("js/plugins"), F.col("k").cast("string"), F.lit(".js")).alias("path"), text.alias("text"))).select("path", F.array_join("place", "/").alias("place"), "original", "as_key")


@register("""WITH p AS (SELECT 'd/' || p_partkey || '.yarn' AS path, p_name AS a, p_type AS b FROM part)
    SELECT path, unnest([4, 5, 6, 7]) AS line, unnest(['line', 'option', 'line', 'bracket']) AS form, unnest([0, 3, 10, 2]) AS start, unnest(['Mae: ' || a, b || '?', a, b]) AS original, unnest(['Mae', '', '', '']) AS speaker, unnest([a, b || '?', a, b]) AS body FROM p""")
def dialogue_node_units(spark, sf_dir):
    p = _parts(spark, sf_dir)
    text = _said("'title: Node\ntags: x\n---\nMae: ", "p_name", "' <<if $x > 9>> #line:1a // note\n-> ", "p_type", "'? #tag\n<<close>> ", "p_name", "'\n[[", "p_type", "'|Next]]\n<<set $a = 1>>\n#line:2\n// no\n===\n")
    return game_data.dialogue_statements(_file(p, ".yarn", text))


@register("""SELECT 'd/' || p_partkey || '.csv' AS path, unnest([2, 3]) AS line, unnest(['line:' || p_partkey, 'line:x']) AS code, unnest(['Mom', '']) AS speaker, unnest([p_name || ', ' || p_brand, p_type]) AS original FROM part""")
def line_table_units(spark, sf_dir):
    p = _parts(spark, sf_dir).withColumn("key", F.col("k").cast("string"))
    text = _said("'LineCode,LineText,Comment\nline:", "key", "',\"Mom: ", "p_name", "', ", "p_brand", "'\",note\nline:x,", "p_type", "',\nline:y,Mom: =_=,\n")
    return game_data.line_table(_file(p, ".csv", text))


# Units whose protected form differs from the original, and literal ones for the rules on scripts that no table holds.
_LITERALS = [
    ("c1", "おやすみ", "おやすみ", "晚安"), ("c2", "よるかぜ", "よるかぜ", ""), ("c3", "ランタンの油", "ランタンの油", "ランタンの油"), ("c4", "またあした", "またあした", "回头再见"), ("c5", "またこんど", "またこんど", "回头再见"),
    ("c6", "ふかいもりのおくにあるちいさないえ", "ふかいもりのおくにあるちいさないえ", "家"), ("c7", "しずかなよるだね", "しずかなよるだね", "宁静なよる"), ("c8", "[a]と[b]", "【0】と【1】", "【1】和【2】"), ("c9", "朝です", "朝です", "译文：早上"),
]
_TERMS = [(0, "ランタン", "灯笼"), (1, "the", "la")]
_PROTECTED = (
    "units AS (SELECT conv_id || '/' || turn AS uid, '{x} ' || coalesce(text, '') AS original, '【0】 ' || coalesce(text, '') AS protected_form, CASE WHEN turn % 4 = 0 THEN '【0】 ' ELSE '' END || coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS target FROM conversations UNION ALL VALUES "
    + ", ".join(str(x) for x in _LITERALS)
    + f"), s AS (SELECT uid, coalesce(nullif(protected_form, ''), original) AS src, {_STRIP('target')} AS dst FROM units), g(ord, term, want) AS (VALUES "
    + ", ".join(str(x) for x in _TERMS)
    + f"""), d AS (SELECT dst FROM s WHERE length(dst) >= 2 GROUP BY dst HAVING count(*) >= 2 AND count(DISTINCT src) >= 2 AND NOT (length(dst) <= 3 AND max(length(src)) <= 3)),
    k AS (SELECT *, len(regexp_extract_all(dst, '{_KANA}')) / length(dst) AS share, regexp_matches(src, '{_KANA}') AS kana FROM s),
    found(uid, code) AS (SELECT uid, 'empty' FROM k WHERE dst = '' UNION ALL SELECT uid, 'identical' FROM k WHERE dst <> '' AND src = dst AND kana UNION ALL SELECT uid, 'untranslated' FROM k WHERE dst <> '' AND src <> dst AND kana AND share > 0.3
        UNION ALL SELECT uid, 'placeholder' FROM k WHERE dst <> '' AND len({_TOKENS('src')}) > 0 AND {_TOKENS('src')} <> {_TOKENS('dst')} UNION ALL SELECT uid, 'too_short' FROM k WHERE dst <> '' AND length(src) >= 6 AND 4 * length(dst) < length(src)
        UNION ALL SELECT uid, 'too_long' FROM k WHERE length(src) >= 6 AND length(dst) > 4 * length(src) UNION ALL SELECT uid, 'prefix_residue' FROM k WHERE {_PREFIX('dst')}
        UNION ALL SELECT DISTINCT uid, 'term_miss' FROM k, g WHERE dst <> '' AND contains(src, term) AND NOT contains(dst, want) UNION ALL SELECT uid, 'dup_target' FROM k JOIN d USING (dst))"""
)


@register(f"WITH {_PROTECTED} SELECT uid, code, CASE WHEN code IN ('empty', 'placeholder', 'untranslated') THEN 'warn' ELSE 'info' END AS level, true AS resend FROM found")
def unit_audit(spark, sf_dir):
    """All rules over units with a protected form, of every conversation and of literal ones in scripts that no table holds."""
    from pyspark.sql import Window as W

    text = F.coalesce("text", F.lit(""))
    after = F.coalesce(F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("uid"), F.concat(F.lit("{x} "), text).alias("original"), F.concat(F.lit("【0】 "), text).alias("protected_form"), F.concat(F.when(F.col("turn") % 4 == 0, "【0】 ").otherwise(""), after).alias("target"))
    literal = spark.createDataFrame(_LITERALS, "uid string, original string, protected_form string, target string")
    return audit.described(audit.issues(turns.union(literal), spark.createDataFrame(_TERMS, "ord int, term string, want string")))


_WORDS = lambda words: "|".join(words)
_SCORED = rf"""{{units}}, t AS (SELECT doc_id, line, original AS t FROM units),
    m AS (SELECT doc_id, line, regexp_extract_all(t, '[A-Z][A-Za-z''\-]*(?:\s+[A-Z][A-Za-z''\-]*){{{{0,2}}}}') AS m, string_split_regex(t, '[A-Z][A-Za-z''\-]*(?:\s+[A-Z][A-Za-z''\-]*){{{{0,2}}}}') AS b FROM t WHERE regexp_matches(t, '[A-Z]')),
    x AS (SELECT doc_id, line, i - 1 AS pos, m[i] AS x, CASE WHEN rtrim(b[i], E' \t\r') <> '' THEN right(rtrim(b[i], E' \t\r'), 1) WHEN i > 1 THEN right(m[i - 1], 1) ELSE '' END AS before FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
    f AS (SELECT regexp_replace(regexp_replace(x, '(?i)^(?:(?:{_WORDS(terms.LEAD)})\s+)+', ''), '\s+', ' ', 'g') AS term, before <> '' AND before NOT IN ('.', '!', '?', '"', '''') AS mid, ROW(doc_id, line, pos) AS place FROM x),
    c AS (SELECT term, count(*) AS n, count(*) FILTER (WHERE mid) AS mid, min(place) AS first FROM f WHERE length(term) >= 3 GROUP BY term),
    s AS (SELECT term, n, n + mid * 3 + CAST(0.3 AS DOUBLE) * least(length(term), 20) AS score, first, lower(term) AS k, CASE WHEN regexp_matches(term, '^[A-Z](?:.*[a-z]|[^A-Z]+$)') THEN 3 ELSE 2 END AS form FROM c
        WHERE n >= 2 AND mid > 0 AND NOT regexp_matches(term, '(?i)^(?:{_WORDS(terms.STOP)})(?:[''’][A-Za-z]+)?$') AND NOT (NOT regexp_matches(term, '[ ''-]') AND regexp_matches(term, '[a-z][A-Z]') AND (length(term) > 10 OR len(regexp_extract_all(term, '[A-Z]')) >= 3)))"""


@register(f"WITH {_SCORED.format(units=_UNITS)} SELECT arg_min(term, ROW(-form, first)) AS term, CAST(sum(n) AS BIGINT) AS n, max(score) AS score FROM s GROUP BY k ORDER BY score DESC, min(first) LIMIT 300")
def term_candidates_scored(spark, sf_dir):
    """The 300 best candidate terms of all units by the whole rule."""
    return terms.scored(units_of(spark, sf_dir), ["doc_id", "line"])


def _games(spark, sf_dir) -> DataFrame:
    """Nations as games: class names of their region, number and name."""
    n = table(spark, sf_dir, "nation")
    none = F.array().cast("array<string>")
    return n.select(F.col("n_nationkey").alias("game"), F.array(F.concat(F.col("n_name"), F.lit(".exe"))).alias("exe"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))).otherwise(none).alias("data_dirs"), none.alias("packs"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("www"))).otherwise(none).alias("dirs"))


_BEST = """g AS (SELECT n_nationkey AS game, [lower(n_name) || '.exe'] AS exe, CASE WHEN n_nationkey % 2 = 0 THEN ['r' || n_regionkey] ELSE [] END AS data, CASE WHEN n_nationkey % 3 = 0 THEN ['www'] ELSE [] END AS dirs FROM nation),
    p AS (SELECT s_suppkey AS package, CASE WHEN s_suppkey % 4 > 0 THEN [lower(n_name) || '.exe'] ELSE [] END AS exe, CASE WHEN s_suppkey % 3 > 0 THEN ['r' || (s_suppkey % 7)] ELSE [] END AS data, CASE WHEN s_suppkey % 8 > 4 THEN ['www', 'x'] ELSE [] END AS dirs, floor(s_acctbal) AS created FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 10 > 0),
    c AS (SELECT game, package, created, CAST(len(g.exe) > 0 AND len(p.exe) > 0 AS INT) + CAST(len(g.data) > 0 AND len(p.data) > 0 AS INT) + CAST(len(g.dirs) > 0 AND len(p.dirs) > 0 AS INT) AS checks, CAST(list_has_any(g.exe, p.exe) AS INT) + CAST(list_has_any(g.data, p.data) AS INT) + CAST(list_has_any(g.dirs, p.dirs) AS INT) AS hit FROM g, p),
    v AS (SELECT *, CASE WHEN checks = 0 THEN 'unknown' WHEN hit = checks THEN 'match' WHEN hit = 0 THEN 'mismatch' ELSE 'partial' END AS verdict FROM c)"""


def _packages(spark, sf_dir) -> DataFrame:
    """Suppliers as packages; every tenth can't be read."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    none, k = F.array().cast("array<string>"), F.col("s_suppkey")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(k.alias("package"), F.when(k % 4 > 0, F.array(F.lower(F.concat("n_name", F.lit(".EXE"))))).otherwise(none).alias("exe"), F.when(k % 3 > 0, F.array(F.concat(F.lit("r"), (k % 7).cast("string")))).otherwise(none).alias("data_dirs"), none.alias("packs"), F.when(k % 8 > 4, F.array(F.lit("WWW"), F.lit("x"))).otherwise(none).alias("dirs"), F.floor("s_acctbal").alias("created"), F.when(k % 10 == 0, "broken").alias("error"))


@register(f"WITH {_BEST} SELECT game, package, verdict FROM v WHERE verdict = 'match' OR verdict = 'partial'")
def package_verdicts(spark, sf_dir):
    return reconcile.class_verdicts(_games(spark, sf_dir), _packages(spark, sf_dir).filter("error is null"))


@register(f"WITH {_BEST} SELECT game, arg_max(package, ROW(r, created, package)) AS package, arg_max(verdict, ROW(r, created, package)) AS verdict FROM (SELECT *, CASE verdict WHEN 'match' THEN 3 WHEN 'partial' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END AS r FROM v) GROUP BY game")
def package_best(spark, sf_dir):
    return reconcile.best_packages(_games(spark, sf_dir), _packages(spark, sf_dir))


@register("""WITH u AS (SELECT c_mktsegment AS kind, c_name AS original, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS target FROM customer),
    k AS (SELECT kind, count(*) AS n FROM u GROUP BY kind)
    SELECT count(*) AS total, count(target) AS filled, printf('%.1f%%', 100.0 * count(target) / count(*)) AS progress, CAST(sum(length(original)) AS BIGINT) AS chars, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM k) AS kinds FROM u""")
def project_stats(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("original"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("target"))
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return projects.stats(units).withColumn("kinds", kinds)


_STATUS = """s AS (SELECT o_orderkey AS game, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'patched' WHEN o_orderkey % 3 = 0 THEN 'ready' WHEN coalesce(n, 0) > 0 AND done >= n THEN 'translated' WHEN coalesce(n, 0) > 0 AND done > 0 THEN 'progress' WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'new' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS done FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _shown(spark, sf_dir) -> DataFrame:
    """Orders as games, their lines as units."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("units"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    k = F.col("o_orderkey")
    games = table(spark, sf_dir, "orders").join(lines, k == F.col("l_orderkey"), "left")
    games = games.select(k.alias("game"), ((F.col("o_orderstatus") == "F") & (k % 2 == 0)).alias("patched"), F.when(k % 3 == 0, "partial").otherwise("mismatch").alias("verdict"), "units", "done", F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise("x").alias("engine"))
    return projects.status(games)


@register(f"WITH {_STATUS} SELECT game, status FROM s")
def game_status(spark, sf_dir):
    return _shown(spark, sf_dir).select("game", "status")


@register(f"WITH {_STATUS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'patched') AS patched, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status IN ('progress', 'translated')) AS progress, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'unknown') AS unknown FROM s")
def library_summary(spark, sf_dir):
    return projects.summary(_shown(spark, sf_dir))


@register("""WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS t, role FROM conversations), g(ord, term, want) AS (VALUES (0, 'the', 'la'), (1, 'tion', 'ung'), (2, 'and', 'und')),
    h AS (SELECT conv_id, turn, string_agg(term || ' => ' || want, '；' ORDER BY ord) AS terms FROM u, g WHERE contains(t, term) GROUP BY ALL)
    SELECT conv_id || '/' || turn AS uid, CASE WHEN coalesce(role, '') <> '' THEN '说话人：' || role || chr(10) ELSE '' END || coalesce('术语（必须遵守）：' || terms || chr(10), '') || '目标语言：Deutsch' || chr(10) || chr(10) || '原文：' || chr(10) || t || chr(10) || chr(10) || '请只输出译文：' AS prompt
    FROM u LEFT JOIN h USING (conv_id, turn)""")
def unit_prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("uid"), F.coalesce("text", F.lit("")).alias("original"), F.col("role").alias("speaker"), F.lit(None).cast("string").alias("scene"))
    return projects.prompts(turns, glossary_of(spark).filter("ord < 3"), "Deutsch")


@register("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def table_bytes(spark, sf_dir):
    return projects.byte_sums(table(spark, sf_dir, "documents"), "source", "text")


@register(r"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL),
    n AS (SELECT *, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]|[^\x{0}-\x{2e80}]') THEN '<' || text || '>' ELSE text END AS said FROM t)
    SELECT 'data/Map' || conv_id || '.json' AS path, '{"events":[{"pages":{"list":[' || string_agg('{"code":401,"parameters":[' || CASE WHEN role <> 'system' THEN CAST(to_json('<' || role || '>') AS VARCHAR) || ',' ELSE '' END || CAST(to_json(said) AS VARCHAR) || ']}', ',' ORDER BY turn) || ']}}]}' AS text,
        count(*) FILTER (said <> text) + count(*) FILTER (role <> 'system') AS n_replaced, true AS changed FROM n GROUP BY conv_id""")
def event_write_back(spark, sf_dir):
    """Every unit of the event lists in angle brackets, back in its command."""
    files = _events(spark, sf_dir)
    units = game_data.data_units(files).withColumn("target", F.concat(F.lit("<"), "original", F.lit(">")))
    return game_data.data_back(files, units).withColumn("n_replaced", F.col("n_replaced").cast("long"))
