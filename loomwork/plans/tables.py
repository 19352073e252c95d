"""Registered queries of language tables, string tables, budgets, claims and encodings."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import batches, reconcile, splice
from loomwork.plans.queries import _STRIP, register, table
from loomwork.sources import encodings, language_tables, string_tables
from loomwork.tables import checkpointed


def _trees(spark, sf_dir):
    """For each brand and type a tree with an empty table, and deep in it one of a term for each part, in three languages and a column about them."""
    parts = table(spark, sf_dir, "part")
    term = F.struct(F.concat_ws(" ", "p_name", "p_size").alias("en"), "p_name", F.col("p_partkey").alias("k"))
    rows = parts.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", term.alias("x")))).alias("terms"))
    made = F.transform("terms", lambda t: F.struct(t["p_partkey"].alias("Term"), F.array(F.lit("meta"), t["x"]["p_name"], F.concat(F.lit(" "), t["x"]["en"], F.lit("\n"))).alias("Languages")))
    languages = F.array(F.struct(F.lit("IdString").alias("Name"), F.lit("").alias("Code")), F.struct(F.lit("P").alias("Name"), F.lit("pt-BR").alias("Code")), F.struct(F.lit("E").alias("Name"), F.lit("EN-us ").alias("Code")))
    inner = F.struct(languages.alias("mLanguages"), made.alias("mTerms"))
    tree = F.struct(F.array().cast("array<int>").alias("mTerms"), F.array(F.struct(F.lit(1).alias("x")).alias("no"), F.struct(F.lit(2).alias("x"))).alias("list"), F.struct(F.array(inner).alias("sources")).alias("mSource"))
    return rows.select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.to_json(tree).alias("text"))


@register("""SELECT p_brand || '/' || p_type AS path, 'mSource/sources/0/mTerms/' || (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1) || '/Languages/2' AS place, p_name || ' ' || p_size AS original FROM part""")
def language_table_units(spark, sf_dir):
    found = language_tables.language_units(_trees(spark, sf_dir))
    return found.select("path", F.array_join("place", "/").alias("place"), "original")


def _string_tables(spark, sf_dir):
    """For each brand and type a table with an entry for each part: every second value quoted, some entries without text, one inside a value."""
    parts = table(spark, sf_dir, "part")
    bare = F.concat("p_name", F.lit(":"), F.col("p_size").cast("string"))
    quoted = F.concat(F.lit('"'), "p_name", F.lit(' \\"A=LineCodeData{Text=no;}\\"\\n"'))
    entry = F.concat(F.lit("K"), "p_partkey", F.lit("=LineCodeData{ID=1;Text="), F.when(F.col("p_size") % 2 == 0, quoted).otherwise(bare), F.lit(";Character="), "p_type", F.lit(";SoundCue=x;};\n"), F.when(F.col("p_size") == 7, F.lit("Z=LineCodeData{" + "-" * 81 + "};\n")).otherwise(""))
    rows = parts.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))).alias("x"))
    return rows.select(F.concat(F.lit("stringtable/"), "p_brand", F.lit("_"), "p_type", F.lit("_usenglish")).alias("path"), F.concat(F.lit("StringTable{\n"), F.array_join("x.e", ""), F.lit("CMAP0=LineCodeData{Text=abc;};}")).alias("text"))


_VALUE = """CASE WHEN p_size % 2 = 0 THEN p_name || ' "A=LineCodeData{Text=no;}"' || chr(10) ELSE p_name || ':' || p_size END"""
_RAW = """CASE WHEN p_size % 2 = 0 THEN '"' || p_name || ' \\"A=LineCodeData{Text=no;}\\"\\n"' ELSE p_name || ':' || p_size END"""
_ENTRIES = f"""made AS (SELECT 'stringtable/' || p_brand || '_' || p_type || '_usenglish' AS path, 'K' || p_partkey AS name, p_type AS speaker, p_partkey AS k, p_name, p_size, p_type, {_VALUE} AS value, {_RAW} AS raw,
    'K' || p_partkey || '=LineCodeData{{ID=1;Text=' AS before, ';Character=' || p_type || ';SoundCue=x;}};' || chr(10) || CASE WHEN p_size = 7 THEN 'Z=LineCodeData{{' || repeat('-', 81) || '}};' || chr(10) ELSE '' END AS after FROM part)"""


@register(f"""WITH {_ENTRIES}, placed AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS n, CAST(13 + sum(length(before || raw || after)) OVER w - length(raw || after) AS INTEGER) AS start FROM made WINDOW w AS (PARTITION BY path ORDER BY k))
    SELECT path, n, name, raw, value AS value, speaker, start, CAST(start + length(raw) AS INTEGER) AS "end" FROM placed""")
def string_table_entries(spark, sf_dir):
    found = string_tables.entries(_string_tables(spark, sf_dir)).filter(~F.col("name").startswith("CMAP"))
    return found.withColumnRenamed("key", "path")


_WIDE = "{} || '，' || p_type || '！（' || p_size || '；）。'"
_NARROW = [lambda c: c, lambda c: f"translate({c}, '（）；', '();')", lambda c: f"translate({c}, '（）；！', '();!')", lambda c: f"translate({c}, '（）；！，。', '();!,.')"]
_EMIT = lambda c: f"""CASE WHEN p_size % 2 = 0 OR contains({c}, ';') OR contains({c}, '"') OR contains({c}, '{{') OR contains({c}, chr(10)) THEN '"' || replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"' ELSE {c} END"""


@register(f"""WITH {_ENTRIES}, new AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS n, {_WIDE.format('value')} AS t FROM made),
    steps AS (SELECT *, {', '.join(f'{_EMIT(f(chr(116)))} AS v{i}' for i, f in enumerate(_NARROW))} FROM new),
    sized AS (SELECT *, {', '.join(f'strlen(v{i}) - strlen(raw) AS d{i}' for i in range(4))} FROM steps),
    sums AS (SELECT path, CAST(count(*) * 7 * (length(path) % 6) AS BIGINT) AS room, {', '.join(f'sum(d{i}) AS s{i}' for i in range(4))} FROM sized GROUP BY path),
    chosen AS (SELECT *, CASE WHEN s0 <= room THEN 0 WHEN s1 <= room THEN 1 WHEN s2 <= room THEN 2 ELSE 3 END AS step FROM sums),
    picked AS (SELECT z.*, step, room, CASE step WHEN 0 THEN v0 WHEN 1 THEN v1 WHEN 2 THEN v2 ELSE v3 END AS v, CASE step WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM sized z JOIN chosen USING (path)),
    lefts AS (SELECT *, d > 0 AND sum(d) OVER (PARTITION BY path ORDER BY d DESC, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > room AS cut FROM picked),
    final AS (SELECT *, cut OR sum(CASE WHEN cut THEN 0 ELSE d END) OVER (PARTITION BY path) > room AS dropped FROM lefts)
    SELECT path, 'StringTable{{' || chr(10) || string_agg(before || CASE WHEN dropped THEN raw ELSE v END || after, '' ORDER BY k) || 'CMAP0=LineCodeData{{Text=abc;}};}}' AS text,
        count(*) FILTER (NOT dropped) AS n_replaced, CAST(max(step) AS INTEGER) AS step, count(*) FILTER (dropped) AS n_dropped FROM final GROUP BY path""")
def string_table_refill(spark, sf_dir):
    """Tables lie one behind the other in a pack; what a table may have is what lies between its offset and the next."""
    files = _string_tables(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("K"), "p_partkey").alias("name"), "p_type", "p_size")
    units = string_tables.table_units(files).join(parts, "name")
    target = F.concat("original", F.lit("，"), "p_type", F.lit("！（"), F.col("p_size").cast("string"), F.lit("；）。"))
    size = units.groupBy("path").agg(F.count("*").alias("n")).join(files, "path")
    size = size.withColumn("slot", F.octet_length("text") + F.col("n") * 7 * (F.length("path") % 6)).withColumn("pack", F.substring("path", 1, 20))
    offsets = size.withColumn("offset", F.sum("slot").over(W.partitionBy("pack").orderBy("path")) - F.col("slot")).withColumn("end", F.sum("slot").over(W.partitionBy("pack")))
    budgets = string_tables.slots(offsets.drop("slot"), "pack", "offset", F.col("end")).select("path", F.col("slot").alias("budget"))
    return string_tables.refilled(files, units.select("path", "name", "original", target.alias("target")), budgets)


@register("""WITH held AS (SELECT p_brand AS name, p_size % 5 AS place, p_type AS key, p_name AS value, count(*) AS c FROM part GROUP BY ALL),
    asked AS (SELECT p_brand AS name, p_type AS key, p_name AS original, count(*) AS n FROM part WHERE p_size > 25 GROUP BY ALL),
    pairs AS (SELECT a.*, place FROM asked a JOIN held h ON a.name = h.name AND a.key = h.key AND a.original = h.value),
    firsts AS (SELECT name, min(place) AS place FROM pairs GROUP BY name) SELECT p.* FROM pairs p JOIN firsts USING (name, place)""")
def claimed_tables(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    name, key = F.col("p_brand").alias("name"), F.col("p_type").alias("key")
    held = parts.groupBy(name, (F.col("p_size") % 5).alias("place"), key, F.col("p_name").alias("value")).count()
    asked = parts.filter("p_size > 25").groupBy(name, key, F.col("p_name").alias("original")).agg(F.count("*").alias("n"))
    return string_tables.claimed(asked, held)


@register("""SELECT doc_id, coalesce(text, '') AS text, CASE lang WHEN 'en' THEN 'utf-16-le' WHEN 'fr' THEN 'utf-16-be' ELSE 'utf-8' END AS charset, lang IN ('en', 'fr', 'de') AS mark, false AS lossy, true AS same FROM documents
    UNION ALL SELECT -1 - c_custkey, 'テスト' || c_name, 'shift_jis', false, false, true FROM customer""")
def encodings_by_trial(spark, sf_dir):
    docs, lang, text = table(spark, sf_dir, "documents"), F.col("lang"), F.coalesce("text", F.lit(""))
    data = F.when(lang == "en", F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE"))).when(lang == "fr", F.concat(F.lit(b"\xfe\xff"), F.encode(text, "UTF-16BE"))).when(lang == "de", F.concat(F.lit(b"\xef\xbb\xbf"), text.cast("binary"))).otherwise(text.cast("binary"))
    customers = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"), F.concat(F.lit("テスト".encode("shift_jis")), F.col("c_name").cast("binary")).alias("data"))
    rows = docs.select("doc_id", data.alias("data")).union(customers).select("doc_id", "data", encodings.decoded(F.col("data")).alias("x")).select("doc_id", "data", "x.*")
    back = encodings.encoded(F.col("text"), F.col("charset"), F.col("mark"))
    return rows.select("doc_id", "text", "charset", "mark", "lossy", back.eqNullSafe(F.col("data")).alias("same"))


@register(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(coalesce(text, '')), 'french|german|italian|spanish|portuguese|polish|russian|japanese|korean|chinese|leet|dede|frfr|itit|eses|ptbr|ruru|jajp|kokr|zhcn|zhtw') THEN 'other'
    WHEN regexp_matches(lower(coalesce(text, '')), 'english|enus|engb') THEN NULL ELSE 'unknown' END AS why, {_STRIP('text')} <> '' AS said FROM conversations""")
def language_gates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", string_tables.language_gate(F.coalesce("text", F.lit(""))).alias("why"), (T.strip(F.col("text")) != "").alias("said"))


def _dialogues(spark, sf_dir):
    """For each brand and type a node: a line for each part with a speaker, a tag and a command."""
    line = F.concat("p_type", F.lit(": "), "p_name", F.lit(" size <<if $a>> #line:a"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l"), "p_name", "p_size"))).alias("x"))
    return rows.withColumn("path", F.concat_ws("/", "p_brand", "p_type"))


@register("""WITH x AS (SELECT *, p_brand || '/' || p_type AS path, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) + 2 AS line, p_name || ' size' AS body FROM part),
    y AS (SELECT *, CASE p_size % 6 WHEN 0 THEN 'new // ' || body WHEN 1 THEN body || chr(10) || 'x' WHEN 2 THEN body || ' #tag' WHEN 3 THEN '' ELSE body || '!' END AS target,
        CASE p_size % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'lines' WHEN 2 THEN 'text' WHEN 3 THEN 'unfilled' END AS why FROM x)
    SELECT path, 'title: n' || chr(10) || '---' || chr(10) || string_agg(p_type || ': ' || CASE WHEN why IS NULL THEN target ELSE body END || ' <<if $a>> #line:a' || p_partkey, chr(10) ORDER BY line) || chr(10) || '===' AS text,
        count(*) FILTER (why IS NULL) AS n_replaced, count(*) FILTER (why = 'text') AS n_text, count(*) FILTER (why = 'lines') AS n_lines FROM y GROUP BY path""")
def spliced_dialogues(spark, sf_dir):
    rows = _dialogues(spark, sf_dir)
    files = checkpointed(rows.select("path", F.concat(F.lit("title: n\n---\n"), F.array_join("x.l", "\n"), F.lit("\n===")).alias("text")))
    units = rows.select("path", F.posexplode("x").alias("i", "p")).select("path", (F.col("i") + 3).alias("line"), F.concat("p.p_name", F.lit(" size")).alias("body"), (F.col("p.p_size") % 6).alias("k"))
    body, k = F.col("body"), F.col("k")
    target = F.when(k == 0, F.concat(F.lit("new // "), body)).when(k == 1, F.concat(body, F.lit("\nx"))).when(k == 2, F.concat(body, F.lit(" #tag"))).when(k == 3, "").otherwise(F.concat(body, F.lit("!")))
    out, edits = splice.statements_back(files, units.withColumn("target", target))
    told = edits.groupBy("path").agg(F.count_if(F.col("why") == "text").alias("n_text"), F.count_if(F.col("why") == "lines").alias("n_lines"))
    return out.join(told, "path", "left").na.fill(0, ["n_text", "n_lines"])


def _keyed(items: dict[int, str]) -> str:
    """A stand-in for a service: it answers in upper case, but for batches whose first text is of an odd length, where it drops a number."""
    out = {str(i): t.upper() for i, t in items.items()}
    if len(items[1]) % 2:
        out.pop(str(len(items)))
    return "Here: " + json.dumps(out, ensure_ascii=False)


@register("""WITH s AS (SELECT p_partkey AS seq, p_name || ' ' || p_size AS original FROM part), t AS (SELECT original, min(seq) AS f FROM s GROUP BY original),
    r AS (SELECT original, row_number() OVER (ORDER BY f) - 1 AS r FROM t), b AS (SELECT *, r // 8 AS batch, first_value(original) OVER (PARTITION BY r // 8 ORDER BY r) AS head FROM r)
    SELECT seq, original, upper(original) AS target, CASE WHEN length(head) % 2 = 1 THEN 'single' ELSE 'batched' END AS how FROM s JOIN b USING (original)""")
def keyed_batches(spark, sf_dir):
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("uid"), F.concat_ws(" ", "p_name", "p_size").alias("original"))
    out, _ = batches.transform(units, _keyed, str.upper)
    return out.select(F.col("uid").alias("seq"), "original", "target", "how")


@register("""WITH p AS (SELECT c_name AS package, c_acctbal AS created, CASE WHEN c_acctbal < 0 THEN 'broken' ELSE '' END AS error, c_nationkey < 12 AS has_exe, c_nationkey IN (3, 7) AS exe, c_mktsegment IN ('BUILDING', 'MACHINERY') AS dirs FROM customer),
    v AS (SELECT *, CASE WHEN error <> '' THEN 'unknown' WHEN dirs AND (exe OR NOT has_exe) THEN 'match' WHEN dirs OR exe THEN 'partial' ELSE 'mismatch' END AS verdict FROM p),
    r AS (SELECT *, row_number() OVER (ORDER BY CASE verdict WHEN 'match' THEN 0 WHEN 'partial' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, created DESC, package COLLATE "C" DESC) AS place FROM v)
    SELECT place, package, verdict, concat_ws(',', CASE WHEN exe THEN 'exe' END, CASE WHEN dirs THEN 'dirs' END) AS shared, error FROM r UNION ALL SELECT 0, 'own', 'match', '', ''""")
def packages_ranked(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    none = F.array().cast("array<string>")
    packages = c.select(F.col("c_name").alias("package"), F.col("c_acctbal").alias("created"), F.when(F.col("c_acctbal") < 0, "broken").alias("error"), F.when(F.col("c_nationkey") < 12, F.array(F.concat(F.lit("N"), "c_nationkey"), F.lit("x.exe"))).alias("exe"), none.alias("data_dirs"), none.alias("packs"), F.array(F.lower("c_mktsegment")).alias("dirs"))
    out = reconcile.ranked_packages({"exe": ["n3", "N7"], "packs": ["a"], "dirs": ["BUILDING", "Machinery"]}, packages, "own")
    return out.withColumn("shared", F.array_join("shared", ","))
