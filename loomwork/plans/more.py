"""More registered queries: placeholders, outputs, write-back, packages, transformation, scripts and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import outputs, placeholders
from loomwork.functions import text as T
from loomwork.operators import transform, write_back
from loomwork.plans.queries import _CJK, _COUNT, _KANA, _PAIRS, _STRIP, pairs_of, register, table
from loomwork.sources import scripts

_LETTER = r"regexp_matches({}, '\p{{L}}')".format
_LEAKS = ", ".join(f"'{m.lower()}'" for m in outputs.LEAKS)


@register("SELECT conv_id, turn, coalesce(text, '') AS restored FROM conversations")
def protect_round_trip(spark, sf_dir):
    rows = placeholders.protect(table(spark, sf_dir, "conversations"), "text")
    return rows.select("conv_id", "turn", placeholders.restore(F.col("protected"), F.col("parts")).alias("restored"))


@register()
def protected_texts(spark, sf_dir):
    return placeholders.protect(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "protected", "parts")


@register(f"""WITH s AS (SELECT conv_id, turn, {_STRIP('text')} AS t FROM conversations), c AS (SELECT *, CASE turn % 3 WHEN 1 THEN replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)) ELSE t END AS x FROM s)
    SELECT conv_id, turn, {_STRIP("CASE WHEN turn % 3 <> 1 AND length(x) >= 2 AND x[1] = x[-1] AND contains('\"''“”', x[1]) THEN x[2:-2] ELSE x END")} AS cleaned FROM c""")
def clean_outputs(spark, sf_dir):
    text, kind = F.coalesce("text", F.lit("")), F.col("turn") % 3
    given = F.when(kind == 0, F.concat(F.lit("译文："), text)).when(kind == 1, F.concat(F.lit('“'), T.strip(text), F.lit("“"))).otherwise(F.concat(F.lit("```json\n"), text, F.lit("\n```")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", outputs.clean(given).alias("cleaned"))


@register(f"""WITH {_PAIRS}, s AS (SELECT uid, original, {_STRIP('target')} AS v FROM pairs)
    SELECT uid, v <> '' AND (len(list_filter([{_LEAKS}], lambda m: contains(lower(v), m))) > 0 OR (length(original) >= 8 AND length(v) > greatest(64, 6 * length(original)))) AS leaked FROM s""")
def leaked_outputs(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("uid", outputs.leaked(F.col("target"), F.col("original")).alias("leaked"))


@register(f"""WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    y AS (SELECT doc_id, list_transform(l, lambda r: {_STRIP('r')}) AS s, l FROM x)
    SELECT doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN {_LETTER('s[i]')} THEN substr(l[i], 1, strpos(l[i], s[i]) - 1) || '<' || s[i] || '>' || substr(l[i], strpos(l[i], s[i]) + length(s[i])) ELSE l[i] END), chr(10)) AS text,
        CAST(len(list_filter(s, lambda r: {_LETTER('r')})) AS BIGINT) AS n_replaced FROM y""")
def write_back_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "raw"))
    units = raw.withColumn("original", T.strip(F.col("raw"))).filter(F.col("original").rlike(r"\p{L}"))
    units = units.select("doc_id", "line", (F.instr("raw", F.col("original")) - 1).alias("start"), "original", F.concat(F.lit("<"), "original", F.lit(">")).alias("target"))
    return write_back.lines_back(docs, units, "doc_id")


@register("SELECT count(*) AS units, count(*) FILTER (WHERE c_custkey % 4 > 0) AS filled, count(DISTINCT c_nationkey) AS files, printf('%.1f%%', 100.0 * count(*) FILTER (WHERE c_custkey % 4 > 0) / count(*)) AS progress, count(*) FILTER (WHERE c_custkey % 4 > 0) = count(*) AS complete FROM customer")
def package_manifest(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("source_file"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("target"))
    return write_back.manifest(units)


_EXPORT = "a AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT * FROM orders WHERE o_orderkey % 3 = 0), w AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS k, CASE WHEN b.o_orderkey IS NULL THEN 'base' ELSE 'over' END AS side FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"


@register(f"WITH {_EXPORT} SELECT CAST(k AS VARCHAR) AS rel, CAST(k % 7 AS BIGINT) AS size, CAST(CASE side WHEN 'over' THEN 9 ELSE 5 END AS BIGINT) AS mtime, side FROM w WHERE NOT (k % 5 = 0 AND side = 'base')")
def export_incremental(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    listing = lambda df, time: df.select(F.col("k").cast("string").alias("rel"), (F.col("k") % 7).cast("long").alias("size"), F.lit(time).alias("mtime"))
    return write_back.export_plan(listing(keys.filter("k % 2 = 0"), 5.25), listing(keys.filter("k % 3 = 0"), 9.0), listing(keys.filter("k % 5 = 0"), 5.75))


@register("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(max(l_linenumber) AS BIGINT) AS last FROM lineitem GROUP BY l_orderkey),
    w AS (SELECT o_orderkey AS k, coalesce(n, o_custkey % 7) AS size, CASE WHEN n IS NULL THEN 5 ELSE 9 END AS mtime, CASE WHEN n IS NULL THEN 'base' ELSE 'over' END AS side, last FROM orders LEFT JOIN l ON k = o_orderkey)
    SELECT CAST(k AS VARCHAR) AS rel, CAST(size AS BIGINT) AS size, CAST(mtime AS BIGINT) AS mtime, side FROM w WHERE last IS NULL OR size <> last""")
def export_incremental_whole(spark, sf_dir):
    """All orders, under those that have lines; present: what the last line's number says."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"))
    listing = lambda df, key, size, time: df.select(F.col(key).cast("string").alias("rel"), size.cast("long").alias("size"), F.lit(time).alias("mtime"))
    base = listing(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey") % 7, 5.25)
    return write_back.export_plan(base, listing(lines, "k", F.col("n"), 9.0), listing(lines, "k", F.col("last"), 9.75))


@register("""WITH f AS (SELECT substr(coalesce(text, ''), 1, 12) AS stem, sha1(coalesce(text, '')) AS content_hash, min(doc_id) AS seq FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY seq) AS nth FROM f)
    SELECT stem, content_hash, CASE WHEN nth = 1 THEN stem ELSE stem || '-' || nth END AS name FROM r""")
def repository_insert(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return write_back.repository_names(table(spark, sf_dir, "documents").select(F.substring(text, 1, 12).alias("stem"), text.alias("content"), F.col("doc_id").alias("seq")))


def marked(texts: list[str]) -> list[str]:
    """A stand-in for a model: repeatable, and it keeps placeholders."""
    return [f"~{x}" for x in texts]


@register(f"""WITH s AS (SELECT conv_id || '/' || turn AS uid, coalesce(text, '') AS original, {_STRIP('text')} AS s FROM conversations),
    k AS (SELECT *, length(s) <= 1 OR NOT regexp_matches(s, '[A-Za-z\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') OR (regexp_matches(s, '{_CJK}') AND NOT regexp_matches(s, '{_KANA}')) AS skip FROM s)
    SELECT uid, CASE WHEN NOT skip THEN '~' || original END AS target, CASE WHEN skip THEN 'skipped' WHEN regexp_matches(s, '{_KANA}') AND {_COUNT('s', _KANA)} / (length(s) + 1) > 0.5 THEN 'untranslated' ELSE 'done' END AS how FROM k""")
def transform_units(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("uid"), F.coalesce("text", F.lit("")).alias("original"))
    return transform.transform(units, marked).select("uid", "target", "how")


@register(r"""SELECT conv_id || '/' || turn AS path, 1 AS line, 'spoken' AS form, role AS speaker, text AS original FROM conversations WHERE regexp_matches(text, '[\p{L}\p{N}]|[^\x{0}-\x{2e80}]')""")
def dialogue_script_lines(spark, sf_dir):
    body = F.replace(F.replace("text", F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    files = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("path"), F.concat("role", F.lit(' "'), body, F.lit('"')).alias("text"))
    return scripts.dialogue_lines(files)


_HOST, _REL = "regexp_extract(url, '://([^/?#]*)', 1)", "lower(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1))"


@register(f"""WITH l AS (SELECT {_HOST} AS root, {_REL} AS rel, length(html) AS size FROM pages WHERE url IS NOT NULL),
    f AS (SELECT *, regexp_matches(rel, '\\.(txt|json|csv|xml|ya?ml|po|srt|ass|lang)$') AND size >= 64 AS t FROM l)
    SELECT root, CASE WHEN bool_or(regexp_matches(rel, '^[^/]+\\.xp3$')) THEN 'kirikiri' WHEN bool_or(regexp_matches(rel, '^(www/)?data/(system|mapinfos|commonevents)\\.json$')) THEN 'rpgmaker_mv' WHEN bool_or(regexp_matches(rel, '\\.(rpyc?|rpa)$')) THEN 'renpy'
        WHEN bool_or(regexp_matches(rel, '^[^/]+_data/|^unityplayer[.]dll$')) THEN 'unity' WHEN bool_or(regexp_matches(rel, '^([^/]+/)?[^/]+\\.exe$')) AND count(*) FILTER (WHERE t) >= 3 AND sum(least(size, 8388608)) FILTER (WHERE t) >= 1024 THEN 'plaintext' ELSE 'unknown' END AS engine, count(*) AS files
    FROM f GROUP BY root""")
def engine_detection(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    return scripts.engines(pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("root"), F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("rel"), F.length("html").alias("size")))
