"""Registered queries of plug-ins in SQL, listings, the file sink and the change log's stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.plans.queries import _JOURNAL, _S, _STRIP, journal_of, register, table
from loomwork.sources import listing, plugins, sink
from loomwork.streaming import store
from loomwork.tables import checkpointed, shared_folder


def _view(spark, df, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


@register(r"""SELECT CAST(page_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS ord, original
    FROM (SELECT page_id, i, """ + _STRIP("x[i]") + r""" AS original FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '>([^<>]+)<', 1) AS x FROM pages))) WHERE regexp_matches(original, '\p{L}')""")
def plugin_nodes(spark, sf_dir):
    plugins.install(spark)
    pages = _view(spark, table(spark, sf_dir, "pages"), "plugin_pages")
    return spark.sql(f"SELECT key, ord, original FROM extract('nodes', TABLE(SELECT CAST(page_id AS STRING) AS key, html AS text FROM {pages}))")


@register(rf"""WITH lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, {_STRIP('x[i]')} AS said FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
    runs AS (SELECT *, count(*) FILTER (said = '') OVER (PARTITION BY doc_id ORDER BY line) AS blank FROM lines)
    SELECT CAST(doc_id AS VARCHAR) AS key, min(line) AS first_line, CAST(count(*) AS INTEGER) AS n_lines, string_agg(said, ' ' ORDER BY line) AS original FROM runs WHERE said <> '' GROUP BY doc_id, blank""")
def plugin_paragraphs(spark, sf_dir):
    plugins.install(spark)
    docs = _view(spark, table(spark, sf_dir, "documents"), "plugin_documents")
    return spark.sql(f"SELECT * FROM extract('paragraphs', TABLE(SELECT CAST(doc_id AS STRING) AS key, pos AS line, col AS text FROM {docs} LATERAL VIEW posexplode(split(coalesce(text, ''), '\n', -1)) x))")


@register(rf"""SELECT CAST(page_id AS VARCHAR) AS key, regexp_replace(html, '>({_S}*)([^<>]*?\p{{L}}[^<>]*?)({_S}*)<', '>\1[\2]\3<', 'g') AS text,
    CAST(len(list_filter(regexp_extract_all(html, '>([^<>]+)<', 1), lambda x: regexp_matches(x, '\p{{L}}'))) AS INTEGER) AS n_replaced FROM pages WHERE regexp_matches(html, '>[^<>]*\p{{L}}[^<>]*<')""")
def plugin_put_back(spark, sf_dir):
    plugins.install(spark)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.col("html").alias("text"))
    _view(spark, pages, "plugin_texts")
    units = spark.sql("SELECT * FROM extract('nodes', TABLE(plugin_texts))")
    edits = units.groupBy("key").agg(F.collect_list(F.struct("ord", "original", F.concat(F.lit("["), "original", F.lit("]")).alias("target"))).alias("edits"))
    _view(spark, pages.join(edits, "key"), "plugin_changed")
    return spark.sql("SELECT * FROM put_back('nodes', TABLE(plugin_changed))")


def _part_files(spark, sf_dir):
    """A file of names for each brand, type and size, in folders by brand and type."""
    rel = F.concat_ws("/", "p_brand", "p_type", F.concat(F.col("p_size").cast("string"), F.lit(".TXT")))
    return table(spark, sf_dir, "part").groupBy(rel.alias("rel")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("data"))


_PART_FILES = """part_files AS (SELECT p_brand || '/' || p_type || '/' || p_size || '.TXT' AS rel, string_agg(p_name, chr(10) ORDER BY p_name) AS data FROM part GROUP BY 1)"""


@register(f"""WITH {_PART_FILES}, seen AS (SELECT rel, CAST(strlen(data) AS BIGINT) AS size, row_number() OVER (ORDER BY substr(rel, 1, length(rel) - position('/' IN reverse(rel))), rel) AS nth FROM part_files)
    SELECT rel, size, nth, CASE WHEN (SELECT count(*) FROM part_files) > 500 THEN 'files' ELSE '' END AS reason FROM seen WHERE nth <= 500""")
def folder_listing(spark, sf_dir):
    dest = shared_folder(spark)
    sink.write_files(_part_files(spark, sf_dir), dest)
    root = dest.removeprefix("file://")
    found, stats = listing.listing(spark.createDataFrame([(root,)], "root string"), depth=4, most=500, seconds=600.0)
    files = listing.of_suffix(found, [".txt"])
    return files.join(stats.select("root", "reason"), "root").select("rel", "size", "nth", "reason")


@register(f"""WITH {_PART_FILES} SELECT rel, CAST(strlen(data) + CASE WHEN hit THEN 1 ELSE 0 END AS BIGINT) AS size, sha1(data || CASE WHEN hit THEN '!' ELSE '' END) AS sha1, hit AS written, hit AS changed
    FROM (SELECT *, contains(data, 'a') AND length(data) % 3 = 0 AS hit FROM part_files)""")
def file_sink(spark, sf_dir):
    source, dest = shared_folder(spark), shared_folder(spark)
    files = checkpointed(_part_files(spark, sf_dir))
    for to in (source, dest):
        sink.write_files(files, to)
    edited = files.withColumn("data", F.when(F.col("data").contains("a") & (F.length("data") % 3 == 0), F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    return sink.write_files(edited, dest, source)


@register(f"""WITH {_JOURNAL}, last AS (SELECT uid, arg_max(t, seq) AS t, arg_max(uv, seq) AS uv FROM journal WHERE t IS NOT NULL GROUP BY uid)
    SELECT uid, uid % 7 AS kind, t AS target, coalesce(uv = 1, false) AS unverified FROM (SELECT DISTINCT uid FROM journal) LEFT JOIN last USING (uid)""")
def journal_store(spark, sf_dir):
    """Events as entries: files of them are streamed into a project's log, which is compacted between two streams."""
    journal, folder = checkpointed(journal_of(spark, sf_dir)), shared_folder(spark)
    project = store.Project(spark, f"{folder}/project")
    project.save(journal.select("uid", (F.col("uid") % 7).alias("kind"), F.lit(None).cast("string").alias("target")).distinct(), {"name": "events"})
    middle = journal.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    halves = [F.col("seq") <= middle, F.col("seq") > middle]
    for half in halves:  # one file after the other, so that the stream sees them in this order
        journal.filter(half).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(journal.schema).parquet(f"{folder}/in")
        store.into(stream, project.log, "events", f"{folder}/checkpoint", "seq").trigger(availableNow=True).start().awaitTermination()
        if half is halves[0]:
            project.compact()
    loaded = project.load()
    return loaded.select("uid", "kind", "target", "unverified")
