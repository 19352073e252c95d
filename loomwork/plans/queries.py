"""The registered queries: each operator over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork import registry
from loomwork.functions import text as T
from loomwork.operators import audit, ordered, reconcile, terms
from loomwork.sources import text as sources
from loomwork.tables import small_batches

GLOSSARY = [(0, "the", "la"), (1, "tion", "ung"), (2, "and", "und"), (3, "ing", "er"), (4, "heit", "tion"), (5, "eau", "ou"), (6, "en", "an")]
CJK_LINES = ["ギルドにようこそ。", "ギルドに行こう。", "剣を持て、勇者", "はい", "公会接待处", "薬草です"]
GAMES = [("A", ["www", "Game.exe", "data"]), ("B", ["B_Data", "UnityPlayer.dll"]), ("C", ["readme"])]
PACKAGES = [("p1", ["WWW", "game.exe"]), ("p2", ["b_data", "other"]), ("p3", ["nothing"])]
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^{_S}+|{_S}+$', '', 'g')"
_KANA, _CJK = r"[\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{30fd}\x{30fe}]", r"[\x{4e00}-\x{9fff}]"
_TOKENS = lambda c: f"list_sort(regexp_extract_all({c}, '【([0-9]+)】', 1))"
_PREFIX = lambda c: "(" + " OR ".join(f"starts_with({c}, '{p}')" for p in T.BAD_PREFIXES) + ")"
_COUNT = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_UNITS = f"""units AS (SELECT substr(sha1('doc/' || doc_id || '|' || line || '|' || original), 1, 16) AS uid, 'doc/' || doc_id AS source_file, doc_id, CAST(line AS INTEGER) AS line, original
    FROM (SELECT doc_id, i - 1 AS line, {_STRIP('x[i]')} AS original FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))
    WHERE regexp_matches(original, '\\p{{L}}'))"""
_PAIRS = """pairs AS (SELECT conv_id || '/' || turn AS uid, conv_id * 1000 + turn AS seq, coalesce(text, '') AS original, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS target FROM conversations)"""
_GLOSSARY = "glossary(ord, term, want) AS (VALUES " + ", ".join(f"({o}, '{t}', '{w}')" for o, t, w in GLOSSARY) + ")"
_AUDIT = f"""stripped AS (SELECT uid, {_STRIP('original')} AS src, {_STRIP('target')} AS dst, original, target FROM pairs),
    misses AS (SELECT uid, arg_min(term, ord) AS term FROM stripped, glossary WHERE dst <> '' AND contains(original, term) AND NOT contains(target, want) GROUP BY uid),
    dups AS (SELECT dst, count(*) AS n FROM stripped WHERE length(dst) >= 2 GROUP BY dst HAVING count(*) >= 2 AND count(DISTINCT src) >= 2 AND NOT (length(dst) <= 3 AND max(length(src)) <= 3)),
    issues AS (SELECT uid, 'empty' AS code FROM stripped WHERE dst = ''
        UNION ALL SELECT uid, 'identical' FROM stripped WHERE dst <> '' AND src = dst AND regexp_matches(src, '{_KANA}')
        UNION ALL SELECT uid, 'untranslated' FROM stripped WHERE dst <> '' AND src <> dst AND regexp_matches(src, '{_KANA}') AND {_COUNT('dst', _KANA)} / length(dst) > 0.3
        UNION ALL SELECT uid, 'placeholder' FROM stripped WHERE dst <> '' AND len({_TOKENS('src')}) > 0 AND {_TOKENS('src')} <> {_TOKENS('dst')}
        UNION ALL SELECT uid, 'too_short' FROM stripped WHERE dst <> '' AND length(src) >= 6 AND 4 * length(dst) < length(src)
        UNION ALL SELECT uid, 'too_long' FROM stripped WHERE dst <> '' AND length(src) >= 6 AND length(dst) > 4 * length(src)
        UNION ALL SELECT uid, 'prefix_residue' FROM stripped WHERE {_PREFIX('dst')}
        UNION ALL SELECT uid, 'term_miss' FROM misses
        UNION ALL SELECT uid, 'dup_target' FROM stripped JOIN dups USING (dst))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.document_units(table(spark, sf_dir, "documents"))


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the one after it as its target."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("uid"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.coalesce("text", F.lit("")).alias("original"), T.strip(F.col("text")).alias("protected_form"), F.coalesce(after, F.lit("")).alias("target"))


def glossary_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "ord int, term string, want string")


def journal_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: purchases and the like write a text, views are entries without one."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("uid"), F.when(F.col("event_type") != "view", F.concat_ws(":", "event_type", "event_id")).alias("t"), (F.col("event_id") % 2).cast("int").alias("uv"))


_JOURNAL = "journal AS (SELECT event_id AS seq, user_id AS uid, CASE WHEN event_type <> 'view' THEN event_type || ':' || event_id END AS t, CAST(event_id % 2 AS INTEGER) AS uv FROM events)"


def register(oracle: str | None = None):
    def add(f):
        registry.QUERIES[f.__name__] = f
        if oracle:
            registry.ORACLE[f.__name__] = oracle
        return f

    return add


@register(f"WITH {_UNITS} SELECT * FROM units")
def units_from_documents(spark, sf_dir):
    return units_of(spark, sf_dir)


@register(f"WITH {_UNITS} SELECT count(*) AS units, count(DISTINCT source_file) AS files, CAST(sum(length(original)) AS BIGINT) AS chars, printf('%.1f%%', 100.0 * sum(CASE WHEN length(original) > 40 THEN 1 ELSE 0 END) / count(*)) AS long_share FROM units")
def unit_stats(spark, sf_dir):
    long = F.sum(F.when(F.length("original") > 40, 1).otherwise(0))
    return units_of(spark, sf_dir).agg(F.count("*").alias("units"), F.countDistinct("source_file").alias("files"), F.sum(F.length("original")).alias("chars"), F.format_string("%.1f%%", 100.0 * long / F.count("*")).alias("long_share"))


@register(f"WITH {_UNITS} SELECT original, count(*) AS n, arg_min(source_file, doc_id * 100000 + line) AS first_file FROM units GROUP BY original HAVING count(*) > 1")
def dedupe_groups(spark, sf_dir):
    groups = units_of(spark, sf_dir).groupBy("original").agg(F.count("*").alias("n"), F.min_by("source_file", F.struct("doc_id", "line")).alias("first_file"))
    return groups.filter("n > 1")


@register("""SELECT page_id, CAST(i - 1 AS INTEGER) AS ord, original FROM (SELECT page_id, i, """ + _STRIP("x[i]") + r""" AS original FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '>([^<>]+)<', 1) AS x FROM pages)))
    WHERE regexp_matches(original, '\p{L}')""")
def pages_text_nodes(spark, sf_dir):
    return sources.html_units(table(spark, sf_dir, "pages"))


@register(f"""SELECT conv_id, turn, length(s) <= 1 OR (regexp_matches(s, '[A-Za-z]') AND NOT regexp_matches(s, '{_KANA}') AND NOT regexp_matches(s, '{_CJK}')) AS latin_done,
        length(s) <= 1 OR NOT regexp_matches(s, '[A-Za-z\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') OR (regexp_matches(s, '{_CJK}') AND NOT regexp_matches(s, '{_KANA}')) AS hanzi_skip,
        {_COUNT("coalesce(text, '')", '[A-Za-z]')} >= 4 AND {_COUNT("coalesce(text, '')", '[A-Za-z]')} / greatest(length(text), 1) > 0.5 AS mostly_latin
    FROM (SELECT *, {_STRIP('text')} AS s FROM conversations)""")
def prefilter_flags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.already_in_target(F.col("text"), "latin").alias("latin_done"), T.should_skip(F.col("text"), "hanzi").alias("hanzi_skip"), T.mostly_latin(F.col("text")).alias("mostly_latin"))


@register(f"""WITH {_PAIRS}, s AS (SELECT uid, {_STRIP('original')} AS src, {_STRIP('target')} AS dst FROM pairs)
    SELECT uid, CASE WHEN dst = '' THEN 'empty' WHEN src <> '' AND length(dst) > greatest(6 * length(src), 120) THEN 'too_long' WHEN len({_TOKENS('src')}) > 0 AND {_TOKENS('src')} <> {_TOKENS('dst')} THEN 'placeholder'
        WHEN regexp_matches(src, '{_KANA}') AND {_COUNT('dst', _KANA)} / greatest(length(dst), 1) > 0.5 THEN 'untranslated' WHEN {_PREFIX('dst')} THEN 'prefix_residue' END AS code FROM s""")
def check_immediate_codes(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("uid", T.check_immediate(F.col("original"), F.col("target")).alias("code"))


@register(f"WITH {_PAIRS}, {_GLOSSARY}, {_AUDIT} SELECT uid, code FROM issues")
def audit_issues(spark, sf_dir):
    return audit.issues(pairs_of(spark, sf_dir), glossary_of(spark))


@register(f"WITH {_PAIRS}, {_GLOSSARY}, {_AUDIT} SELECT code, count(*) AS n, count(DISTINCT uid) AS units FROM issues GROUP BY code")
def audit_by_code(spark, sf_dir):
    return audit.issues(pairs_of(spark, sf_dir), glossary_of(spark)).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("units"))


@register(f"WITH {_PAIRS}, {_GLOSSARY}, {_AUDIT} SELECT uid, dst AS target, n FROM stripped JOIN dups USING (dst)")
def audit_dup_target(spark, sf_dir):
    return audit.dup_targets(pairs_of(spark, sf_dir))


@register(f"WITH {_PAIRS}, {_GLOSSARY}, {_AUDIT} SELECT uid, original FROM pairs WHERE uid IN (SELECT uid FROM issues WHERE code NOT IN ('too_short', 'dup_target'))")
def fixable_semi(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    found = audit.issues(pairs, glossary_of(spark)).filter(~F.col("code").isin("too_short", "dup_target"))
    return pairs.join(found, "uid", "left_semi").select("uid", "original")


@register(f"WITH {_PAIRS}, {_GLOSSARY}, {_AUDIT} SELECT uid, term FROM misses")
def term_miss_first(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    return audit.term_misses(pairs.filter(T.strip(F.col("target")) != ""), glossary_of(spark))


@register(f"""WITH {_UNITS}, {_GLOSSARY} SELECT uid, term, place FROM (SELECT uid, term, CAST(row_number() OVER (PARTITION BY uid ORDER BY length(term) DESC, ord) AS INTEGER) AS place FROM units, glossary WHERE contains(original, term)) WHERE place <= 3""")
def glossary_relevant_topk(spark, sf_dir):
    return terms.relevant(units_of(spark, sf_dir), glossary_of(spark), 3)


@register(f"WITH {_UNITS} SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(original, '[A-Z][A-Za-z''\\-]*(?:\\s+[A-Z][A-Za-z''\\-]*){{0,2}}')) AS term FROM units WHERE length(original) <= 400) WHERE length(term) >= 3 GROUP BY term")
def latin_term_counts(spark, sf_dir):
    return terms.latin_terms(units_of(spark, sf_dir), longest=400)


@register(f"""WITH {_UNITS}, forms AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(original, '[A-Z][A-Za-z''\\-]*(?:\\s+[A-Z][A-Za-z''\\-]*){{0,2}}')) AS term FROM units WHERE length(original) <= 400) WHERE length(term) >= 3 GROUP BY term)
    SELECT arg_max(term, ROW(n, term)) AS term, CAST(sum(n) AS BIGINT) AS n FROM forms GROUP BY lower(term) HAVING sum(n) >= 3 ORDER BY n DESC, term LIMIT 300""")
def term_candidates_topk(spark, sf_dir):
    return terms.candidates(units_of(spark, sf_dir), longest=400)


_FORMS = r"forms AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(original, '[A-Z][A-Za-z''\-]*(?:\s+[A-Z][A-Za-z''\-]*){0,2}')) AS term FROM units) WHERE length(term) >= 3 GROUP BY term)"


@register(f"WITH {_UNITS}, {_FORMS} SELECT term, n FROM forms")
def latin_term_counts_whole(spark, sf_dir):
    """latin_term_counts over units of every length."""
    return terms.latin_terms(units_of(spark, sf_dir))


@register(f"WITH {_UNITS}, {_FORMS} SELECT arg_max(term, ROW(n, term)) AS term, CAST(sum(n) AS BIGINT) AS n FROM forms GROUP BY lower(term) HAVING sum(n) >= 3 ORDER BY n DESC, term LIMIT 300")
def term_candidates_whole(spark, sf_dir):
    """term_candidates_topk over units of every length."""
    return terms.candidates(units_of(spark, sf_dir))


@register("WITH lines(line) AS (VALUES " + ", ".join(f"('{x}')" for x in CJK_LINES) + r"""), runs AS (SELECT unnest(regexp_extract_all(line, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]+')) AS run FROM lines),
    sizes AS (SELECT run, unnest([2, 3, 4]) AS k FROM runs), grams AS (SELECT substr(run, i, k) AS term FROM (SELECT run, k, unnest(range(1, length(run) - k + 2)) AS i FROM sizes WHERE length(run) >= k))
    SELECT term, count(*) AS n, regexp_matches(term, '[\x{3040}-\x{30ff}]') AS kana FROM grams GROUP BY term""")
def cjk_ngrams(spark, sf_dir):
    return terms.cjk_terms(spark.createDataFrame([(x,) for x in CJK_LINES], "original string"))


@register(f"WITH {_JOURNAL} SELECT uid, arg_max(t, seq) AS t, arg_max(uv, seq) AS uv FROM journal WHERE t IS NOT NULL GROUP BY uid")
def journal_latest(spark, sf_dir):
    return reconcile.latest(journal_of(spark, sf_dir))


@register(f"""WITH {_JOURNAL}, l AS (SELECT uid, arg_max(t, seq) AS t, arg_max(uv, seq) AS uv FROM journal WHERE t IS NOT NULL GROUP BY uid)
    SELECT c_custkey AS uid, coalesce(t, c_name) AS target, coalesce(uv = 1, false) AS unverified FROM customer LEFT JOIN l ON c_custkey = uid""")
def journal_replay(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("target"))
    return reconcile.replay(units, journal_of(spark, sf_dir))


@register(f"WITH {_JOURNAL} SELECT c_custkey AS uid FROM customer WHERE c_custkey NOT IN (SELECT uid FROM journal WHERE t IS NOT NULL AND uid IS NOT NULL)")
def resume_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid")).join(journal_of(spark, sf_dir).filter("t is not null"), "uid", "left_anti")


_MEMORY = "counted AS (SELECT original, target, count(*) AS n, min(seq) AS f FROM package WHERE original <> '' AND target <> '' GROUP BY ALL), memory AS (SELECT original, arg_max(target, ROW(n, -f)) AS target FROM counted GROUP BY original)"
_PACKAGE = "package AS (SELECT doc_id AS seq, doc_id AS uid, coalesce(text, '') AS original, lang || '/' || source AS target FROM documents WHERE doc_id % 2 = 0)"


def package_of(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """A package of documents; without whole it lacks the uids that are odd."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if whole else docs.filter("doc_id % 2 = 0")
    return docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("uid"), F.coalesce("text", F.lit("")).alias("original"), F.concat("lang", F.lit("/"), "source").alias("target"))


@register(f"WITH {_PACKAGE}, {_MEMORY} SELECT * FROM memory")
def tm_most_common(spark, sf_dir):
    return reconcile.memory(package_of(spark, sf_dir))


@register(f"WITH package AS (SELECT doc_id AS seq, coalesce(text, '') AS original, lang || '/' || source AS target FROM documents), {_MEMORY} SELECT * FROM memory")
def tm_most_common_whole(spark, sf_dir):
    """tm_most_common over all documents."""
    return reconcile.memory(package_of(spark, sf_dir, whole=True))


@register(f"""WITH {_PACKAGE}, {_MEMORY}, u AS (SELECT doc_id AS uid, coalesce(text, '') AS original, CASE WHEN doc_id % 10 = 1 THEN 'done' END AS target FROM documents)
    SELECT u.uid, CASE WHEN u.target IS NOT NULL THEN 'kept' WHEN p.target IS NOT NULL THEN 'uid' WHEN m.target IS NOT NULL THEN 'memory' ELSE 'missed' END AS how, coalesce(u.target, p.target, m.target) AS filled
    FROM u LEFT JOIN package p ON p.uid = u.uid LEFT JOIN memory m ON m.original = u.original""")
def package_import_two_level(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.coalesce("text", F.lit("")).alias("original"), F.when(F.col("doc_id") % 10 == 1, "done").alias("target"))
    return reconcile.import_package(units, package_of(spark, sf_dir)).select("uid", "how", "filled")


@register("""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, CASE WHEN b.o_orderkey IS NULL THEN 'base' WHEN a.o_orderkey IS NULL THEN 'new' ELSE 'over' END AS side
    FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey""")
def export_overlay(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return reconcile.overlay(orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 3 = 0"), "o_orderkey", "o_orderstatus")


@register("""SELECT coalesce(b.k, o_orderkey) AS o_orderkey, coalesce(b.status, o_orderstatus) AS o_orderstatus, CASE WHEN b.k IS NULL THEN 'base' WHEN o_orderkey IS NULL THEN 'new' ELSE 'over' END AS side
    FROM orders FULL JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey) b ON o_orderkey = b.k""")
def export_overlay_whole(spark, sf_dir):
    """All orders under what all their lines say."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("o_orderstatus"))
    return reconcile.overlay(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", "o_orderstatus")


_FEATURES = lambda rows: ", ".join(f"('{n}', [{', '.join(repr(x.lower()) for x in f)}])" for n, f in rows)


@register(f"""WITH games(game, f) AS (VALUES {_FEATURES(GAMES)}), packages(package, f) AS (VALUES {_FEATURES(PACKAGES)})
    SELECT game, package, CASE WHEN list_has_all(g.f, p.f) THEN 'match' ELSE 'partial' END AS verdict FROM games g, packages p WHERE list_has_any(g.f, p.f)""")
def fingerprint_verdicts(spark, sf_dir):
    return reconcile.fingerprint_verdicts(spark.createDataFrame(GAMES, "game string, features array<string>"), spark.createDataFrame(PACKAGES, "package string, features array<string>"))


@register("""WITH g AS (SELECT o_custkey AS game, o_orderkey AS f FROM orders), p AS (SELECT DISTINCT l_suppkey || '/' || CAST(l_shipdate AS DATE) AS package, l_orderkey AS f FROM lineitem),
    total AS (SELECT package, count(*) AS n FROM p GROUP BY package), shared AS (SELECT game, package, count(*) AS n FROM g JOIN p USING (f) GROUP BY game, package)
    SELECT game, package, CASE WHEN shared.n = total.n THEN 'match' ELSE 'partial' END AS verdict FROM shared JOIN total USING (package)""")
def fingerprint_verdicts_whole(spark, sf_dir):
    """Customers by their orders, a supplier's day by the orders that it delivers to."""
    key = lambda c: F.array(F.col(c).cast("string")).alias("features")
    games = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("game"), key("o_orderkey"))
    packages = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_suppkey", F.col("l_shipdate").cast("date")).alias("package"), key("l_orderkey"))
    return reconcile.fingerprint_verdicts(games, packages)


@register("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, count(*) OVER () AS total FROM documents),
    s AS (SELECT *, greatest(1, CAST(floor(total * 0.1) AS BIGINT)) AS n FROM r)
    SELECT doc_id FROM s WHERE ceil(CAST(rank AS DOUBLE) * n / total) < n AND floor(ceil(CAST(rank AS DOUBLE) * n / total) * (CAST(total AS DOUBLE) / n)) = rank""")
def sample_stride(spark, sf_dir):
    return ordered.sample_stride(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


@register(f"""WITH {_UNITS}, r AS (SELECT *, row_number() OVER w - 1 AS rn, string_agg(original, chr(10)) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM units WINDOW w AS (PARTITION BY source_file ORDER BY line))
    SELECT source_file, CAST(rn // 8 AS BIGINT) AS chunk, count(*) AS n, CASE WHEN count(*) > 1 THEN coalesce(min(before) FILTER (rn % 8 = 0), '') ELSE '' END AS prior FROM r GROUP BY source_file, rn // 8""")
def chunk_prior_context(spark, sf_dir):
    return ordered.chunks(units_of(spark, sf_dir))


@register("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_id AS c FROM events),
    w AS (SELECT event_id, t - first_value(t) OVER x AS gap, c - first_value(c) OVER x AS grown FROM e WINDOW x AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, CASE WHEN gap / 1e6 < 1 THEN 0.0 ELSE greatest(0.0, grown / (gap / 1e6)) END AS rate FROM w""")
def window_rate(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return ordered.rate(events, "user_id", micros, F.col("event_id"), 3600).select("event_id", F.col("rate").cast("double").alias("rate"))


@register("SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM conversations")
def speaker_carry_forward(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    speaker = F.when(F.col("role") != "assistant", F.concat("role", F.col("turn").cast("string")))
    return ordered.carry_forward(turns, "conv_id", "turn", speaker).select("conv_id", "turn", "carried")


@register("""SELECT doc_id, source, n_chars - 1000 AS delta, n_chars > 1000 AND sum(n_chars - 1000) OVER (PARTITION BY source)
    - coalesce(sum(n_chars - 1000) OVER (PARTITION BY source ORDER BY n_chars - 1000 DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 5000 AS dropped FROM documents""")
def budget_trim(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") - 1000).alias("delta"))
    return ordered.budget_trim(rows, "source", "delta", "doc_id", 5000)


registry.FLAGSHIP = "audit_by_code"
