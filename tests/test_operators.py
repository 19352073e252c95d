import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.operators import audit, ordered, reconcile, terms
from loomwork.sources import text as sources
from loomwork.streaming import journal


def test_audit(spark):
    units = [
        ("u1", "おやすみ", "晚安"), ("u2", "よるかぜ", ""), ("u3", "ランタンを消して", "请把灯笼熄灭吧"), ("u4", "ランタンの油", "ランタンの油"),
        ("u5", "またあした", "回头见"), ("u6", "またこんど", "回头见"), ("u7", "ふかいもりのおくにあるちいさないえ", "家"), ("u8", "しずかなよるだね", "宁静なよる"),
    ]
    df = spark.createDataFrame(units, "uid string, original string, target string")
    glossary = spark.createDataFrame([(0, "ランタン", "灯笼")], "ord int, term string, want string")
    got = {(r.uid, r.code) for r in audit.issues(df, glossary).collect()}
    assert got == {("u2", "empty"), ("u4", "identical"), ("u4", "term_miss"), ("u5", "dup_target"), ("u6", "dup_target"), ("u7", "too_short"), ("u8", "untranslated")}


def test_journal_replay(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", None) for i in range(5)], "uid string, target string")
    log = spark.createDataFrame([(1, "u0", "a", None), (2, "u2", "b", 1), (3, "u0", "c", None), (4, "nobody", "x", None), (5, "u2", None, None)], "seq long, uid string, t string, uv int")
    got = {r.uid: (r.target, r.unverified) for r in reconcile.replay(units, log).collect()}
    assert got == {"u0": ("c", False), "u1": (None, False), "u2": ("b", True), "u3": (None, False), "u4": (None, False)}
    (tmp_path / "log").mkdir()
    lines = [json.dumps({"seq": r.seq, "uid": r.uid, "t": r.t, "uv": r.uv}) for r in log.collect()] + ["not json"]
    (tmp_path / "log/a.jsonl").write_text("\n".join(lines))
    query = journal.latest(journal.read(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("last").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.uid, r.t) for r in spark.table("last").collect()} == {("u0", "c"), ("u2", "b"), ("nobody", "x")}


@pytest.mark.parametrize(("n", "rate", "want"), [(100, 0.1, list(range(0, 100, 10))), (100, 1.0, list(range(100))), (100, 0.001, [0]), (7, 0.5, [0, 2, 4]), (0, 0.5, [])])
def test_sample_stride(spark, n, rate, want):
    rows = spark.range(n).withColumnRenamed("id", "k")
    assert sorted(r.k for r in ordered.sample_stride(rows, "k", rate).collect()) == want


def test_terms(spark):
    lines = spark.createDataFrame([(x,) for x in ["I met Candy Corn", "Then CANDY CORN", "see Candy Corn", "x"]], "original string")
    got = {r.term: r.n for r in terms.candidates(lines, least=2).collect()}
    assert got["Candy Corn"] == 2 and "x" not in got
    kana = {r.term: r.kana for r in terms.cjk_terms(spark.createDataFrame([("ギルドに",), ("公会",)], "original string")).collect()}
    assert kana["ギルド"] and not kana["公会"] and len(kana) == 7


def test_terms_of_long_texts(spark):
    lines = spark.createDataFrame([("x " * 300 + "met Candy Corn",), ("see Candy Corn",)], "original string")
    assert {r.term: r.n for r in terms.latin_terms(lines).collect()} == {"Candy Corn": 2}
    assert {r.term: r.n for r in terms.latin_terms(lines, longest=400).collect()} == {"Candy Corn": 1}
    assert [r.n for r in terms.candidates(lines, least=2).collect()] == [2]


def test_sources(spark):
    srt = "1\r\n00:00:01 --> 00:00:02\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03 --> 00:00:04\r\nBye"
    files = spark.createDataFrame([("a", srt)], "path string, text string")
    assert [r.original for r in sources.subtitle_cues(files).sort("cue").collect()] == ["Hello\nthere", "Bye"]
    po = spark.createDataFrame([("p", 'msgid ""\nmsgstr "head"\n\nmsgid "Go"\nmsgstr "Los"\n')], "path string, text string")
    assert [(r.msgid, r.msgstr) for r in sources.catalog_entries(po).collect()] == [("Go", "Los")]
    js = spark.createDataFrame([("j", '{"menu":{"start":"Start Game"},"hint":"Use arrows."}')], "path string, text string")
    assert {(r.key, r.original) for r in sources.flat_json(js).collect()} == {("menu.start", "Start Game"), ("hint", "Use arrows.")}


def test_budget_trim(spark):
    rows = spark.createDataFrame([("g", i, d) for i, d in enumerate([5, 50, -3, 20])], "g string, k int, d int")
    got = {r.k for r in ordered.budget_trim(rows, "g", "d", "k", 25).filter("dropped").collect()}
    assert got == {1}


def test_budget_trim_puts_one_delta_in_order(spark):
    r = random.Random(4)
    data = [(g, i, r.choice([-5, 0, 3, 7, 7, 40])) for i, g in enumerate(["hot"] * 300 + ["a"] * 20 + [None] * 9)]
    rows = spark.createDataFrame(data, "g string, k int, d int")
    want = set()
    for g in ("hot", "a", None):
        left = sum(d for h, _, d in data if h == g)
        for _, k, d in sorted((x for x in data if x[0] == g), key=lambda x: (-x[2], x[1])):
            want |= {k} if d > 0 and left > 25 else set()
            left -= d
    trimmed = ordered.budget_trim(rows, "g", "d", "k", 25)
    assert {x.k for x in trimmed.filter("dropped").collect()} == want and trimmed.count() == len(data)
    keys = re.findall(r"Window \[.*?\], \[([^\]]*)\]", trimmed._jdf.queryExecution().executedPlan().toString())
    assert keys and all("_g" in x for x in keys)  # no window over the rows of a group as they are


def test_whole_tables_are_read(spark):
    import __spark_entry__

    folder, queries = "/root/testdata/sf0.001", __spark_entry__.queries()
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    memory = {r.original for r in queries["tm_most_common_whole"](spark, folder).collect()}
    assert memory == {r.text for r in read("documents").filter("text <> ''").collect()}
    assert queries["export_overlay_whole"](spark, folder).count() == read("orders").count()
    games = {r.game for r in queries["fingerprint_verdicts_whole"](spark, folder).collect()}
    lines = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    assert games == {r.o_custkey for r in read("orders").join(lines, "o_orderkey", "left_semi").collect()}


def test_every_own_query_runs(spark):
    import __spark_entry__

    own = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]
    assert len(own) > 20
    assert __spark_entry__.entry(spark).agg(F.sum("n")).first()[0] > 0


def test_ranks_are_dense_where_ranges_are_sampled(spark):
    rows = spark.range(60_000, numPartitions=4).select("id", F.xxhash64("id").alias("k"), F.concat(F.lit("x"), "id").alias("text"))
    got = [(r.rank, r.k) for r in ordered.global_rank(rows, "k").filter("text <> ''").select("rank", "k").orderBy("rank").collect()]
    assert [n for n, _ in got] == list(range(60_000)) and got == sorted(got, key=lambda x: x[1])
    assert ordered.global_rank(rows.limit(0), "k").collect() == []
