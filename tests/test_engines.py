"""Plug-ins in SQL, listings and the file sink."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomwork import registry
from loomwork.plans import engines
from loomwork.operators import reconcile
from loomwork.sources import listing, plugins, sink
from loomwork.streaming import store

SF = "/root/testdata/sf0.001"


def agrees(spark, name):
    """The query gives the rows of its SQL."""
    out = registry.QUERIES[name](spark, SF)
    with duckdb.connect() as c:
        for t in os.listdir(SF):
            c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
        found = c.sql(registry.ORACLE[name])
        rows = found.fetchall()
        names = found.columns
    mine = out.select(*names).collect()
    assert sorted(out.columns) == sorted(names) and rows
    assert sorted(map(tuple, mine), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", ["plugin_nodes", "plugin_paragraphs", "plugin_put_back", "folder_listing", "file_sink", "journal_store"])
def test_queries(spark, name):
    assert name in __spark_entry__.queries()
    agrees(spark, name)


class Vowels(plugins.Extractor):
    schema, by, order = "key string, n long", ("key",), ("text",)

    def __init__(self):
        self.key, self.n = None, 0

    def row(self, row):
        self.key, self.n = row["key"], self.n + sum(c in "aeiou" for c in row["text"] or "")
        yield from ()

    def end(self):
        yield self.key, self.n


def test_plugins(spark):
    plugins.install(spark, {"vowels": Vowels})
    spark.createDataFrame([("a", "one two"), ("b", None), ("a", "three"), (None, "iii")], "key string, text string").createOrReplaceTempView("plug")
    assert sorted(map(tuple, spark.sql("SELECT * FROM extract('vowels', TABLE(plug))").collect()), key=str) == [("a", 5), ("b", 0), (None, 3)]
    assert spark.sql("SELECT * FROM extract('lines', TABLE(SELECT * FROM plug WHERE key = 'none'))").collect() == []
    for bad in ("extract('nothing', TABLE(plug))", "extract('paragraphs', TABLE(plug))", "put_back('lines', TABLE(plug))"):
        with pytest.raises(Exception, match="no extractor|needs the columns"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    spark.createDataFrame([("k", " a\n12\n b a \n", [(1, "b a", "X"), (0, "other", "no"), (9, "a", "no"), (0, "a", None)]), ("e", None, None)], "key string, text string, edits array<struct<ord: int, original: string, target: string>>").createOrReplaceTempView("plugged")
    assert [tuple(r) for r in spark.sql("SELECT * FROM put_back('lines', TABLE(plugged))").collect()] == [("k", " a\n12\n X \n", 1), ("e", "", 0)]


def made_tree(root, rels):
    for rel in rels:
        os.makedirs(os.path.dirname(f"{root}/{rel}"), exist_ok=True)
        with open(f"{root}/{rel}", "w", encoding="utf-8") as f:
            f.write(rel)


def test_listing(spark, tmp_path):
    rels = ["b.txt", "a.TXT", "x.bak", "d/c.json", "d/e/f.txt", "d/e/g/h.txt", ".git/no", "_hanhua_x/no", "my_汉化补丁包/no", "z/.old", "z/noending"]
    made_tree(tmp_path / "one", rels)
    os.symlink(tmp_path / "one", tmp_path / "one" / "loop")
    (tmp_path / "two").mkdir()
    roots = spark.createDataFrame([(str(tmp_path / n),) for n in ("one", "two", "missing", "one")] + [(None,)], "root string")

    def plain(root, depth):
        out, level = [], [""]
        for d in range(depth + 1):
            deeper = []
            for folder in sorted(level):
                for e in sorted(os.scandir(f"{root}/{folder}"), key=lambda e: e.name):
                    rel = f"{folder}/{e.name}".lstrip("/")
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in listing.SKIPPED_FOLDERS and not e.name.startswith("_hanhua") and not e.name.endswith("_汉化补丁包"):
                            deeper.append(rel)
                    elif e.is_file(follow_symlinks=False) and not e.name.endswith(".bak"):
                        out.append((rel, d))
            level = deeper
        return out

    for depth in (0, 1, 2, 4):
        files, stats = listing.listing(roots, depth=depth)
        found = [(r.rel, r.depth) for r in files.orderBy("nth").collect() if r.root.endswith("one")]
        assert found == plain(str(tmp_path / "one"), depth)
        assert {(r.root.rsplit("/", 1)[1], r.files, r.truncated, r.reason) for r in stats.collect()} == {("one", len(found), False, ""), ("two", 0, False, ""), ("missing", 0, False, "")}
    files, stats = listing.listing(roots, most=3)
    assert [r.rel for r in files.orderBy("nth").collect()] == [r for r, _ in plain(str(tmp_path / "one"), 4)[:3]]
    assert {r.reason for r in stats.collect() if r.root.endswith("one")} == {"files"}
    files, stats = listing.listing(roots, seconds=-1)
    assert files.count() == 0 and {r.reason for r in stats.collect()} == {"seconds"}
    files, _ = listing.listing(roots)
    assert {r.rel for r in listing.of_suffix(files, [".TXT"]).collect()} == {"b.txt", "a.TXT", "d/e/f.txt", "d/e/g/h.txt"}
    assert {(r.suffix, r.rel) for r in listing.first_of_suffix(files).collect()} == {(".txt", "a.TXT"), (".json", "d/c.json")}
    assert [r.rel for r in listing.candidates(files, [".txt", ".json"], ["b.txt"], ["f.txt"], most=2).orderBy("nth").collect()] == ["a.TXT", "d/c.json"]
    assert {r.rel for r in listing.candidates(files, [".txt"], [], [], largest=8).collect()} == {"b.txt", "a.TXT"}


def test_sink(spark, tmp_path):
    dest, source = str(tmp_path / "out"), str(tmp_path / "in")
    made_tree(source, ["a/b.txt", "c.txt"])
    rows = [("a/b.txt", "a/b.txt"), ("c.txt", "new"), ("d.txt", None), ("é/漢.txt", "x" * 100_000)]
    df = spark.createDataFrame(rows, "rel string, data string").repartition(3)
    first = {r.rel: (r.written, r.changed) for r in sink.write_files(df, dest, source).collect()}
    assert first == {"a/b.txt": (True, False), "c.txt": (True, True), "d.txt": (True, True), "é/漢.txt": (True, True)}
    assert {rel: open(f"{dest}/{rel}", encoding="utf-8").read() for rel, _ in rows} == {rel: t or "" for rel, t in rows}
    times = {rel: os.stat(f"{dest}/{rel}").st_mtime_ns for rel, _ in rows}
    time.sleep(0.02)
    again = sink.write_files(df.select(F.lit(1).alias("rel2"), "data", "rel"), dest, source)
    assert not any(r.written for r in again.collect()) and tuple(sink.sink_stats(again).first()) == (4, 0, 1, 3)
    assert {rel: os.stat(f"{dest}/{rel}").st_mtime_ns for rel, _ in rows} == times
    assert sink.write_files(df.limit(0), dest).count() == 0
    # A task that fails after it has written, two rows of a path, and paths that leave the folder: nothing is moved or left.
    late = spark.range(0, 50, 1, 4).select(F.concat(F.lit("n/"), "id").alias("rel"), F.when(F.col("id") == 49, F.raise_error(F.lit("killed"))).otherwise(F.lit("half")).alias("data"))
    for bad in (late, df.union(df), *[spark.createDataFrame([("ok", "x"), (p, "x")], "rel string, data string") for p in ("../x", "/x", "a//b", "")]):
        with pytest.raises(Exception, match="killed|two rows|not a path"):
            sink.write_files(bad, dest)
        assert not os.path.exists(f"{dest}/n") and not os.path.exists(f"{dest}/ok")
    assert {rel: os.stat(f"{dest}/{rel}").st_mtime_ns for rel, _ in rows} == times


def test_part_files_are_whole(spark):
    files = engines._part_files(spark, SF)
    assert files.select(F.sum(F.size(F.split("data", "\n")))).first()[0] == spark.read.parquet(f"{SF}/part.parquet").count()


ENTRIES = "uid string, t string, uv int"


def test_log(spark, tmp_path):
    log = store.Log(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0 and log.append(spark.createDataFrame([], ENTRIES)) == 0
    # Of two partitions the later row counts, though its task may end first.
    rows = spark.range(0, 2000, 1, 2).select(F.lit("u").alias("uid"), F.col("id").cast("string").alias("t"), F.lit(0).alias("uv"))
    slow = rows.withColumn("t", F.when((F.col("t") < 1000) & F.expr("reflect('java.lang.Thread', 'sleep', 1L) is not null"), F.col("t")).otherwise(F.col("t")))
    assert log.append(slow) == 2000
    assert [tuple(r) for r in reconcile.latest(log.read()).collect()] == [("u", "1999", 0)]
    assert log.append(spark.createDataFrame([("u", "z", 1), ("v", None, 0), (None, "x", 0), ("w", "", 0)], ENTRIES)) == 2
    assert sorted(map(tuple, reconcile.latest(log.read()).collect())) == [("u", "z", 1), ("w", "", 0)]
    (tmp_path / "log/batch=9").mkdir()  # of a job that hasn't ended
    (tmp_path / "log/batch=9/part-0.json").write_text('{"uid": "u", "t": "half"}')
    (tmp_path / "log/batch=2/dirty.json").write_text("not json\n{}\n[1]\n")
    assert sorted(map(tuple, reconcile.latest(log.read()).collect())) == [("u", "z", 1), ("w", "", 0)]
    one = spark.createDataFrame([("n", "1", 0)], ENTRIES)
    assert (log.append(one, "named"), log.append(one, "named")) == (1, -1) and log.done() == [1, 2, 3, 4]


def test_project(spark, tmp_path):
    project = store.Project(spark, f"file://{tmp_path}/p")
    assert project.meta() == {} and project.versions() == []
    with pytest.raises(FileNotFoundError):
        project.load()
    units = spark.createDataFrame([(f"u{i}", None, None, 1) for i in range(4)], "uid string, target string, note string, n int").withColumn("d", F.lit("2020-01-01").cast("date")).withColumn("tags", F.array(F.lit("a")))
    project.save(units, {"name": "é"})
    add = lambda *rows: project.log.append(spark.createDataFrame(list(rows), ENTRIES))
    add(("u0", "a", 0), ("u1", "b", 1), ("nobody", "x", 0))
    found = lambda: {r.uid: (r.target, r.unverified) for r in project.load().collect()}
    want = {"u0": ("a", False), "u1": ("b", True), "u2": (None, False), "u3": (None, False)}
    assert found() == want and not project.finish()
    assert project.compact({"more": 1}) == 2
    assert found() == want and project.meta() == {"name": "é", "more": 1} and project.log.done() == []
    assert dict(units.dtypes).items() <= dict(project.load().dtypes).items()
    # A compaction that broke off: its batches are still there, the version is finished or isn't.
    add(("u1", "c", 0), ("u2", "d", 0))
    want |= {"u1": ("c", False), "u2": ("d", False)}
    read = project.log.done()
    project.save(project.load(), holds=read)
    add(("u2", "e", 0))
    want["u2"] = ("e", False)
    assert found() == want and len(project.log.done()) == 2
    (tmp_path / "p/v=9/units").mkdir(parents=True)
    assert found() == want
    project.compact()
    add(("u3", "f", 1))
    assert found() == want | {"u3": ("f", True)} and project.finish()
    assert project.meta() == {"name": "é", "more": 1, "units": 4, "filled": 4, "unverified": 1, "finished": True}


def test_stream_into_project(spark, tmp_path):
    project = store.Project(spark, f"file://{tmp_path}/p")
    project.save(spark.createDataFrame([(f"u{i}", None) for i in range(5)], "uid string, target string"))
    came = tmp_path / "in"

    def add(n, rows):
        spark.createDataFrame(rows, ENTRIES).coalesce(1).write.mode("append").json(f"file://{came}")
        time.sleep(0.05)

    def run(fails=None):
        class Breaking(store.Log):
            def append(self, entries, name=None, order=None):
                n = super().append(entries, name, order)
                if name == fails:
                    raise RuntimeError("after the batch, before the stream's own commit")
                return n

        stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).json(f"file://{came}")
        store.into(stream, Breaking(spark, project.log.path), "s", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    for n in range(4):
        add(n, [("u0", f"a{n}", 0), (f"u{n + 1}", f"b{n}", n % 2)])
    with pytest.raises(Exception, match="before the stream"):
        run(fails="s-1")
    assert len(project.log.done()) == 2
    project.compact()
    run()
    assert len(project.log.done()) == 2  # the batch that had been written wasn't again
    assert {r.uid: (r.target, r.unverified) for r in project.load().collect()} == {"u0": ("a3", False), "u1": ("b0", False), "u2": ("b1", True), "u3": ("b2", False), "u4": ("b3", True)}
    run()
    assert len(project.log.done()) == 2
