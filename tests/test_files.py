"""Formats, game data and package verdicts: edges that the registered queries' tables don't hold."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import audit, projects, reconcile, terms
from loomwork.sources import files as formats
from loomwork.sources import game_data


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_reading_keeps_what_bytes_say(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfHello\r\nyou\r\n")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.txt").write_bytes(b"")
    out = {r.path[-5:]: r for r in formats.read_files(spark, f"file://{tmp_path}/*.txt").collect()}
    assert (out["a.txt"].text, out["a.txt"].bom, out["a.txt"].newline, out["a.txt"].trailing) == ("Hello\r\nyou\r\n", True, "\r\n", True)
    assert out["b.txt"].text is None and "c.txt" not in out


def test_formats_by_name(spark):
    names = ["x/README.TXT", "a.min.json", "a.JSON", "b.tsv", "c.exe", "noending", "d.ssa", "e.yml", None]
    got = [r.f for r in frame(spark, [(n, "") for n in names]).select(formats.form(F.col("path")).alias("f")).collect()]
    assert got == [None, None, "json", "csv", None, None, "ass", "yaml", None]


def test_bad_files_stop_no_other(spark):
    files = frame(spark, [("a.json", "{"), ("b.json", None), ("c.json", '["x", {"k": ["y", 1, null, ""]}]'), ("d.json", '"top"'), ("e.csv", None), ("f.json", "[" * 100_000)])
    assert sorted((r.path, tuple(r.key), r.original) for r in formats.tree_units(files).collect()) == [("c.json", ("0",), "x"), ("c.json", ("1", "k", "0"), "y"), ("d.json", (), "top")]
    assert formats.cell_units(files).count() == 0 and formats.line_units(files).count() == 0


def test_write_back_round_trip(spark):
    files = frame(spark, [("a.txt", "one\r\n  two {n} \r\n"), ("b.csv", 'a,"b ""q"""\n1,c\n'), ("c.json", '{\n  "k": [\n    "x",\n    {\n      "y": "z"\n    }\n  ]\n}'), ("d.txt", "12\n"), ("e.srt", "1\n00:00:01,000 --> 00:00:02,000\nHi\n")])
    units = formats.file_units(files).withColumn("target", F.col("protected_form"))
    out = {r.path: r for r in formats.write_back(files, units).collect()}
    assert {p: out[p].text for p in out} == {r.path: r.text for r in files.collect()}
    assert {p: out[p].n_replaced for p in out} == {"a.txt": 2, "b.csv": 3, "c.json": 2, "d.txt": 0, "e.srt": 1} and not any(r.changed for r in out.values())
    moved = files.withColumn("text", F.concat(F.lit("new\n"), "text"))
    assert {r.path: r.n_replaced for r in formats.write_back(moved, units.filter("form = 'line'")).collect()}["a.txt"] == 0


def test_unit_ids_are_those_of_the_place(spark):
    import hashlib
    import json

    rows = formats.file_units(frame(spark, [("a.txt", "x\n Hello\n"), ("b.json", '{"a\\"b": ["t"]}')])).collect()
    places = {"Hello": ("a.txt", {"form": "line", "line": 2, "span": [1, 6]}), "t": ("b.json", {"form": "json", "key_path": ['a"b', 0]}), "x": ("a.txt", {"form": "line", "line": 1, "span": [0, 1]})}
    for r in rows:
        file, place = places[r.original]
        assert r.uid == hashlib.sha1(f"{file}|{json.dumps(place, sort_keys=True, ensure_ascii=False)}|{r.original}".encode()).hexdigest()[:16]
    assert len(rows) == 3


def test_event_commands(spark):
    import json

    commands = [{"code": 401, "parameters": ["only"]}, {"code": 401, "parameters": []}, {"code": 405, "parameters": ["more"]}, {"code": 102, "parameters": [["Yes", "", "No"], 1]}, {"code": 402, "parameters": [0, "Yes"]}, {"code": 1, "parameters": [{"code": 401, "parameters": ["Ann", "deep"]}]}]
    files = frame(spark, [("data/CommonEvents.json", json.dumps([None, {"list": commands}])), ("data/MapInfos.json", '[{"name": "no"}]'), ("data/System.json", json.dumps({"gameTitle": "T", "elements": ["", "Fire"], "terms": {"basic": ["Level"]}})), ("data/Map1.json", "{")])
    out = [("/".join(r.place), r.kind, r.speaker, r.original) for r in game_data.data_units(files).orderBy("path", "ord").collect()]
    assert out == [
        ("1/list/0/401", "dialogue", None, "only"), ("1/list/3/102/0", "ui", None, "Yes"), ("1/list/3/102/2", "ui", None, "No"), ("1/list/4/402", "ui", None, "Yes"),
        ("1/list/5/parameters/0/401", "dialogue", "Ann", "deep"), ("1/list/5/parameters/0/401/speaker", "name", None, "Ann"),
        ("terms/basic/0", "ui", None, "Level"), ("elements/1", "name", None, "Fire"), ("gameTitle", "ui", None, "T"),
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("title: a\n---\nMae: hi // x\n===\nMae: head\n", [(3, "line", "Mae: hi", "Mae", "hi")]),
        ("Title: a\nMae: C# is http://x great\n", [(2, "line", "Mae: C# is http://x great", "Mae", "C# is http://x great")]),
        ("---\n  => Bob:  yo <<if $x >= 2>> #a #b\n<wait 3>> #line:1\n[[Next]]\n", [(2, "group", "Bob:  yo", "Bob", "yo"), (4, "line", "[[Next]]", "", "[[Next]]")]),
        ("---\n[[ so [wave]x[/wave] |To]]\na\\: b: c\n<<a>> // no\n", [(2, "bracket", "so [wave]x[/wave]", "", "so [wave]x[/wave]"), (3, "line", "a\\: b: c", "", "a\\: b: c")]),
    ],
)
def test_dialogue_statements(spark, text, want):
    rows = game_data.dialogue_statements(frame(spark, [("f", text)])).orderBy("line").collect()
    assert [(r.line, r.form, r.original, r.speaker, r.body) for r in rows] == want
    for r in rows:
        assert text.split("\n")[r.line - 1][r.start : r.start + len(r.original)] == r.original


def test_settings_and_literals(spark):
    text = '﻿// x\nvar $plugins = [\n{"name": "P", "parameters": {"a": "[{\\"b\\": \\"表示する\\"}]", "c": {"遅い": -2}, "d": "true", "e": "あ"}}];\n'
    out = [("/".join(r.place), r.original, r.as_key) for r in game_data.plugin_settings(frame(spark, [("js/plugins.js", text), ("b", "var x = 1;")])).collect()]
    assert sorted(out) == [("P/a/0/b", "表示する", False), ("P/c/遅い", "遅い", True)]
    said = "f('クエスト確認', \"img/a.png\", 'あ', 'it\\'s 設定');\n'open 設\n定'"
    assert [(r.start, r.original) for r in game_data.script_literals(frame(spark, [("p.js", said)])).collect()] == [(3, "クエスト確認"), (31, "it\\'s 設定")]


def test_scored_terms(spark):
    said = ["Mira went to the Amber Fox inn.", "Then Mira met Tobin at the Amber Fox inn.", "Tobin said the Amber Fox was loud.", "I'm here, said Mira.", "It's fine, Tobin said, It's fine.", "we saw NodeFadeAction and NodeFadeAction", "a plum and PLUM", "the Plum and PLUM and Plum", "霧の森へ", "霧の森で", "Grape is red.", "Grape is round.", "", " "]
    units = spark.createDataFrame(list(enumerate(said)), "i int, original string")
    out = {r.term: (r.n, round(r.score, 3)) for r in terms.scored(units, ["i"]).collect()}
    assert out["Mira"] == (3, 7.2) and out["Amber Fox"][0] == 3 and out["Tobin"][0] == 3
    assert out["Plum"][0] == 4 and "PLUM" not in out and "霧の" in out and "霧の森" in out
    assert not {"It's", "I'm", "NodeFadeAction", "Grape", "Then Mira"} & set(out)
    assert terms.scored(units.limit(0), ["i"]).count() == 0


def test_many_terms_meet_texts_by_their_beginnings(spark, monkeypatch):
    units = spark.createDataFrame([("u1", "a long tale"), ("u2", "tal"), ("u3", ""), ("u4", None)], "uid string, original string")
    glossary = spark.createDataFrame([(0, "tale", "x"), (1, "ta", "y"), (2, "a", "z"), (3, "tall", "w")], "ord int, term string, want string")
    few = sorted((r.uid, r.term) for r in terms.matching(units, glossary, "original").collect())
    monkeypatch.setattr(terms, "FEW", 1)
    assert few == sorted((r.uid, r.term) for r in terms.matching(units, glossary, "original").collect())
    assert few == [("u1", "a"), ("u1", "ta"), ("u1", "tale"), ("u2", "a"), ("u2", "ta")]


def test_audit_takes_the_protected_form(spark):
    units = spark.createDataFrame([("a", "[x] go", "【0】 go", "【0】 geh"), ("b", "[x] go", "【0】 go", "geh nun"), ("c", "[x] go", None, "geh"), ("d", "x", "", None)], "uid string, original string, protected_form string, target string")
    none = spark.createDataFrame([], "ord int, term string, want string")
    assert sorted((r.uid, r.code, r.level) for r in audit.described(audit.issues(units, none)).collect()) == [("b", "placeholder", "warn"), ("d", "empty", "warn")]


def test_package_choice_and_gate(spark):
    names = "exe array<string>, data_dirs array<string>, packs array<string>, dirs array<string>"
    games = spark.createDataFrame([("g1", ["A.exe"], ["A_Data"], [], None), ("g2", [], None, [], [])], f"game string, {names}")
    packages = spark.createDataFrame([("p1", ["a.EXE"], ["B_Data"], [], [], 1, None), ("p2", ["A.exe"], [], ["x"], [], 0, ""), ("p3", ["z.exe"], [], [], [], 9, None), ("p4", ["A.exe"], ["A_Data"], [], [], 9, "broken")], f"package string, {names}, created int, error string")
    best = reconcile.best_packages(games, packages)
    assert sorted(map(tuple, best.collect())) == [("g1", "p2", "match"), ("g2", "p3", "unknown")]
    assert [r.game for r in reconcile.default_picks(best).collect()] == ["g1"]
    how = spark.createDataFrame([("uid",)] + [("missed",)] * 99, "how string")
    assert reconcile.match_gate(how).first().fits and not reconcile.match_gate(how.filter("how = 'missed'")).first().fits


def test_replies_and_reviews(spark):
    said = ["[1,2,3]", "[]", "```json\n[2]\n```", '{"problems":[4,5]}', '{"1":true,"2":false,"5":true}', "the bad ones are [3] here", "all is well", "", None, '["7", "x", 8]']
    got = [r.f for r in spark.createDataFrame([(x,) for x in said], "x string").select(projects.flags(F.col("x")).alias("f")).collect()]
    assert got == [[1, 2, 3], [], [2], [4, 5], [1, 5], [3], None, None, None, [7, 8]]
    units = spark.createDataFrame([(f"u{i:02}", f"src{i}", "bad" if i % 7 == 0 else "good") for i in range(50)], "uid string, original string, target string")

    def call(items):
        if items[0][1] == "src40":
            raise OSError
        return str([i for i, _, dst in items if dst == "bad"])

    out = {r.uid: (r.code, r.failed) for r in projects.review(units, call, "uid", rate=1.0, size=20).collect()}
    assert out == {f"u{i:02}": (None, True) if i >= 40 else ("model_flag" if i % 7 == 0 else None, False) for i in range(50)}
    assert projects.review(units, call, "uid", rate=0.1).count() == 5


def test_change_log_files(spark, tmp_path):
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    entries = lambda rows: spark.createDataFrame(rows, "uid string, t string, uv int")
    assert projects.append(entries([]), log) == 0
    assert projects.append(entries([("u0", "a", 0), ("u2", "c", 1), ("u3", None, 0)]), log) == 2
    (tmp_path / "log" / "dirty.txt").write_text("not json\n")
    assert projects.append(entries([("u0", "new", 0), ("nobody", "x", 0)]), log) == 2
    units = spark.createDataFrame([(f"u{i}", None) for i in range(4)], "uid string, target string")
    got = {r.uid: (r.target, r.unverified) for r in projects.compact(spark, units, log, out).select("uid", "target", "unverified").collect()}
    assert got == {"u0": ("new", False), "u1": (None, False), "u2": ("c", True), "u3": (None, False)}
    assert not (tmp_path / "log").exists()


def test_counts_of_projects(spark):
    units = spark.createDataFrame([("a", "x", "name", True), ("bb", None, None, True), ("c", "", "name", None)], "original string, target string, kind string, unverified boolean")
    r = projects.stats(units).first()
    assert (r.total, r.filled, r.progress, r.chars, r.kinds) == (3, 1, "33.3%", 4, {"name": 2, "other": 1})
    assert tuple(projects.stats(units.limit(0)).first())[:3] == (0, 0, "0%") and projects.unverified(units).count() == 1
    assert projects.batch_size(units) == 1 and projects.open_examples(units, "original", 1).first().original == "bb"
    got = units.limit(1).select(projects.token_difference(F.lit("【0】【1】【1】"), F.lit("【1】【2】")).alias("d")).first().d
    assert (got.missing, got.extra) == (["0"], ["2"])


def test_game_data_back(spark):
    import json

    events = '{"b": 1e5, "events": [null, {"pages": [{"list": [{"code": 401, "parameters": ["Bo", "Hi"]}, {"code": 401, "parameters": ["Alone"]}, {"code": 102, "parameters": [["yes", "no", "yes"], 1]}, {"code": 402, "parameters": [0, "yes"]}, {"code": 101, "parameters": ["face"]}]}]}], "b": 2.50}'
    items = '[null,\n  {"id": 1, "name": "Rope", "note": "Rope", "terms": {"basic": ["Lv", "\\u00e9"], "messages": {"hit": "%1 hit"}}}]'
    nested = json.dumps({"遅い": -2, "k": json.dumps(["表示する", "a"], ensure_ascii=False)}, ensure_ascii=False)
    plugins = f'// x\nvar $plugins =\n[{{"name":"P","status":true,"parameters":{{"a":{json.dumps(nested, ensure_ascii=False)},"b":"設定","n":"1e5"}}}}];\n'
    files = frame(spark, [("data/Map1.json", events), ("data/Items.json", items), ("js/plugins.js", plugins), ("data/Bad.json", "{"), ("data/Null.json", None), ("data/MapInfos.json", '[{"name": "no"}]')])
    data = game_data.data_units(files).select("path", "place", "original", F.lit(False).alias("as_key"))
    units = data.union(game_data.plugin_settings(files.filter("path like '%.js'")).select("path", "place", "original", "as_key"))
    rows = {r.path: r for r in game_data.data_back(files, units.withColumn("target", F.concat("original", F.lit('"\n')))).collect()}
    want = events
    for old in ("Bo", "Hi", "Alone", "yes", "no"):
        want = want.replace(f'"{old}"', json.dumps(old + '"\n'))
    assert (rows["data/Map1.json"].text, rows["data/Map1.json"].n_replaced) == (want, 7)
    assert json.loads(rows["data/Items.json"].text)[1] == {"id": 1, "name": 'Rope"\n', "note": "Rope", "terms": {"basic": ['Lv"\n', 'é"\n'], "messages": {"hit": '%1 hit"\n'}}}
    new = rows["js/plugins.js"].text
    assert new.startswith("// x\nvar $plugins =\n[") and new.endswith("];\n") and rows["js/plugins.js"].n_replaced == 3
    given = json.loads(new[new.index("[") : -2])[0]["parameters"]
    inner = json.loads(given["a"])
    assert (given["b"], given["n"], inner['遅い"\n'], json.loads(inner["k"])) == ('設定"\n', "1e5", -2, ['表示する"\n', "a"])
    assert {p: (r.text, r.n_replaced, r.changed) for p, r in rows.items() if p in ("data/Bad.json", "data/Null.json")} == {"data/Bad.json": ("{", 0, False), "data/Null.json": (None, 0, False)}
    same = {r.path: (r.n_replaced, r.changed) for r in game_data.data_back(files, units.withColumn("target", F.col("original"))).collect()}
    assert same["data/Map1.json"] == (7, False) and same["js/plugins.js"][1] is False
    moved = game_data.data_back(files, units.withColumn("original", F.lit("other")).withColumn("target", F.lit("x"))).collect()
    assert not any(r.changed or r.n_replaced for r in moved)


def test_event_write_back_query(spark):
    from .test_engines import agrees

    agrees(spark, "event_write_back")


def test_rows_are_dealt_out_before_they_make_files(spark):
    from loomwork.plans import files as plans

    few = spark.range(40).coalesce(1).select(F.col("id").alias("k"), F.lit("a").alias("p_name"))
    made = plans._files(few, {".txt": F.col("p_name"), ".md": F.col("p_name")})
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 80
    assert made.select(F.spark_partition_id()).distinct().count() > 4
