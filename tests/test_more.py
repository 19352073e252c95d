import re

from pyspark.sql import functions as F

from loomwork.functions import outputs, placeholders
from loomwork.operators import transform, write_back
from loomwork.sources import scripts

TEXTS = ["Hi [name], {0} of %d", "[[Node|x [b]]] <<if $x > 90>> #line:1f", r"a\n\V[1] <color=#fff>red</color> [color=9]x[/color]", "", None, "plain", "【0】 {a}", r"\[wave\] \\ \: 100%%", "{{a}} {b{c}d} $v.x[1]"]


def brute(text):
    parts = []
    for p in placeholders.PATTERNS.values():
        at, out = 0, ""
        for m in re.finditer(p, text):
            whole = re.sub("【([0-9]+)】", lambda t: parts[int(t[1])] if int(t[1]) < len(parts) else t[0], m[0])
            out, at = out + text[at : m.start()] + f"【{len(parts)}】", m.end()
            parts.append(whole)
        text = out + text[at:]
    return text, parts


def test_placeholders(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "i int, x string")
    rows = placeholders.protect(df, "x").withColumn("back", placeholders.restore(F.col("protected"), F.col("parts"))).collect()
    for r in rows:
        assert (r.protected, r.parts) == brute(r.x or ""), r.x
        assert "【" in (r.x or "") or r.back == (r.x or "")
    assert [r[0] for r in df.orderBy("i").select(placeholders.has_protected(F.col("x"))).collect()] == [any(re.search(p, x or "") for p in placeholders.PATTERNS.values()) for x in TEXTS]
    moved = spark.createDataFrame([("(1) [0] 【 1 】【7】 [00]", ["a", "【0】"])], "t string, p array<string>")
    assert moved.select(placeholders.restore(F.col("t"), F.col("p"))).first()[0] == "【0】 a 【0】【7】 [00]"


def test_outputs(spark):
    one = lambda col, x, kind="string": spark.createDataFrame([(x,)], f"x {kind}").select(col(F.col("x"))).first()[0]
    cleaned = {'```json\n{"a":1}\n```': '{"a":1}', "译文：“你好“": "你好", ' "a\r\nb" ': "a\nb", "plain": "plain", None: "", '"': '"'}
    assert {k: one(outputs.clean, k) for k in cleaned} == cleaned
    names = {"homer: hi": "homer", "no name": "", r"a\: b: c": "", "Mr. X:y": "Mr. X", ": x": ""}
    assert {k: one(outputs.speaker, k) for k in names} == names
    languages = {"": "hanzi", "Japanese": "kana", "中": "hanzi", "한국어": "hangul", "Deutsch": "latin", "Klingon": "unknown"}
    assert {k: one(outputs.target_script, k) for k in languages} == languages
    fields = {"drawText": True, "_contextParam": False, "tooltip": True, "m_Name": False}
    assert {k: one(outputs.field_is_text, k) for k in fields} == fields
    assert one(outputs.parsed_map, 'so: {"0": "x", "1": "y"} done') == {"0": "x", "1": "y"} and one(outputs.parsed_map, "none") is None
    pairs = spark.createDataFrame([("ok", "Hello there"), ("好的，我将 x", "a"), ("x" * 70, "12345678"), ("x" * 70, "1234567"), (None, "a")], "v string, o string")
    assert [r[0] for r in pairs.select(outputs.leaked(F.col("v"), F.col("o"))).collect()] == [False, True, True, False, False]


def test_write_back(spark):
    files = spark.createDataFrame([("f", "\ufeffab cd ab\r\nx\n"), ("g", None)], "path string, text string")
    units = spark.createDataFrame([("f", 0, 1, "ab", "LONG"), ("f", 0, 7, "ab", "Z"), ("f", 1, 0, "y", "no"), ("f", 9, 0, "x", "no")], "path string, line int, start int, original string, target string")
    assert {r.path: (r.text, r.n_replaced) for r in write_back.lines_back(files, units).collect()} == {"f": ("\ufeffLONG cd Z\r\nx\n", 2), "g": ("", 0)}
    rows = spark.createDataFrame([("u", "f", "a", "b"), ("v", "f", "c", None)], "uid string, source_file string, original string, target string")
    package = write_back.package_lines(rows).union(spark.createDataFrame([("junk",)], "value string"))
    assert [tuple(r) for r in write_back.read_package(package).collect()] == [("u", "f", "a", "b")]
    assert tuple(write_back.manifest(rows).first()) == (2, 1, 1, "50.0%", False)
    listing = lambda rows: spark.createDataFrame(rows, "rel string, size long, mtime double")
    plan = write_back.export_plan(listing([("a", 1, 5.2), ("b", 2, 5.0)]), listing([("b", 3, 6.0), ("c", 4, 7.0)]), listing([("a", 1, 5.9), ("b", 2, 5.0)]))
    assert sorted(tuple(r) for r in plan.collect()) == [("b", 3, 6, "over"), ("c", 4, 7, "over")]
    repo = spark.createDataFrame([("p", "x", 1), ("p", "x", 2), ("p", "y", 3)], "stem string, content string, seq int")
    assert sorted(r.name for r in write_back.repository_names(repo).collect()) == ["p", "p-2"]


def test_transform(spark):
    def call(xs):
        if len(xs) > 1 and any("bad" in x for x in xs):
            raise ValueError
        return [x.replace("Potion", "药水") if "bad" not in x else "" for x in xs]

    units = spark.createDataFrame([(1, "Potion {0}"), (2, "Potion {0}"), (3, "bad"), (4, "你好"), (5, None)], "uid int, original string")
    got = {r.uid: (r.target, r.how) for r in transform.transform(units, call).collect()}
    assert got == {1: ("药水 {0}", "done"), 2: ("药水 {0}", "done"), 3: ("", "empty"), 4: (None, "skipped"), 5: (None, "skipped")}


def test_scripts(spark):
    one = lambda text: spark.createDataFrame([("f", text)], "path string, text string")
    play = 'define e = Character("Ellen")\n# "no"\nmenu:\n  "Go":\n e "Say \\"hi\\""\n"Night fell."\n$ x = 1\nshow "x"\n"..."'
    assert [(r.line, r.form, r.speaker, r.original) for r in scripts.dialogue_lines(one(play)).sort("line").collect()] == [(1, "name", None, "Ellen"), (4, "option", None, "Go"), (5, "spoken", "e", 'Say "hi"'), (6, "narration", None, "Night fell."), (8, "spoken", "show", "x")]
    assert [(r.start, r.original) for r in scripts.styled_cues(one("Dialogue: 0,1,2,D,n,0,0,0,,{\\an8}Hi, you\nComment: x")).collect()] == [(len("Dialogue: 0,1,2,D,n,0,0,0,,{.an8}"), "Hi, you")]
    assert [(r.key, r.original) for r in scripts.key_values(one('a: "Hi"\nb: |\nc: null\nd: 12\n  e: Yo: u')).sort("line").collect()] == [("a", "Hi"), ("e", "Yo: u")]
    kag = '[name="Ann"]\nHello [pc][r]\n;no\n[iscript]\nvar x\n[endscript]\n*label\nBye [wait time=3]now'
    assert [(r.speaker, r.original) for r in scripts.tagged_lines(one(kag)).sort("line").collect()] == [("Ann", "Hello [pc]"), ("Ann", "Bye now")]
    listing = [("a", "x.xp3", 1), ("b", "www/data/System.json", 1), ("c", "game/s.rpyc", 1), ("d", "D_Data/x", 1), ("e", "E.exe", 1), ("e", "1.txt", 500), ("e", "2.txt", 500), ("e", "t/3.txt", 500), ("f", "y", 1)]
    files = spark.createDataFrame(listing, "root string, rel string, size long")
    assert {r.root: r.engine for r in scripts.engines(files).collect()} == {"a": "kirikiri", "b": "rpgmaker_mv", "c": "renpy", "d": "unity", "e": "plaintext", "f": "unknown"}
    assert scripts.listed(files, 0).count() == 5 and scripts.listed(files, suffixes=[".txt"]).count() == 3
