"""Language tables, string tables with budgets and claims, encodings: against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.operators import batches, reconcile, splice
from loomwork.sources import encodings, language_tables, string_tables

from .test_engines import agrees


@pytest.mark.parametrize("name", ["language_table_units", "string_table_entries", "string_table_refill", "claimed_tables", "encodings_by_trial", "language_gates", "spliced_dialogues", "keyed_batches", "packages_ranked"])
def test_queries(spark, name):
    agrees(spark, name)


# Language tables


def plain_tables(node, place=()):
    if isinstance(node, dict):
        whole = isinstance(node.get("mTerms"), list) and node["mTerms"] and "mLanguages" in node
        if whole:
            yield place, node
        for k, v in node.items():
            if not (whole and k == "mTerms"):
                yield from plain_tables(v, (*place, k))
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from plain_tables(v, (*place, str(i)))


def plain_language_units(text):
    try:
        tree = json.loads(text or "")
    except ValueError:
        return
    for place, t in plain_tables(tree):
        languages = t["mLanguages"] if isinstance(t["mLanguages"], list) else []
        real = [(i, x["Code"].strip()) for i, x in enumerate(languages) if isinstance(x, dict) and isinstance(x.get("Code"), str) and x["Code"].strip()]
        real = [i for i, c in real if c.lower().startswith("en")] + [i for i, _ in real]
        for n, term in enumerate(t["mTerms"]):
            texts = term.get("Languages") if isinstance(term, dict) else None
            if real and isinstance(texts, list) and real[0] < len(texts) and isinstance(texts[real[0]], str):
                said = texts[real[0]].strip()
                if 0 < len(said) <= 1000 and any(map(str.isalpha, said)) and "://" not in said and not (said.startswith("{") and said.endswith("}")):
                    yield (*place, "mTerms", str(n), "Languages", str(real[0])), said


def test_language_tables(spark):
    said = lambda *x: {"Languages": list(x), "Term": "t"}
    codes = lambda *x: [{"Code": c} for c in x]
    whole = {"mLanguages": codes("", "fr", "EN-gb"), "mTerms": [said("a", "b", " see "), said("a"), said("x", "y", "{z}"), said("x", "y", 5), said("x", "y", None), "no", {"x": 1}, said("", "", "1 2"), said("", "", "http://x"), said("", "", "w" * 1001)]}
    trees = [
        whole, {"a": [{"b": whole}, whole], "mTerms": [], "mLanguages": []}, {"mTerms": [said("deep")], "mLanguages": codes("de"), "inner": whole}, {"mTerms": [whole], "mLanguages": codes("", " ")},
        {"mTerms": [said("x")], "mLanguages": [7, {"Code": " de "}, None]}, {"mTerms": [said("x")], "mLanguages": {}}, {"mTerms": [said("x")], "mLanguages": None}, {"mTerms": {"a": 1}, "mLanguages": codes("en")}, {"mTerms": [said("x")]}, [[[[whole]]]], "mTerms", 5, None,
    ]
    texts = [json.dumps(t) for t in trees] + ["not json mTerms", "", None]
    rows = [(str(i), t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, text string, node string, place int")
    got = sorted((r.path, tuple(r.place), r.original) for r in language_tables.language_units(df).collect())
    assert got == sorted((i, p, t) for i, text, *_ in rows for p, t in plain_language_units(text)) and len(got) > 5
    assert language_tables.language_units(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="more than 2 levels"):
        language_tables.tables(df, most_depth=2).collect()


# String tables


def plain_entries(s):
    """A reader of one character after the other."""
    out, at = [], 0
    while head := re.compile(r"([A-Za-z0-9_]+)=LineCodeData\{").search(s, at):
        at = head.end()
        mark = s.find("Text=", at)
        if mark < 0 or mark - at > 80:
            continue
        a = b = mark + 5
        if s[a : a + 1] == '"':
            b, quoted = a + 1, True
            while b < len(s) and quoted:
                if s[b] == "\\":
                    b += 1
                elif s[b] == '"':
                    quoted = False
                b += 1
            b = min(b, len(s))
        else:
            while b < len(s) and s[b] != ";":
                b += 1
        who, c = "", s.find("Character=", b)
        if 0 <= c - b < 80 and s.find(";", c) > 0:
            who = s[c + 10 : s.find(";", c + 10)].strip().strip('"')
        raw, value, i = s[a:b], "", 0
        inner = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] == '"' else raw
        while i < len(inner):
            pair = inner[i : i + 2]
            known = {"\\n": "\n", "\\r": "\r", "\\t": "\t", '\\"': '"', "\\\\": "\\", "\\'": "'"}
            if len(pair) == 2 and pair[0] == "\\":
                value, i = value + known.get(pair, pair), i + 2
            else:
                value, i = value + inner[i], i + 1
        out.append((len(out), head[1], raw, value, who, a, b))
        at = b
    return out


def made_tables(n=250):
    r = random.Random(9)
    bits = ["K1=LineCodeData{", "b_2=LineCodeData{", "Text=", "Text=", ";", ";", '"', "\\", '\\"', "\\\\", "\\n", "word", "é漢", "}", "\n", "Character=", " Al ", '"Bo"', "x" * 81, "ID=3;", "[", "'"]
    return ["StringTable{" + "".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_entries(spark):
    texts = [*made_tables(), "  StringTable{A=LineCodeData{Text=a;}}", 'StringTable{A=LineCodeData{Text="' + "long \\n" * 40_000 + '";}', "StringTable{A=LineCodeData{Text=" + "y" * 300_000, "none A=LineCodeData{Text=a;}", "", None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "path int, text string, n int")
    got = {}
    for r in string_tables.entries(df).collect():
        got.setdefault(r.key, []).append((r.n, r.name, r.raw, r.value, r.speaker, r.start, r.end))
    want = {i: plain_entries(t) for i, t in enumerate(texts) if (t or "").strip().startswith("StringTable{") and plain_entries(t)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 100
    assert string_tables.entries(df.limit(0)).collect() == []


def plain_refill(text, targets, budget):
    found = plain_entries(text)
    last = {name: i for i, name, *_ in found}
    new = {}
    for name, (original, target) in targets.items():
        i = last.get(name)
        if i is not None and found[i][3] == original:
            for sign in "{}[]":
                for _ in range(max(0, target.count(sign) - original.count(sign))):
                    cut = target.rfind(sign)
                    target = target[:cut] + target[cut + 1 :]
            if target != original:
                new[i] = target

    def written(i, t):
        raw = found[i][2]
        if not raw.startswith('"') and not set(t) & set(';"\\{}[]\r\n\t'):
            return t
        return '"' + t.replace("\\", "\\\\").replace('"', '\\"').replace("\r", "\\r").replace("\n", "\\n").replace("\t", "\\t") + '"'

    size = lambda raws: len(text.encode()) + sum(len(v.encode()) - len(found[i][2].encode()) for i, v in raws.items())
    for step in range(4):
        table = {a: b for s in string_tables.STEPS[:step] for a, b in s.items()}
        raws = {i: written(i, t.translate(str.maketrans(table))) for i, t in new.items()}
        if not budget or size(raws) <= budget:
            break
    grow = {i: len(v.encode()) - len(found[i][2].encode()) for i, v in raws.items() if v != found[i][2]}
    gone = set()
    for i in sorted(grow, key=lambda i: (-grow[i], i)):
        if not budget or size({k: v for k, v in raws.items() if k not in gone}) <= budget or grow[i] <= 0:
            break
        gone.add(i)
    if budget and size({k: v for k, v in raws.items() if k not in gone}) > budget:
        gone = set(grow)
    kept = {i: raws[i] for i in grow if i not in gone}
    out = text
    for i in sorted(kept, reverse=True):
        out = out[: found[i][5]] + kept[i] + out[found[i][6] :]
    return out, len(kept), (step if grow else 0), len(gone & set(grow))


def test_refilled(spark):
    r = random.Random(4)
    files, units, budgets, want = [], [], [], {}
    words = ["短い", "，", "。", "！", "（", "；", "“", "ok", "{", "}", "]", "\n", "'", "\\", "x" * 9]
    for i in range(120):
        values = ["".join(r.choice(["a", "bc", "é", "{", "}", " "]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 6))]
        text = "StringTable{" + "".join(f"N{k}=LineCodeData{{Text=" + (f'"{v}"' if r.random() < 0.5 else v) + ";};" for k, v in enumerate(values)) + "}"
        targets = {}
        for k, v in enumerate(values):
            if r.random() < 0.8:
                targets[f"N{k}"] = (v if r.random() < 0.9 else "other", v if r.random() < 0.1 else "".join(r.choice(words) for _ in range(r.randint(0, 5))))
        budget = r.choice([None, 0, len(text.encode()) + r.randint(-8, 60)])
        files.append((f"f{i}", text))
        units += [(f"f{i}", name, o, t) for name, (o, t) in targets.items()]
        budgets.append((f"f{i}", budget))
        want[f"f{i}"] = plain_refill(text, targets, budget)
    files += [("null", None), ("plain", "not a table")]
    want |= {"null": (None, 0, 0, 0), "plain": ("not a table", 0, 0, 0)}
    df = spark.createDataFrame(files, "path string, text string")
    out = string_tables.refilled(df, spark.createDataFrame(units, "path string, name string, original string, target string"), spark.createDataFrame(budgets, "path string, budget long"))
    got = {x.path: (x.text, x.n_replaced, x.step, x.n_dropped) for x in out.collect()}
    assert got == want
    assert len({x[2] for x in want.values()}) == 4 and any(x[3] for x in want.values())


def test_stray_brackets_stay_one_column(spark):
    rows = [("a{b}{c}]", "{x}"), ("{[}]", ""), ("plain", "{"), ("]]漢[[", "[]")]
    out = string_tables.without_stray_brackets(F.col("new"), F.col("old"))
    got = [r[0] for r in spark.createDataFrame(rows, "new string, old string").select(out).collect()]
    assert got == ["a{b}c", "", "plain", "]漢["]
    assert len(str(out)) < 5000  # nested, it held its text thousands of times, which the driver couldn't plan


def test_table_units(spark):
    text = 'StringTable{CMAP1=LineCodeData{Text=abc;};A=LineCodeData{Text="Press /BUTTON_A/ {0}";Character=Text;};B=LineCodeData{Text=12;};C=LineCodeData{Text=Hi;Character=Bo;};}'
    df = spark.createDataFrame([("stringtable/x_usenglish", text), ("stringtable/x_german_english", text), ("stringtable/x", text)], "path string, text string")
    rows = {r.name: (r.original, r.speaker, r.protected, r.parts) for r in string_tables.table_units(df).collect()}
    assert rows == {"A": ("Press /BUTTON_A/ {0}", "", "Press 【0】 【1】", ["/BUTTON_A/", "{0}"]), "C": ("Hi", "Bo", "Hi", [])}


def test_claims(spark):
    """Against tables looked at one after the other; one name has a third of all."""
    r = random.Random(2)
    name = lambda: "hot" if r.random() < 0.4 else r.choice(["a", "b", None])
    held = list({(name(), r.randint(0, 30), f"k{r.randint(0, 9)}"): f"v{r.randint(0, 3)}" for _ in range(900)}.items())
    held = [(n, p, k, v) for (n, p, k), v in held]
    units = sorted({(name(), f"k{r.randint(0, 12)}", f"v{r.randint(0, 4)}") for _ in range(60)}, key=str) + [("none", "k1", "v1")]
    want = []
    for n in {u[0] for u in units}:
        for place in sorted({p for m, p, _, _ in held if m == n}):
            fits = [(*u, place) for u in units if u[0] == n and (n, place, u[1], u[2]) in held]
            if fits:
                want += fits
                break
    out = string_tables.claimed(spark.createDataFrame(units, "name string, key string, original string"), spark.createDataFrame(held, "name string, place int, key string, value string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_slots(spark):
    df = spark.createDataFrame([("p", 10, 40), ("p", 0, 40), ("p", 25, 40), ("q", 5, 9)], "pack string, offset long, last long")
    assert sorted((r.pack, r.offset, r.slot) for r in string_tables.slots(df, "pack", "offset", F.col("last")).collect()) == [("p", 0, 10), ("p", 10, 15), ("p", 25, 15), ("q", 5, 4)]


# Encodings


def test_encodings(spark, tmp_path):
    text = "Füße 漢字\r\nテスト\r\n"
    cases = {
        "le": (b"\xff\xfe" + text.encode("utf-16-le"), (text, "utf-16-le", True, False)), "be": (b"\xfe\xff" + text.encode("utf-16-be"), (text, "utf-16-be", True, False)),
        "sig": (b"\xef\xbb\xbf" + text.encode(), (text, "utf-8", True, False)), "utf8": (text.encode(), (text, "utf-8", False, False)),
        "sjis": ("テスト\n".encode("shift_jis"), ("テスト\n", "shift_jis", False, False)), "other": ("\udc00é".encode("latin-1", "replace") + b"\xff\xfd\x80", ("?é\xff\xfd\x80", "latin-1", False, False)),
        "broken": (b"\xff\xfea\x00\x00\xd8", ("a\ufffd", "utf-16-le", True, True)), "empty": (b"", ("", "utf-8", False, False)), "mark": (b"\xef\xbb\xbf", ("", "utf-8", True, False)), "long": (b"\xff\xfe" + ("é" * 400_000).encode("utf-16-le"), ("é" * 400_000, "utf-16-le", True, False)),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("null", None)], "k string, data binary")
    rows = df.select("k", "data", encodings.decoded(F.col("data"), "latin-1").alias("x")).select("k", "data", "x.*")
    back = rows.withColumn("back", encodings.encoded(F.col("text"), F.col("charset"), F.col("mark"))).collect()
    assert {r.k: (r.text, r.charset, r.mark, r.lossy) for r in back if r.k != "null"} == {k: v[1] for k, v in cases.items()}
    assert all(r.back == r.data for r in back if not r.lossy)
    said = spark.createDataFrame([("漢", "latin-1", False), ("漢", "shift_jis", False), (None, "utf-8", True)], "t string, c string, m boolean")
    assert [r[0] for r in said.select(encodings.encoded(F.col("t"), F.col("c"), F.col("m"))).collect()] == [None, "漢".encode("shift_jis"), None]
    for k, v in cases.items():
        (tmp_path / k).write_bytes(v[0])
    files = encodings.read_texts(spark, f"file://{tmp_path}", "latin-1")
    found = {r.path.rsplit("/", 1)[1]: (r.newline, r.trailing) for r in files.collect()}
    assert found["le"] == ("\r\n", True) and found["sjis"] == ("\n", True) and found["long"] == ("\n", False)
    kept = encodings.file_data(files, F.element_at(F.split("path", "/"), -1))
    assert {r.rel: bytes(r.data) for r in kept.collect()} == {k: v[0] for k, v in cases.items() if not v[1][3] and v[0]}


# Splicing and batches


def test_refused_edits(spark):
    text = "title: a\r\n---\r\nBo: hi there #line:1\r\n  -> go on\r\nplain words\r\n[[open|n]]\r\n<<set $x>> =not\r\nBo: bye\n===\n"
    files = spark.createDataFrame([("f", text, 1), ("g", None, 1), ("h", "no node", 1)], "path string, text string, n_replaced int")
    edits = [
        (3, "hi there", "salut"), (4, "go on", "a // b"), (5, "plain words", "Al: x"), (6, "open", "shut"), (7, "=not", "<<a>>"), (8, "bye", "x\n==="), (8, "bye", None), (9, "x", "y"), (3, "other", "no"), (8, "by", "no"),
    ]
    units = spark.createDataFrame([("f", *e) for e in edits] + [("g", 1, "x", "y")], "path string, line int, body string, target string")
    out, told = splice.statements_back(files, units)
    rows = {r.path: (r.text, r.n_replaced) for r in out.collect()}
    why = {(r.line, r.target): r.why for r in told.filter("path = 'f'").collect()}
    assert rows["f"] == (text.replace("hi there", "salut").replace("[[open", "[[shut"), 2) and rows["g"] == (None, 0) and rows["h"] == ("no node", 0)
    assert why == {(3, "salut"): None, (4, "a // b"): "text", (5, "Al: x"): "speaker", (6, "shut"): None, (7, "<<a>>"): "gone", (8, "x\n==="): "lines", (9, "y"): "moved", (3, "no"): "moved", (8, "no"): "moved"}
    bare = spark.createDataFrame([("b", "---\nwords\nmore\n===")], "path string, text string")
    out, told = splice.statements_back(bare, spark.createDataFrame([("b", 2, "words", "=== x"), ("b", 3, "more", "-> y")], "path string, line int, body string, target string"))
    assert {r.why for r in told.collect()} == {"structure", "form"} and out.first().text == "---\nwords\nmore\n==="


@pytest.mark.parametrize(("reply", "n", "want"), [('{"1": "a", "2": "b"}', 2, ["a", "b"]), ('```json\n{"2": "b", "1": "a"}\n```', 2, ["a", "b"]), ('so {"1": "a"} yes', 1, ["a"]), ('{"1": "a"}', 2, None), ('{"1": "a", "3": "b"}', 2, None), ('{"1": 5}', 1, None), ('["a"]', 1, None), ("no", 1, None), (None, 1, None), ('{"1": "a", "2": "b"}', 1, None)])
def test_reconciled(reply, n, want):
    assert batches.reconciled(reply, n) == want


def faulty(kind):
    """A stand-in that fails by what it is asked, so that each run sees the same."""

    def many(items):
        first = items[1]
        if "down" in first:
            raise OSError("down")
        out = {str(i): f"<{t}>" for i, t in items.items()}
        if "shift" in first:
            out = {str(i + 1): t for i, t in zip(items, out.values(), strict=True)}
        if "leak" in first:
            out["1"] = "好的，我将 x"
        return "garbage" if "noise" in first else json.dumps(out)

    def one(text):
        if "dead" in text:
            raise ValueError("dead")
        return "" if "void" in text else f"[{text}]"

    return many, one


def test_batches(spark):
    words = ["alpha", "down beta", "shift gamma", "leak delta", "noise eps", "dead zeta", "void eta", "theta"]
    r = random.Random(6)
    texts = [f"{r.choice(words)} {i % 37}" for i in range(150)] + ["はい", "", None, "12"]
    rows = [(i, f"u{i}", t) for i, t in enumerate(texts)]
    units = spark.createDataFrame(rows, "seq long, uid string, original string").repartition(5)
    out, counts = batches.transform(units, *faulty(spark), script="kana", batch=4, retries=2)
    got = {x.uid: (x.target, x.how) for x in out.collect()}
    # A plain run over the same batches.
    from loomwork.functions import text as T

    skipped = {x.original for x in units.filter(T.should_skip(F.col("original"), "kana")).collect()}
    order = list(dict.fromkeys(t for t in texts if t not in skipped))
    many, one = faulty(spark)
    want, n = {}, dict.fromkeys(["requests", "retried", "batched", "degraded", "failed", "unverified"], 0)

    def tried(call, x):
        for k in range(3):
            n["requests"] += 1
            n["retried"] += k > 0
            try:
                return call(x)
            except (OSError, ValueError):
                pass

    for a in range(0, len(order), 4):
        part = order[a : a + 4]
        reply = batches.reconciled(tried(many, dict(enumerate(part, 1))), len(part))
        good = reply is not None and "好的，我将 x" not in reply
        n["batched" if good else "degraded"] += 1
        for t, o in zip(part, reply if good else part, strict=True):
            o = o if good else tried(one, t)
            want[t] = (o or None, "failed" if not o else "batched" if good else "single")
            n["failed"] += not o
    assert {u: got[u] for _, u, t in rows if t not in skipped} == {u: want[t] for _, u, t in rows if t not in skipped}
    assert all(got[u] == (None, "skipped") for _, u, t in rows if t in skipped)
    assert counts.get == {"units": len(rows), "skipped": sum(t in skipped for t in texts), "unique": len(order), **n} and all(n[k] for k in n if k != "unverified")
    none, counts = batches.transform(units.limit(0), many, one)
    assert none.collect() == []


def test_ranked_packages(spark):
    kinds = "package string, created int, error string, exe array<string>, data_dirs array<string>, packs array<string>, dirs array<string>"
    rows = [("a", 1, None, ["G.exe"], None, [], None), ("b", 2, None, ["g.EXE"], ["other"], None, None), ("c", 2, "", ["no"], None, None, None), ("d", 3, "bad", ["g.exe"], None, None, None), ("e", 3, None, None, None, None, ["x"]), ("f", 1, None, ["g.exe"], None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    found = reconcile.ranked_packages({"exe": ["g.exe"], "data_dirs": ["d"]}, df)
    assert [(r.place, r.package, r.verdict) for r in found.orderBy("place").collect()] == [(0, "f", "match"), (1, "a", "match"), (2, "b", "partial"), (3, "e", "unknown"), (4, "d", "unknown"), (5, "c", "mismatch")]
    assert reconcile.default_place(found) == 0
    assert reconcile.default_place(reconcile.ranked_packages({}, df)) is None
    mine = reconcile.ranked_packages({"exe": ["none"]}, df.limit(0), "own")
    assert [tuple(r) for r in mine.collect()] == [(0, "own", "match", [], "")] and reconcile.default_place(mine) == 0


def test_python_gets_small_batches(spark):
    from loomwork.plans.queries import table

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")  # the default, which other tests may have lowered
    table(spark, "/root/testdata/sf0.001", "part")
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = [r[0] for r in rows.mapInPandas(lambda frames: (f.assign(n=len(f))[["n"]] for f in frames), "n int").collect()]
    assert len(sizes) == 40 and max(sizes) <= 9
