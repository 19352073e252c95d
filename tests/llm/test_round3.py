"""Importance resampling, spelling variants and language identification against brute-force versions; their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import decontamination, language_id, near_dedup, pii, queries, resampling, spelling, toxicity, url_filter

from .test_operators import EDGES, docs_of

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


def by_sql(name, sf=SF):
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = c.sql(queries.ORACLE[name])
        return found.columns, sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op11_resampling", "op12_spelling"])
def test_sql(spark, name):
    out = queries.QUERIES[name](spark, SF)
    columns, rows = by_sql(name)
    assert out.columns == columns
    assert sorted(map(tuple, out.collect()), key=str) == rows


# 11 resampling


def runs(text, n):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 19])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_features(n, block):
    r = random.Random(1)
    texts = [None, "", "a", "A b", "é à-b c d", "x" * 3000 + " y " + "z" * 5000, *["".join(r.choice("aB é.-0ß漢") for _ in range(r.randint(0, 40))) for _ in range(150)]]
    got = [[] for _ in texts]
    column = pa.array(["before", *texts]).slice(1)
    for row, crc, _ in resampling.features(column, n, block):
        for i, c in zip(row.tolist(), crc.tolist(), strict=True):
            got[i].append(c)
    assert [sorted(g) for g in got] == [sorted(zlib.crc32(f.encode()) for f in runs(t, n)[1]) for t in texts]


def plain_resample(docs, target, share, least, buckets):
    hashed = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs(t, 2)[1]]
    s, t = Counter(b for _, x in docs for b in hashed(x)), Counter(b for x in target for b in hashed(x))
    many, wanted = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        f = hashed(x)
        gain = [math.floor(1000 * math.log((t[b] + 1.0) * (many + buckets) / ((s[b] + 1.0) * (wanted + buckets)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(runs(x, 2)[0]) >= least))
    fit = sorted([r for r in out if r[4]], key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    fit, drawn = [r[:4] for r in fit], share * len(fit) // 100
    return sorted([(*r, k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in out if not r[4]], key=str)


def test_resample(spark):
    r = random.Random(3)
    said = [(i % 90 if i % 13 else None, " ".join(r.choice(["red", "Green", "blue", "à", "x1"]) for _ in range(r.randint(0, 12)))) for i in range(200)]
    texts = [*EDGES, *said, *[(500, "red green blue red")] * 300]
    target = ["red green", "red green blue", None, ""]
    docs = docs_of(spark, texts)
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    out = resampling.resample(docs, wanted, share=40, least=4, buckets=50)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_resample([(i, t) for i, t in texts], target, 40, 4, 50)
    assert resampling.resample(docs.limit(0), wanted).collect() == []
    none = resampling.resample(docs, wanted.limit(0), share=0).collect()
    assert len(none) == len(texts) and all(x["rank"] is None for x in none)


# 12 spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted([a, b], key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, letters, least, ratio, typo):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if typo and h % typo == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    beside = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {w: min(b, key=lambda x: (-n[x], x)) for w, b in beside.items() if b}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted([(w, n[w], form.get(w), len(beside[w]), n[form[w]] if w in form else None, root(w)) for w in n], key=str)


def test_variants(spark):
    r = random.Random(5)
    words = ["".join(r.choice("aabé") for _ in range(r.randint(3, 6))) for _ in range(150)]
    texts = [(i if i % 7 else None, " ".join(r.choice(words).upper() if r.random() < 0.2 else words[int(len(words) * r.random() ** 4)] for _ in range(40))) for i in range(80)]
    texts += [*EDGES, (900, "ÀÉab " * 4), (901, "z" * 20_000 + "a " + "z" * 20_000 + "b " + "z" * 20_000), *[(902, "chainx chainy chainx")] * 40, *[(903, "chaixx")] * 9, *[(904, "chaiyx")] * 2]
    out = spelling.variants(docs_of(spark, texts), letters=4, least=1, ratio=2, typo=11)
    assert out.columns == ["word", "n", "form", "n_near", "form_n", "root"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == plain_variants(texts, 4, 1, 2, 11)
    assert sum(x[1] for x in rows) > 1000 and any(x[5] != x[2] for x in rows if x[2])
    assert spelling.variants(docs_of(spark, [(1, None)]).limit(0)).collect() == []
    assert spelling.variants(docs_of(spark, [(1, None), (2, "")])).collect() == []


def test_deletions():
    own, word, keys, low, high = spelling.deletions(["aab", "", "ab", "b"])
    assert [(w, a, b) for w, a, b in zip(word.tolist(), low.tolist(), high.tolist(), strict=True)] == [(0, 0, 1), (0, 2, 2), (2, 0, 0), (2, 1, 1), (3, 0, 0)]
    assert keys[0] == own[2] and keys[2] == own[3] and keys[4] == own[1] and len(set(own.tolist())) == 4


# 13 language identification


def test_gradient():
    rng = np.random.default_rng(1)
    parts = [rng.integers(60, 130, n).astype(np.uint8).tobytes() for n in (9, 9, 7, 3, 1)]
    sizes = np.array([len(p) for p in parts])
    data, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes
    net = language_id.Network(3, 4)
    y = np.array([0, 1, 2, 1, 0])

    def loss():
        p, letters = language_id._labels(net, data, starts, sizes)
        return -float((np.log(p[:, y, np.arange(5)].astype(float)) * letters).sum())

    kept = ([], [])
    p, letters = language_id._labels(net, data, starts, sizes, kept)
    p[:, y, np.arange(5)] -= 1
    p *= letters[:, None]
    inside = (np.arange(len(p))[:, None] < sizes)[:, None]
    grads = net.back("f", kept[0], p) | net.back("b", kept[1], language_id._turned(p, sizes) * inside) | {"base": p.sum((0, 2))}
    for name, g in grads.items():
        w = net.weights[name]
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g).ravel())[:3], g.shape), strict=True):
            was, each = w[at], []
            for d in (1e-2, -1e-2):
                w[at] = was + d
                each.append(loss())
            w[at] = was
            assert abs((each[0] - each[1]) / 2e-2 - g[at]) < 0.02 * max(1, abs(g[at])), name


def test_pooled_is_a_plain_network():
    """One byte after the other, in plain Python."""
    texts = [None, "", "Abc d1", "é" * 40, "x", "2 4", "long text here " * 9]
    net, width = language_id.Network(3, 4), 16
    w = {k: v.astype(float) for k, v in net.weights.items()}

    def states(way, data):
        h, out = np.zeros(4), []
        for x in data:
            r, z = (1 / (1 + np.exp(-(w[way + "table"][k, x] + h @ w[way + "state"][k]))) for k in (0, 1))
            n = np.tanh(w[way + "table"][2, x] + r * (h @ w[way + "state"][2] + w[way + "bias"]))
            h = n + z * (h - n)
            out.append(h @ w[way + "out"])
        return out

    p, many = language_id._pooled(net, pa.array(["cut", *texts]).slice(1), width, 3)
    for i, t in enumerate(texts):
        data, found = (t or "").translate(LOWER).encode(), []
        for a in range(0, len(data), width):
            part = data[a : a + width]
            for x, f, b in zip(part, states("f", part), states("b", part[::-1])[::-1], strict=True):
                if x >= 128 or chr(x).isalpha():
                    e = np.exp(f + b + w["base"])
                    found.append(e / e.sum())
        assert many[i] == len(found)
        assert np.allclose(p[i], np.mean(found, 0) if found else 0, atol=1e-4)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, sample=80)
    assert model["names"] == ["de", "en", "es", "fr"]
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)

    texts = [*EDGES, (20, "123 456"), (21, "☃ ☃"), (22, "漢字")]
    out = language_id.predict(docs_of(spark, texts), model)
    assert out.columns == ["doc_id", "lang_pred", "score"] and out.count() == len(texts)
    found = {r.doc_id: r for r in out.collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0) for i in (1, 2, 3, 20, 21))
    assert all(found[i].lang_pred in model["names"] and found[i].score > 0 for i in (4, 5, 6, 7, 22, None))
    empty = docs_of(spark, texts).limit(0)
    assert language_id.predict(empty, model).collect() == []
    assert {r.lang_pred for r in language_id.predict(docs_of(spark, texts), language_id.fit(empty)).collect()} == {"und"}
    unknown = docs_of(spark, texts).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert language_id.fit(unknown)["names"] == []


# Earlier operators: what had no test over whole tables, and edges


def test_token_counts_of_a_whole_table(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len(t.encode()), len(model.encode(t, add_special_tokens=False))) for i, t in texts.items()}


def test_edges_of_earlier_operators(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id int, url string")
    assert [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, []).orderBy("page_id").collect()] == [("a.org", "/x", None, "allow"), ("", "", None, "allow")]
    docs, labels = docs_of(spark, EDGES), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs.limit(0), model).collect() == [] and {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    phrases = spark.createDataFrame([("p", "red blue"), ("p", "red blue"), (None, "red"), ("n", None), ("e", "")], "item_id string, text string")
    said = docs_of(spark, [(1, "red x blue"), (1, "red x blue"), (None, "red blue"), (3, None), (4, "")])
    found = sorted(map(tuple, decontamination.near_phrases(said, phrases).select("_id", "item", "start", "end").collect()), key=str)
    assert found == sorted([(1, "p", 0, 2), (1, None, 0, 0), (None, "p", 0, 1), (None, None, 0, 0)], key=str)
    assert decontamination.near_phrases(said.limit(0), phrases).collect() == [] and decontamination.near_phrases(said, phrases.limit(0)).collect() == []


def test_near_duplicates_without_sifting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, sift=s).collect()} for s in (True, False))
    assert a == b


# 3 personal data: the whole bootstrapping in plain Python


def plain_bootstrap(texts, support=5, confidence=0.8, rounds=4, cycles=3):
    """Added (kind, start, end) of each text: contexts are strings, the graph is dictionaries, ordinary words are counted exactly."""
    word = re.compile(r"[A-Za-z0-9._@+%\-\x80-\U0010ffff]+|[^ \t\n\x0b\x0c\r\x00A-Za-z0-9._@+%\-\x80-\U0010ffff]+")
    low = lambda t: t.translate(LOWER)
    docs = []
    for t in texts:
        tokens = [(m.start(), m.end(), low(m[0])) for m in word.finditer(t)]
        sides = []
        for i, (_, _, w) in enumerate(tokens):
            at = lambda *k, i=i, tokens=tokens: tuple(tokens[i + j][2] for j in k) if all(0 <= i + j < len(tokens) for j in k) else None
            begin = w[:4] if len(w.encode()) >= 8 and re.match("[a-z]{4}", w) else None
            sides.append([(s, c) if c else None for s, c in enumerate([at(-2, -1), at(-1), at(-3, -2), at(1, 2), begin])])
        docs.append((t, tokens, sides, pii.base_spans(t)))
    seeds = {}
    for t, tokens, sides, base in docs:
        starts = [a for a, _, _ in tokens]
        for k, a, b in base:
            first, last = (starts.index(a) if a in starts else None), max(i for i, s in enumerate(starts) if s < b)
            for c in [*(sides[first][:3] if first is not None else []), sides[last][3]]:
                if c:
                    seeds[c, low(t[a:b])] = max(k, seeds.get((c, low(t[a:b])), -1))
        for i, (a, b, _) in enumerate(tokens):
            if pii._random(t, a, b) and not any(s[1] < b and s[2] > a for s in base):
                for c in sides[i]:
                    if c:
                        seeds[c, low(t[a:b].rstrip(".-_@+%"))] = 4
    marks, looked, hits = set(seeds), set(), []
    for _ in range(cycles):
        n = Counter(c for c, _ in marks)
        wanted = {c for c, k in n.items() if k >= support} - looked
        if not wanted:
            break
        looked |= wanted
        graph, plain, places = {}, {}, []
        for d, (t, tokens, sides, base) in enumerate(docs):
            for i, (a, b, w) in enumerate(tokens):
                for c in sides[i]:
                    if c not in looked or c is None:
                        continue
                    some = any(x in "0123456789@" for x in w) and re.match(r"[A-Za-z0-9._@+%\-\x80-\U0010ffff]", w)
                    if some or (pii._LEAD.match(t, a)):
                        if any(s[1] < b and s[2] > a for s in base):
                            continue
                        spans = pii.extents(t, a, b, base, c[0] == 3)
                        ends = [x for x in spans if x[1]]
                        if ends:
                            inst = low(t[min(ends)[0] : max(x[1] for x in ends)])
                            shaped = pii._mixed_up(t, a, b)
                            graph[c, inst] = max(graph.get((c, inst), -9), -1 if shaped else -3)
                            places.append((d, c, inst, spans, sides[i]))
                            continue
                    plain.setdefault(c, set()).add(w)
        graph |= {(c, x): max(k, graph.get((c, x), -9)) for (c, x), k in seeds.items() if c in looked}
        of = {}
        for (c, x), k in graph.items():
            of.setdefault(c, {})[x] = k
        kept = {c for c in of if len(plain.get(c, ())) <= 4 * max(1, sum(k >= 0 for k in of[c].values()))}
        guess, scores = {}, {}
        for r in range(rounds + 1):
            scores = {}
            for c in kept:
                for kind in {k for k in of[c].values() if k >= 0} | {k for x in of[c] for k in guess.get(x, {})}:
                    mass = sum(k == kind for k in of[c].values()) + sum(guess.get(x, {}).get(kind, 0) for x, k in of[c].items() if k < 0)
                    neutral = sum(1 - guess.get(x, {}).get(kind, 0) for x, k in of[c].items() if k == -1) if kind == 4 else 0
                    scores[c, kind] = mass / (len(of[c]) + len(plain.get(c, ())) - neutral)
            if r == rounds:
                break
            by = {}
            for (c, x), k in graph.items():
                for kind in range(5):
                    if k < 0 and (c, kind) in scores:
                        by.setdefault((x, kind), {}).setdefault(c[0], []).append(1 - scores[c, kind])
            guess = {}
            for (x, kind), each in by.items():
                guess.setdefault(x, {})[kind] = max(1 - math.prod(max(1e-9, v) for v in side) for side in each.values())
        best = {}
        for (c, kind), s in scores.items():
            if s >= confidence:
                best[c] = max(best.get(c, (0, 0)), (s, -kind))
        hits = [(d, -best[c][1], spans[-best[c][1]], best[c][0], inst, own) for d, c, inst, spans, own in places if c in best and spans[-best[c][1]][1]]
        marks = set(seeds) | {(c, inst) for *_, inst, own in hits for c in own if c}
    out = {}
    for d, kind, (a, b), s, _, _ in hits:
        out.setdefault((d, a), []).append(((s, -kind), kind, b))
    added = [[] for _ in texts]
    for (d, a), each in out.items():
        _, kind, b = max(each)
        added[d].append((kind, a, b))
    return [sorted(x) for x in added]


def test_bootstrap_is_the_plain_one(spark):
    r = random.Random(8)
    word = lambda: r.choice(["red", "green", "blue", "sea", "sky", "the", "of", "42"])
    made = []
    for i in range(240):
        key = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20))
        tail = ["call me at +44 20 %07d now" % r.randrange(10**7), "my cell is %03d 555 %04d ok" % (r.randrange(1000), r.randrange(10**4)), f'key = "{key}" ;', f"AKIA{key[:16].upper()} here", f"password={key[:18]}", "call me at noon", "my cell is dead"][i % 7]
        made.append(" ".join([*(word() for _ in range(r.randint(2, 9))), tail, *(word() for _ in range(r.randint(2, 9)))]))
    for texts in ([d.text or "" for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()], made + [made[0]] * 50 + ["", "a"]):
        docs = docs_of(spark, list(enumerate(texts)))
        got = {x._id: sorted((s.kind, s.start, s.end) for s in x.added) for x in pii.extract(docs).collect()}
        assert got == dict(enumerate(plain_bootstrap(texts)))
        assert sum(map(len, got.values())) > 10
