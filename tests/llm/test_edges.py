"""Edges that every stage and operator meets: clashing columns, nulls, long texts, ties, repeated rows, empty tables; bounds that switch the way of working."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, decontamination, embedding_dedup, mixing, near_dedup, pii, queries, shared, suffix_dedup, token_counts, toxicity, url_filter

from .test_operators import docs_of, jaccard_classes, prose

CLASHING = ["_id", "_h", "_spans", "_row", "row", "_text", "_k", "node", "kept", "spans", "a", "b"]
ROWS = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no key"), (4, prose(1, 60)), (5, prose(1, 60) + " x"), (6, "mail a.b@c.de now"), (7, "word " * 200_000)]


def clashing(spark, rows=ROWS):
    """Documents with columns that operators might add themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def untouched(out, columns):
    assert out.columns == columns
    rows = out.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    return rows


def test_stages_keep_columns_of_any_name(spark):
    df = clashing(spark)
    labels = spark.createDataFrame([(4, 0), (6, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "a.b c"), (2, None)], "item_id long, text string")
    model = (np.zeros(toxicity.FEATURES, np.float32), -np.inf)
    assert len(untouched(toxicity.reject(df, model), df.columns)) == len(ROWS)
    assert len(untouched(toxicity.reject(df, toxicity.fit(df, labels)), df.columns)) >= 6
    kept = untouched(near_dedup.one_of_each(df), df.columns)
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "6", "7", "None"]
    assert sorted(str(r.doc_id) for r in untouched(decontamination.without_contaminated(df, bench), df.columns)) == sorted(str(i) for i, _ in ROWS if i != 6)  # a, b and c are half of its words
    redacted = untouched(pii.redact(df), df.columns)
    assert len(redacted) == len(ROWS)
    assert {r.text for r in redacted if r.doc_id == 6} == {"mail <email> now"}
    for stage in (lambda d: toxicity.reject(d, model), near_dedup.one_of_each, lambda d: decontamination.without_contaminated(d, bench), pii.redact):
        assert stage(df.limit(0)).count() == 0


def test_other_operators_ignore_columns_of_any_name(spark):
    df = clashing(spark)
    assert mixing.mix(df).count() == len(ROWS)
    assert suffix_dedup.find_repeats(df).count() == len(ROWS)
    assert toxicity.score(df, (np.zeros(toxicity.FEATURES, np.float32), -np.inf)).count() == len(ROWS)
    assert near_dedup.near_duplicates(df).count() == len(ROWS)
    assert pii.extract(df).count() == len(ROWS)


def test_columns_of_the_contract(spark):
    found = queries.op10_toxicity(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]


# 1 cascades in parts


@pytest.mark.parametrize("max_bits", [1 << 31, 1 << 10])
def test_url_filter_parts(spark, max_bits):
    rules = [("block" if i % 3 else "allow", f"h{i}.org", "/" if i % 2 else f"/p{i}") for i in range(400)]
    urls = [f"http://x.h{i}.org/p{i}/z" for i in range(0, 500, 3)] + ["http://h1.org/" + "long" * 10_000, None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, max_bits=max_bits).collect()}

    def brute(u):
        m = re.match("http://([^/]*)(/.*)", u or "")
        fits = [(len(h + p), h + p, a) for a, h, p in rules if m and (m[1] == h or m[1].endswith("." + h)) and m[2].startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    assert out == {i: brute(u) for i, u in enumerate(urls)}


# 2 one key that has a third of the rows


def test_mixing_of_repeated_keys(spark):
    texts = [(None, "w " * (i % 5)) for i in range(200)] + [(i, "w " * (i % 9)) for i in range(300)]
    df = spark.createDataFrame([(i, t, "a" if j % 3 else "b") for j, (i, t) in enumerate(texts)], "doc_id long, text string, source string")
    for bucket in (4096, 3):
        out = mixing.mix(df, bucket=bucket).collect()
        assert len(out) == len(texts)
        for source in "ab":
            own = [r for r in out if r.source == source]
            assert sum(r.taken for r in own) == int(own[0].target) and all(0 <= r.taken <= 3 * r["size"] for r in own)


# 3 against regular expressions


def test_base_spans_against_plain_patterns():
    def luhn(digits):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    def plain(text):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]*[A-Za-z0-9._%+-]@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15:
                    out.append((kind, *m.span()))
        return sorted(out)

    r = random.Random(8)
    bits = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111", "1", "22", "255", "256", "1.2.3.4", "+15235551055", "é", "\n", "007"]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_pii_cycles_and_random_strings(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    key = lambda: "".join(r.choice("abcdef") + r.choice("0123456789") for _ in range(10))
    texts = [(i, f"{word()} secret = {key()} {word()}") for i in range(9)]
    texts += [(20 + i, f"{word()} secret = hunter{i}22 kept under lock {word()}") for i in range(7)]  # found, and so are seeds of what stands behind
    texts += [(40, f"{word()} walnut{7}7 kept under lock {word()}"), (41, f"{word()} {key()} {word()}"), (42, "secret = nothing here")]
    added = {x["_id"]: [(pii.KINDS[s.kind], t[s.start : s.end]) for t in [dict(texts)[x["_id"]]] for s in x.added] for x in pii.extract(docs_of(spark, texts)).collect()}
    assert all(len(added[i]) == 1 and added[i][0][0] == "secret" for i in range(9))
    assert [added[20 + i] for i in range(7)] == [[("secret", f"hunter{i}22")] for i in range(7)]
    assert added[40] == [("secret", "walnut77")] and added[41] == [] and added[42] == []


def test_sketches_of_ordinary_words(spark):
    g = np.random.default_rng(3)
    words = g.integers(1, 1 << 62, 5000)
    held = pii.Ordinary(2, np.array([2000, 3]))
    held.add(np.zeros(5000, np.int64), words)
    held.add(np.ones(40, np.int64), np.arange(40))
    at, word, bound = held.sketches()
    assert (at == 0).sum() == pii.SKETCH and (bound[at == 1] == 0).all() and (at == 1).sum() == 1
    n = (word[at == 0] < bound[0]).sum() / (bound[0] / (1 << 63))
    assert abs(n - 5000 * 2) / 10_000 < 0.5  # words fill half of the space, so twice as many would fill it all


# 6 the two ways of a pre-token


def test_token_counts_either_way(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["the", "of", "x" * r.randint(1, 30), f"w{r.randint(0, 5000)}", "ünï"]) for _ in range(r.randint(0, 80)))) for i in range(120)] + [(500, "y" * 20_000), (500, None), (None, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ways = [sorted(map(str, token_counts.count_tokens(df, path, **o).collect())) for o in ({}, {"frequent": 0}, {"frequent": 20, "table_size": 10, "longest": 8})]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len(texts)
    plan = token_counts.count_tokens(df, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


# 7 repeated ids


def test_embedding_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [0.0, 1.0]), (3, [2**-140, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.links(df).collect())
    assert out == sorted([("1", 2, "1"), ("1", 1, "1"), ("2", 2, "1"), ("None", 1, "1"), ("3", 2, "1")])


# 8 loose families, taken apart by blocks


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_near_duplicates_long_texts_and_loose_families(spark, weighting):
    r = random.Random(6)
    base = prose(1, 300).split()

    def loose(n):
        words = list(base)
        for at in r.sample(range(len(words)), n):
            words[at] = f"e{at % 40}x{r.randint(0, 2)}"
        return " ".join(words)

    texts = [(i, loose(r.randint(2, 24))) for i in range(80)] + [(100, "w " + " ".join(base * 40)), (101, " ".join(base * 40))]
    out = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs_of(spark, texts), weighting=weighting, crowd=8).collect()}
    if weighting == "set":
        assert out == jaccard_classes(texts)
    assert out[101] == out[100]


def test_blocks_give_the_same_pairs(spark):
    r = random.Random(7)
    rows = [(i, 9, i % 4, 0.7 if i % 3 else 0.9, 20, 15 + i % 4, sorted(r.sample(range(30), 8))) for i in range(60)]
    near = spark.createDataFrame(rows, "node long, head long, label long, j double, n long, common long, added array<long>")
    one, many = ({tuple(x) for x in near_dedup._around(near, 0.8, block=b).collect()} for b in (2048, 7))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[2] != y[2] and min(x[3], y[3]) < 0.8 and 40 <= 2.25 * (min(x[5], y[5]) + len(set(x[6]) & set(y[6]))) + 1e-9:
                want.add((x[0], y[0]))
    assert one == many == want and want


# 9 texts of one word


def test_decontamination_of_repetitive_texts(spark):
    bench = spark.createDataFrame([(1, "w w w w"), (1, "v v"), (None, "u")], "item_id long, text string")
    df = spark.createDataFrame([(1, "w " * 20_000), (2, "v v u"), (None, "u"), (3, None)], "doc_id long, text string")
    out = {str(r.doc_id): (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontamination.judge(df, bench).collect()}
    assert out == {"1": (20_000, 20_000, ["1"], True), "2": (3, 3, ["1"], True), "None": (1, 1, [], True), "3": (0, 0, [], False)}


# 10 against a plain noisy-or


def test_toxicity_scores_against_a_plain_version():
    texts = ["bad thing. good thing!", "", "Übel bad", "good thing"] * 20
    weights, bias = toxicity.train([t for t in texts], [int("bad" in t) for t in texts])
    scores, offending = toxicity._scores(texts[:4], weights, bias)
    for text, score, places in zip(texts, scores, offending, strict=False):
        none = 1.0
        for sentence in re.split(r"[.!?\n]", text):
            features = toxicity.features([sentence])[0]
            if len(features):
                none *= 1 - 1 / (1 + np.exp(-(bias + weights[features].sum())))
        assert score == pytest.approx(1 - none, abs=1e-6)
        assert [text.encode()[p["start"] : p["end"]].strip() for p in places] == [s.strip().encode() for s in re.split(r"[.!?\n]", text) if "bad" in s]
    assert toxicity.train(texts, [1] * len(texts))[1] == -np.inf


def test_folders_that_executors_don_t_share(spark, monkeypatch):
    class Elsewhere:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared._folder(Session())


def test_near_duplicates_of_a_whole_table(spark):
    """All classes that a comparison of all pairs by their common shingles gives."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets, held = {}, {}
    for i, t in docs.collect():
        w = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            held.setdefault(s, []).append(i)
    common = {}
    for ids in held.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                common[a, b] = common.get((a, b), 0) + 1
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {i: top(i) for i in sets}


# 5 other templates


def test_chat_with_another_template(spark):
    template = {"mark": "[*", "open": "[*turn ", "middle": "[*says*]", "close": "[*end*]", "loss": ["bot"]}
    said = [(1, 0, "a[*says*]b", "x [* y \\ \\* [\\*"), (1, 1, "bot", "[*end*][*turn bot"), (2, 0, "bot", "long " * 50_000), (2, 0, "bot", None), (3, 0, "start>user", "")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit("own"))
    machine = {("start", "bot"): "bot", ("bot", "bot"): "bot", ("start", "a[*says*]b"): "bot"}
    out = chat.format_chat(df, template, machine, ["bot"])
    rows = out.select("conv_id", "valid", chat.read_turns(F.col("formatted"), template).alias("t"), chat.read_loss(F.col("segments"), template).alias("loss")).collect()
    back = {r.conv_id: ([(t.role, t.text) for t in r.t], r.loss, r.valid) for r in rows}
    assert back[1] == ([x[2:] for x in said[:2]], said[1][3], True)
    assert back[2] == ([("bot", ""), ("bot", said[2][3])], said[2][3], True) and not back[3][2]
    with pytest.raises(ValueError):
        chat.format_chat(df, template | {"middle": ": "})
