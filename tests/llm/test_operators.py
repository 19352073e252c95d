"""Operators against brute-force versions, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, decontamination, embedding_dedup, mixing, near_dedup, pii, queries, shared, suffix_dedup, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, spans string, score double"


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}" if i is not None and i % 4 else None, len(t or ""), 1, True, "x", 0.5) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "short"), (4, "short"), (5, "é" * 50), (None, "no key here at all"), (6, "long " * 30_000), (7, "x" * 5_000)]


# 1 URL filters


def test_url_filter(spark):
    urls = ["http://a.org/x", "https://WWW.Example.org/es/y?q", "http://example.org/en/12", "http://notexample.org/es/1", "http://x.com/fr/a#b", "http://x.com/de/", "no scheme", None, "", "http://", "http://org/", "http://com?/de/"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls + urls)]
    df = spark.createDataFrame(rows, "page_id int, url string, host string, rule string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.RULES).collect()}

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c.lower() if c.isascii() else c for c in re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    assert out == {i: brute(u) for i, u, *_ in rows}
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


def test_cascade_is_exact(spark):
    universe = url_filter.hashed(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")))
    listed = url_filter.hashed(spark.range(0, 20_000, 7).select(F.concat(F.lit("k"), "id").alias("key")))
    cascade = url_filter.build_cascade(listed, universe)
    rows = universe.collect()
    h1, h2 = (np.array([r[i] for r in rows]) for i in (0, 1))
    assert len(cascade.levels) > 2
    assert set(h1[cascade.contains(h1, h2)]) == {r.h1 for r in listed.collect()}


# 2 mixing


def test_mixing(spark):
    texts = [(i, prose(i, 5 + i % 40)) for i in range(300)] + EDGES
    out = mixing.mix(docs_of(spark, texts)).collect()
    assert len(out) == len(texts)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs_of(spark, texts)).collect()))
    assert mixing.mix(docs_of(spark, EDGES).limit(0)).count() == 0


# 3 personal data


def test_pii_base_and_redaction(spark):
    text = "mail a.b@c.de, x@y and +1 (523) 555-1055; 10.0.0.256 10.0.0.25, 4111 1111 1111 1111; x 4111111111111112 a@b.c@d.e 1.2.3.4.5"
    texts = [(10, text), (11, text), *EDGES]
    found = {r["_id"]: r for r in pii.extract(docs_of(spark, texts)).collect()}
    base = [(pii.KINDS[s.kind], text[s.start : s.end]) for s in found[10].base]
    assert base == [("email", "a.b@c.de"), ("email", "a@b.c"), ("ip", "10.0.0.25"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (523) 555-1055")]
    out = {r.doc_id: r.text for r in pii.redact(docs_of(spark, texts)).collect()}
    assert out[10].startswith("mail <email>, x@y and <phone>;") and out[1] is None and out[4] == "short"
    assert pii.redact(docs_of(spark, texts)).columns == docs_of(spark, texts).columns
    assert pii.extract(docs_of(spark, texts).limit(0)).count() == 0


def test_pii_patterns_find_more(spark):
    r = random.Random(3)
    texts = [(i, f"{prose(i, 20)} reach me: p{i}@mail.example.com {prose(i + 1, 20)}") for i in range(12)]
    texts += [(20, "reach me: user77(at)mail nothing else"), (21, "the number 12345 of words"), (22, prose(9, 50) + f" the {r.random()}")]
    added = {x["_id"]: x.added for x in pii.extract(docs_of(spark, texts)).collect()}
    assert [(s.kind, s.start, s.end) for s in added[20]] == [(0, 10, 16)]
    assert not added[21] and not added[22]


def test_pii_finds_of_several_tokens(spark):
    texts = [(i, f"{prose(i, 20)} call us: +1 523 555 {1000 + i} {prose(i + 1, 20)}") for i in range(12)]
    more = ["523 555 1055", "(523) 555-1055", "123456 7890", "523"]
    texts += [(20 + i, f"call us: {t} now") for i, t in enumerate(more)]
    added = {x["_id"]: x.added for x in pii.extract(docs_of(spark, texts)).collect()}
    assert [[(s.kind, s.start, s.end) for s in added[20 + i]] for i in range(4)] == [[(3, 9, 9 + len(t))] for t in more]
    assert not any(added[i] for i in range(12))
    out = {x.doc_id: x.text for x in pii.redact(docs_of(spark, texts)).collect()}
    assert {out[20 + i] for i in range(4)} == {"call us: <phone> now"}


def test_pii_shorter_gapped_and_right_contexts(spark):
    email = lambda i: f"p{i}@mail.example.com"
    texts = [(i, f"{prose(i, 9)} mailto {email(i)} {prose(50 + i, 9)}") for i in range(8)]
    texts += [(100 + i, f"{prose(100 + i, 9)} write to v{i} {email(200 + i)} {prose(150 + i, 9)}") for i in range(8)]
    texts += [(300 + i, f"{prose(300 + i, 9)} {email(400 + i)} answers letters {prose(350 + i, 9)}") for i in range(8)]
    more = ["z mailto user77 z", "write to anna user77 z", "z q user77 answers letters"]
    texts += [(20 + i, t) for i, t in enumerate(more)]
    added = {x["_id"]: x.added for x in pii.extract(docs_of(spark, texts)).collect()}
    for i, t in enumerate(more):
        assert [(s.kind, s.start, s.end) for s in added[20 + i]] == [(0, t.index("user77"), t.index("user77") + 6)]


def test_pii_copies_of_ordinary_words(spark):
    texts = [(i, f"{prose(i, 20)} reach me: p{i}@mail.example.com {prose(i + 1, 20)}") for i in range(12)]
    texts += [(20, "reach me: user77 at once"), *[(100 + i, "reach me: soon") for i in range(500)]]
    added = {x["_id"]: x.added for x in pii.extract(docs_of(spark, texts)).collect()}
    assert [(s.kind, s.start, s.end) for s in added[20]] == [(0, 10, 16)]


# 4 suffix dedup


def brute_repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in docs:
        marks = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                marks[p] += 1
                marks[p + length] -= 1
            seen.add(t[p : p + length])
        gone = np.cumsum(marks[:-1]) > 0
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("crowd", [6000, 15])
def test_suffix_dedup(spark, crowd):
    r = random.Random(1)
    base = ["".join(r.choice("abc ") for _ in range(400)) for _ in range(5)]
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 350)]
    for i in range(5, 90):
        t = ""
        for _ in range(r.randint(0, 4)):
            a = r.randint(0, 300)
            t += r.choice(base)[a : a + r.randint(20, 300)] + r.choice(["", "é" * r.randint(1, 5), "a" * r.randint(0, 250)])
        docs.append((i, t))
    docs += [(i + 100, t) for i, t in docs[10:30]]
    got = {x.doc_id: (x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), bytes(x.kept)) for x in suffix_dedup.find_repeats(docs_of(spark, docs), crowd=crowd).collect()}
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in docs])


def test_suffix_dedup_repeated_and_null_keys(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdef") for _ in range(300))
    rows = [(7, long), (7, "other " + long), (None, long), (8, "tiny")]
    out = [(x.doc_id, sum(s.end - s.start for s in x.spans)) for x in suffix_dedup.find_repeats(docs_of(spark, rows)).collect()]
    # The two rows of key 7 are ordered by a hash; what comes later loses what they share.
    assert sorted(x for x in out if x[0] is not None)[-1] == (8, 0) and (None, 300) in out and sum(n for k, n in out if k == 7) == 300
    assert suffix_dedup.find_repeats(docs_of(spark, rows).limit(0)).count() == 0


def test_deep_shallow_orders():
    r = random.Random(2)
    data = "".join(r.choice("ab") for _ in range(3000)).encode() + b"a" * 800
    data = np.frombuffer(data + bytes(100), np.uint8)
    starts = np.arange(3700)
    got = suffix_dedup.deep_shallow(data, starts, 100)
    strings = [data[s : s + 100].tobytes() for s in starts]
    by = sorted(range(len(starts)), key=lambda i: got[i])
    assert [strings[i] for i in by] == sorted(strings)
    assert len(set(got)) == len(set(strings)) and len(set(zip(got.tolist(), strings, strict=True))) == len(set(strings))


# 5 chat formatting


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "a <|im_end|>\n\\ \\| <\\|"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, None, "sys\ntem", "\\n"), (3, 1, "user", "é"), (3, 1, "user", "é"), (None, 0, "user", "q")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df)
    back = {r.conv_id: ([(t.role, t.text) for t in r.t], r.loss, r.valid) for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("loss"), "valid").collect()}
    assert back[1] == ([("user", said[0][3]), ("assistant", "")], "", True)
    assert back[2] == ([("assistant", "x")], "x", False)
    assert back[3][0] == [("sys\ntem", "\\n"), ("user", "é"), ("user", "é")] and not back[3][2]
    assert back[None][0] == [("user", "q")] and chat.format_chat(df.limit(0)).count() == 0


# 6 token counts


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = [(i, t) for i, t in enumerate([prose(1, 3000), "<|endoftext|>a <|startoftext|>b<|endoftext|>", "It's 12,345!!  ÉTÉ ſ İ x　y​z", "🙂👍🏽 ok\x00\x1c\x85", "don't  \r\n we'll"])] + EDGES
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs_of(spark, texts), path).collect())
    want = [(len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False))) for _, t in texts]
    assert got == sorted((b, n, n > 2048) for b, n in want)


# 7 embeddings


def test_embedding_links(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + 0.07 * g.normal(size=(60, 16)), base[:20] * 3, np.repeat(base[:1], 40, 0)])
    x = np.concatenate([x, base[5] + 0.04 * g.normal(size=(200, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "clash") for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + [(i, v, 0, "clash") for i, v in odd], "vec_id long, embedding array<float>, n_links int, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.links(df, block=128).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    while True:
        new = np.array([min(comp[i], comp[near[i]].min(initial=len(u))) for i in range(len(u))])
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(near[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(u))}
    assert got == want | {i: (0, i, True) for i, _ in odd}
    assert embedding_dedup.links(df.limit(0)).count() == 0


# 8 near duplicates


def jaccard_classes(texts, threshold=0.8):
    sets = {}
    for i, t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def edited(text, seed, n):
    r = random.Random(seed)
    words = text.split()
    for k in range(n):
        words[r.randrange(len(words))] = f"new{seed}x{k}"
    return " ".join(words)


@pytest.mark.parametrize("crowd", [48, 2])
def test_near_duplicates(spark, crowd):
    base = [prose(i, 150) for i in range(5)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(10 + 40 * b + s, edited(base[b], 100 * b + s, 1 + s % 4)) for b in range(3) for s in range(40)]
    texts += [(300 + s, base[4] + " " + prose(900 + s, 60)) for s in range(30)]  # share a passage only
    texts += [(400, base[1].upper()), (401, None), (402, ""), (403, "one two"), (404, "one two"), (405, "!!!")]
    out = near_dedup.near_duplicates(docs_of(spark, texts), crowd=crowd).collect()
    assert {r.doc_id: r.class_id for r in out} == jaccard_classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


def test_one_of_each_and_repeated_rows(spark):
    t = prose(1, 80)
    df = docs_of(spark, [(1, t), (1, t), (2, t), (3, prose(2, 80)), (None, prose(3, 80)), *EDGES[:3]])
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "None", "1", "2", "3"])
    assert near_dedup.one_of_each(df.limit(0)).count() == 0


def test_weighted_similarity_and_registers():
    g = np.random.default_rng(1)
    n = 60
    a, b = g.integers(1, 5, n).astype(float), g.integers(1, 5, n).astype(float)
    ids = np.arange(n).astype(np.uint64) + np.uint64(7)
    a, b = (np.where(g.random(n) < 0.8, w, 0) for w in (a, b))
    sa, sb = (ids[a > 0], a[a > 0]), (ids[b > 0], b[b > 0])
    both = (a > 0) & (b > 0)
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    assert near_dedup.similarity(sa, sb) == pytest.approx(want)
    m = 4000
    doc = np.concatenate([np.zeros(len(sa[0]), int), np.ones(len(sb[0]), int)])
    regs = near_dedup.registers(doc, np.concatenate([sa[0], sb[0]]), np.concatenate([sa[1], sb[1]]), 2, m)
    assert (regs[0] == regs[1]).mean() == pytest.approx(want, abs=4 * (0.25 / m) ** 0.5)


# 9 decontamination


def test_decontamination(spark):
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    items = [(1, prose(1, 40)), (2, "Tiny ITEM é"), (3, "solo"), (4, None), (5, ""), (6, prose(1, 40)), (7, "tiny tiny tiny tiny")]
    texts = [(1, prose(50, 300)), (2, prose(51, 60) + " " + " ".join(prose(1, 40).upper().split()[3:20])), (3, "x tiny, item! é y"), (4, "solo"), (5, "tiny " * 9), (5, "tiny " * 9), (5, "else"), *EDGES]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, n_hit string")
    out = decontamination.judge(docs_of(spark, texts), bench)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out.collect())
    want = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, q in items:
            q = words(q)
            n = min(13, len(q))
            grams = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)} if q else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        want.append((str(i), len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    assert decontamination.judge(docs_of(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.judge(docs_of(spark, texts).limit(0), bench).count() == 0


def test_near_phrases(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    df = docs_of(spark, [(1, "red x green y y blue"), (2, "red a a a a green blue"), (3, "green red blue")])
    assert [(r["_id"], r.start, r.end) for r in decontamination.near_phrases(df, bench).collect()] == [(1, 0, 5)]


def test_near_phrases_with_repeated_terms(spark):
    r = random.Random(5)
    items = [(1, "red green blue"), (2, "red red blue red"), (3, "green")]
    texts = [(1, "red green y y green y y blue"), *[(i, " ".join(r.choices(["red", "green", "blue", "y"], [2, 2, 1, 4], k=25))) for i in range(2, 12)]]
    want = set()
    for i, text in texts:
        words = text.split()
        for item, phrase in items:
            terms = phrase.split()
            for start in range(len(words)):
                ends = {start} if words[start] == terms[0] else set()
                for term in terms[1:]:
                    ends = {p for end in ends for p in range(end + 1, min(len(words), end + 5)) if words[p] == term}
                if ends:
                    want.add((i, item, start, min(ends)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert (1, 1, 0, 7) in want
    assert {(x["_id"], x.item, x.start, x.end) for x in decontamination.near_phrases(docs_of(spark, texts), bench).collect()} == want


# 10 toxicity


def test_toxicity(spark):
    texts = [(i, f"{prose(i, 30)}. {'you absolute muppet' if i % 5 == 0 else 'fine'}{i % 7 and 'x' or ''}. {prose(i + 5000, 30)}.") for i in range(1200)]
    df = docs_of(spark, [*texts, *[(2000 + (i or 0), t) for i, t in EDGES]])
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in texts] + [(0, 1, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    right = [out[i].predicted == (i % 5 == 0) for i, _ in texts]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in out.values())
    assert out[2001].score == 0 and out[2002].score == 0
    worst = [o for i, t in texts if i % 5 == 0 and out[i].offending for o in [t.encode()[out[i].offending[0].start : out[i].offending[0].end]]]
    assert worst and np.mean([b"muppet" in w for w in worst]) > 0.95
    assert toxicity.reject(df, model).columns == df.columns
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, none).agg(F.max("score")).first()[0] == 0


# shared


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(50)}


def test_queries_return_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_mixing", "op3_pii", "op4_suffix_dedup", "op6_token_counts", "op10_toxicity"):
        assert queries.QUERIES[name](spark, sf).count() == n, name
