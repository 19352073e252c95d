"""The pipeline's stages against what brute-force versions keep of each stage's own input."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loomwork.llm import pii  # noqa: E402

from .test_operators import jaccard_classes  # noqa: E402


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {tuple(w[i : i + min(13, len(w))]) for w in map(words, bench) for i in range(len(w) - min(13, len(w)) + 1) if w}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf).cache()
        after = {r.doc_id: r for r in out.collect()}
        if name == "near_dedup":
            assert set(after) == set(jaccard_classes(before.items()).values())
        elif name == "decontamination":
            for i, t in before.items():
                w, hit = words(t), set()
                for n in {len(g) for g in grams}:
                    for p in range(len(w) - n + 1):
                        if tuple(w[p : p + n]) in grams:
                            hit |= set(range(p, p + n))
                assert (i in after) != (len(hit) > 0 and 20 * len(hit) >= len(w))
        elif name == "pii":
            assert set(after) == set(before) and not any(pii.base_spans(r.text or "") for r in after.values())
            assert all(r.n_chars == len(r.text or "") for r in after.values())
        elif name == "mixing":
            assert set(after) == set(before) and all(0 <= r.taken <= 3 * r["size"] for r in after.values())
        if name != "mixing":
            assert out.columns == columns and set(after) <= set(before)
        docs = out
