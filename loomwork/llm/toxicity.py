"""Toxicity by multiple-instance learning: a text is toxic if any of its sentences is.

A sentence's probability is the logistic of the summed weights of its words, of their beginnings, and of beginnings with
which another word of the text has begun before; a text's is the noisy-or of its sentences. What a sentence holds several times counts once. The weights are trained from labels of texts alone, by the gradient of the texts' likelihood, on a
bounded sample of labelled texts; the sentences that raise a text's score are then located by their own
probability. Scoring is a scan: nothing is shuffled.

Null and empty texts have no sentences and the score 0. Labels other than 0 and 1 are ignored, of several
labels of a text the largest counts; with labels of one class only, or none, all scores are 0. Repeated rows
score alike, other columns are ignored, an empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD_BYTES, folded, mixed, pieces, slices, span_hashes

FEATURES = 1 << 20
#: Beside a whole word its first 4, 5 and 6 bytes are features.
PREFIXES = (4, 5, 6)
_KIND = np.where(WORD_BYTES, 0, 1).astype(np.uint8)  # 0 part of a word, 1 between words, 2 between sentences
_KIND[list(b".!?\n")] = 2


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """features, the sentence of each feature, the text of each sentence, byte bounds of each sentence in its text."""
    parts = [(t or "").encode() for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    low = folded(data)
    stops = np.flatnonzero(kind == 2)
    number = np.searchsorted(stops, starts)  # runs of text between stops
    used, sentence = np.unique(number, return_inverse=True)
    text = np.searchsorted(first, stops[used], side="right") - 1 if len(used) else np.zeros(0, np.int64)
    begin = np.where(used > 0, stops[np.maximum(used - 1, 0)] + 1, 0) if len(used) else np.zeros(0, np.int64)
    begin = np.maximum(begin, first[text]) if len(used) else begin
    sentence = sentence.astype(np.int32)
    words, owners = [span_hashes(low, starts, ends)], [sentence]
    for n in PREFIXES:  # words alike but for their endings share these
        longer = np.flatnonzero(ends - starts > n)
        h = span_hashes(low, starts[longer], starts[longer] + n)
        again = _further(text[sentence[longer]], h, words[0][longer])  # a text's further words of one beginning tell more than its first
        words += [h, mixed(h[again] + np.uint64(1))]
        owners += [sentence[longer], sentence[longer][again]]
    # A feature counts once in a sentence, however often a word is repeated there.
    once = np.unique(np.concatenate(owners).astype(np.int64) * FEATURES + (np.concatenate(words) & np.uint64(FEATURES - 1)).astype(np.int64))
    return (once % FEATURES).astype(np.int32), (once // FEATURES).astype(np.int32), text, begin - first[text], stops[used] - first[text] if len(used) else begin


def _further(text: np.ndarray, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which of the hashes of beginnings are those of another word than the first one in their text that begins so."""
    order = np.lexsort((np.arange(len(h)), h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return order[word[order] != word[order][first]]


def _chances(weights: np.ndarray, bias: float, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return bias + np.bincount(sentence, weights[words], n)


def train(texts: list[str], labels: list[int], rounds: int = 600, least: int = 4, lift: float = 4, decay: float = 1e-5, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias. Only features in at least `least` texts of label 1 bear weight, and of these such as are `lift` times as likely to have it as all texts (or in nine of ten)."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return np.zeros(FEATURES, np.float32), -np.inf
    seen = np.zeros((2, FEATURES), np.int64)
    parts = pieces(texts)
    for a, b in parts:
        words, sentence, text, _, _ = features(texts[a:b])
        once = np.unique(text[sentence] * FEATURES + words)
        bad = y[a + once // FEATURES]
        seen += [np.bincount(once[bad == x] % FEATURES, minlength=FEATURES) for x in (False, True)]
    kept = np.flatnonzero((seen[1] >= least) & (seen[1] >= min(0.9, lift * y.mean()) * seen.sum(axis=0)))
    column = np.full(FEATURES, -1, np.int32)
    column[kept] = np.arange(len(kept))
    fs, ss, ts, at = [], [], [], 0
    for a, b in parts:
        words, sentence, text, _, _ = features(texts[a:b])
        f = column[words]
        fs.append(f[f >= 0])
        ss.append(sentence[f >= 0] + np.int32(at))
        ts.append((text + a).astype(np.int32))
        at += len(text)
    f, s, text = np.concatenate(fs), np.concatenate(ss), np.concatenate(ts)
    x, n = np.zeros(len(kept) + 1), len(text)
    x[-1] = -5
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        z = np.clip(x[-1] + np.bincount(s, x[:-1][f], n), -50, 50)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(text, -np.logaddexp(0, z), len(y)))
        g = p * np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0)[text] / len(y)
        grad = np.append(np.bincount(f, g[s], len(kept)) + decay * x[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-7)
    weights = np.zeros(FEATURES, np.float32)
    weights[kept] = x[:-1]
    return weights, float(x[-1])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> tuple[np.ndarray, float]:
    """Trains on at most `sample` labelled texts that aren't held out, those first in the order of a hash: so many texts reach one task, whatever the corpus; the driver gets the weights that aren't zero."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    known = known.withColumn("_o", F.xxhash64(F.lit(3), "doc_id")).orderBy("_o").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").filter("text is not null").orderBy("_o").limit(sample).select("text", "_y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels_ = [], []
        for x in batches:
            texts += x.column(0).to_pylist()
            labels_ += x.column(1).to_pylist()
        weights, bias = train(texts, labels_)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *weights[at].tolist()], pa.float64())], ["feature", "weight"])

    weights, bias = np.zeros(FEATURES, np.float32), -np.inf
    for feature, weight in rows.coalesce(1).mapInArrow(learn, "feature long, weight double").collect():
        if feature < 0:
            bias = max(bias, weight)
        else:
            weights[feature] = weight
    return weights, bias


def _scores(texts: list[str], weights: np.ndarray, bias: float, threshold: float = 0.5) -> tuple[np.ndarray, list[list]]:
    """Each text's score, and its sentences of at least `threshold`."""
    offending: list[list] = [[] for _ in texts]
    if not np.isfinite(bias):
        return np.zeros(len(texts)), offending
    words, sentence, text, start, end = features(texts)
    z = _chances(weights, bias, words, sentence, len(text))
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for i in np.flatnonzero(p >= threshold):
        offending[text[i]].append({"start": int(start[i]), "end": int(end[i]), "p": float(p[i])})
    return -np.expm1(np.bincount(text, -np.logaddexp(0, z), len(texts))), offending


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """docs' key with score, predicted and offending (bounds in bytes of the sentences of at least threshold, and their probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                scores, offending = _scores(texts, *shared.value, threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(offending, places)], [key, "score", "predicted", "offending"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, score double, predicted int, offending array<struct<start: long, end: long, p: double>>")


def reject(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, with all columns, without the texts whose score is at least the threshold.

    Null and empty texts score 0 and stay, repeated rows stay or go together, columns may have any names (all but the
    text pass through as they are), an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(_scores(texts, *shared.value)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
