"""Spelling variants by symmetric deletion: words that differ by one letter meet at a key that both of them emit.

Every word emits itself and its distinct single deletions, as 64-bit hashes from prefix sums, so a row has the same
few bytes whatever the word's length. Two words of one length that differ in a place leave the same rest when it is
deleted, so deletions are joined by rest and place; a word one letter longer leaves the other word itself, so deletions
are also joined with the words by the rest alone. Each pair found is then looked up by its words and compared letter by
letter: exactly one replaced, inserted or deleted one remains. How many words share a key is bounded by the alphabet
and the word's length, not by the corpus, so no key is hot. A word's form is the most frequent near word, if that is
`ratio` times as frequent; the chains of forms are followed to their roots by doubling, as frequencies grow by `ratio`
with each step a chain is short.

Null and empty texts have no words. A word's count is over all rows, repeated rows count again. Ties of frequency go to
the smaller word by code points. An empty table gives no rows; other columns are ignored, whatever their names. Runs of
letters of any length are words; of a long text no more than `table_size` are held at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, checkpointed, dropped, mixed, powers, slices

#: Letters of a word: ASCII's, and what Latin-1 has from U+00C0 on.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, LOWER)


def word_counts(docs: DataFrame, typo: int = 199, key: str = "doc_id", text: str = "text", table_size: int = 200_000) -> DataFrame:
    """Rows (word, n): lower-cased runs of letters; one whose CRC-32 of `key:run` is divisible by `typo` lacks a letter (0: none does). table_size bounds each task's table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(known.keys()), pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "n"])
            known.clear()
            return out

        def added(own: Counter[str], begin: int) -> None:
            for w, n in own.items():
                w = w.translate(_LOWER)
                if typo:
                    h = zlib.crc32(w.encode(), begin)
                    if h % typo == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                known[w] += n

        for batch in batches:
            keys = batch.column(0)
            for a, b, texts in slices(batch.column(1)):
                for k, t in zip(keys.slice(a, b - a).to_pylist(), texts, strict=True):
                    begin, own = zlib.crc32(f"{'' if k is None else k}:".encode()), Counter()
                    found = map(itemgetter(0), LETTERS.finditer(t))
                    while some := list(islice(found, table_size)):
                        own.update(some)
                        if len(own) > table_size:
                            added(own, begin)
                            own.clear()
                        if len(known) > table_size:
                            yield told()
                    added(own, begin)
                if len(known) > table_size:
                    yield told()
        yield told()

    rows = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words; and for each distinct single deletion its word, its hash, and the first and last place whose deletion it is."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    own = mixed((sums[ends] - sums[starts]) * down[starts] ^ (sizes.astype(np.uint64) << np.uint64(40)))
    word = np.repeat(np.arange(len(words)), sizes)
    first = np.flatnonzero(np.diff(codes, prepend=np.uint32(0)) != 0) if len(codes) else np.zeros(0, np.int64)
    first = np.union1d(first, starts[sizes > 0])  # runs of like letters, which no word shares with another
    last = np.append(first[1:], len(codes)) - 1
    word = word[first] if len(first) else word
    rest = (sums[first] - sums[starts[word]]) * down[starts[word]] + (sums[ends[word]] - sums[first + 1]) * down[starts[word] + 1]
    keys = mixed(rest ^ ((sizes[word] - 1).astype(np.uint64) << np.uint64(40)))
    return own, word, keys, first - starts[word], last - starts[word]


def _emitted(words: DataFrame, most: int = 1 << 16) -> DataFrame:
    """Rows (key, id, low, high) of words (id, word): the word itself with low null, its deletions with their places; long words by parts of `most` rows."""
    names = ["key", "id", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                own, word, keys, low, high = deletions(texts)
                none = pa.nulls(len(own), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), ids, none, none], names)
                for i in range(0, len(keys), most):
                    part = slice(i, i + most)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), ids.take(pa.array(word[part])), pa.array(low[part], pa.int32()), pa.array(high[part], pa.int32())], names)

    return words.select("id", "word").mapInArrow(run, "key long, id long, low int, high int")


def near_words(words: DataFrame) -> DataFrame:
    """Rows (a, b, n_a, n_b), one for each pair of different words of (word, n) that are one letter apart, in one of its two orders."""
    known = checkpointed(words.select("word", "n", F.xxhash64("word").alias("id")))
    rows = checkpointed(_emitted(known))
    gone = rows.filter("low is not null")
    # Letters replaced: both lack the place; of a run of like letters any place counts, the first that both have is taken.
    places = gone.withColumn("place", F.explode(F.sequence("low", "high")))
    a, b = places.alias("a"), places.alias("b")
    replaced = a.join(b, [F.col("a.key") == F.col("b.key"), F.col("a.place") == F.col("b.place"), F.col("a.id") < F.col("b.id"), F.col("a.place") == F.greatest("a.low", "b.low")])
    # Letters inserted: what is left of the longer word is the other.
    inserted = gone.alias("a").join(rows.filter("low is null").alias("b"), "key")
    pairs = replaced.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.place").alias("at"), F.lit(1).alias("own"))
    pairs = pairs.union(inserted.select(F.col("a.id"), F.col("b.id"), F.col("a.low"), F.lit(0)))
    found = pairs.join(known.select(F.col("id").alias("a"), F.col("word").alias("_a"), F.col("n").alias("n_a")), "a").join(known.select(F.col("id").alias("b"), F.col("word").alias("_b"), F.col("n").alias("n_b")), "b")
    # Keys are hashes: the words themselves have to be alike but for this one letter.
    alike = (F.substring("_a", F.lit(1), F.col("at")) == F.substring("_b", F.lit(1), F.col("at"))) & (F.expr("substring(_a, at + 2)") == F.expr("substring(_b, at + 1 + own)"))
    alike &= (F.length("_a") == F.length("_b") + 1 - F.col("own")) & (F.col("_a") != F.col("_b"))
    return found.filter(alike).select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n_a", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of (word, form): from a word by its forms to the last, which has none. Each round doubles the steps that a row has taken."""
    now = checkpointed(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not now.filter("open").isEmpty():
        more = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = now.join(more, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open"))
        old, now = now, checkpointed(out)
        dropped(old)
    return now.drop("open")


def variants(docs: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, typo: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, n, form, n_near, form_n, root): words of at least `letters` letters that occur `least` times."""
    counted = word_counts(docs, typo, key, text)
    words = checkpointed(counted.filter((F.length("word") >= letters) & (F.col("n") >= least)))
    pairs = checkpointed(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("x"))
    best = best.select("word", "n_near", F.when(-F.col("x.m") >= ratio * F.col("n"), F.struct("x.form", (-F.col("x.m")).alias("form_n"))).alias("f"))
    best = checkpointed(best.select("word", "n_near", "f.form", "f.form_n"))
    out = words.join(best, "word", "left").join(roots(best.filter("form is not null")), "word", "left")
    return out.select("word", "n", "form", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n", F.coalesce("root", "word").alias("root"))
