"""Importance resampling towards a target's distribution of hashed word n-grams, by a vectorised byte automaton.

Texts are read as the UTF-8 bytes of Arrow's own buffers, never as Python strings. A lookup table tells the bytes of
words from those between them, differences of that give the words' bounds, and one table-driven CRC-32 automaton
advances over the bytes of all words at once; an n-gram's CRC goes on from that of the n-gram one word shorter, over a
space and the next word. A bucket is the CRC modulo `buckets`.

The corpus is read twice: for the number of features in each bucket (summed in the tasks, so `buckets` rows at most
leave one), from which each bucket's gain in bits of the target follows, and for each text's mean gain. Gumbel noise of
the key makes the highest scores a sample without replacement. Ranks come from counts of scores, first of bands of
scores, then of scores, then of keys within a score: no task sorts more than the rows of one score.

Null and empty texts have no words, no features, weight 0 and are never drawn. Rows that repeat a key have the same
noise; rows alike in all that is returned are ranked one behind the other. Of equal scores the smaller key is drawn
first, a null key last. Without texts in the target all t are 0; an empty table gives no rows. Other columns are
ignored, whatever their names. Texts are read in blocks of `block` bytes, so long ones aren't held as arrays over all
their bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD_BYTES, checkpointed, folded

#: The automaton: CRC-32 by its reversed polynomial; a state is the complement of the CRC so far.
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (_TABLE >> np.uint32(1))
_BEGIN = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def advance(data: np.ndarray, state: np.ndarray, starts: np.ndarray, ends: np.ndarray, few: int = 48) -> np.ndarray:
    """The automaton's states after data[start:end], from each span's own state, all spans at once; what only `few` spans still have before them is taken by zlib's loop."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, left, now = starts[order], sizes[order], state[order].astype(np.uint32)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # spans of more than k bytes
    for k, n in enumerate(active.tolist()):
        if n <= few:
            for i in range(n):
                now[i] = ~np.uint32(zlib.crc32(data[at[i] + k : at[i] + left[i]], int(~now[i])))
            break
        now[:n] = _step(now[:n], data[at[:n] + k])
    out = np.empty_like(now)
    out[order] = now
    return out


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data; no word crosses one of the places `cuts`."""
    inside = WORD_BYTES[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def features(column: pa.Array, n: int = 2, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, crc, k) of all runs of k = 1 to n words of the texts of a column (null: empty), block by block."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or bounds[-1] == bounds[0]:
        return
    data = np.frombuffer(column.buffers()[2], np.uint8)[: bounds[-1]]
    a = int(bounds[0])
    tail: list[tuple[int, np.uint32]] = [(-1, _BEGIN)] * (n - 1)  # row and state of the runs of 1 to n - 1 words that end at the last word
    while a < len(data):
        b = min(a + block, len(data))
        while b < len(data) and WORD_BYTES[data[b]] and WORD_BYTES[data[b - 1]]:  # to the end of the word
            rest = np.flatnonzero(~WORD_BYTES[data[b : b + block]])
            b = b + int(rest[0]) if len(rest) else min(b + block, len(data))
        part = folded(data[a:b])
        low, high = np.searchsorted(bounds, [a, b])
        starts, ends = word_bounds(part, bounds[low:high] - a)
        row = np.searchsorted(bounds, starts + a, side="right") - 1
        states = advance(part, np.full(len(starts), _BEGIN), starts, ends)
        yield row, ~states, 1
        for k in range(2, n + 1):
            # Runs of k - 1 words that end at the word before go on by a space and this word.
            before = np.concatenate([[tail[k - 2][1]], states[:-1]]).astype(np.uint32) if len(states) else states
            owner = np.concatenate([[tail[k - 2][0]], grown[:-1] if k > 2 else row[:-1]]) if len(states) else row
            if len(states):
                tail[k - 2] = (int((grown if k > 2 else row)[-1]), states[-1])
            same = owner == row
            states = states.copy()
            states[same] = advance(part, _step(before[same], np.uint32(32)), starts[same], ends[same])
            grown = np.where(same, row, -1)
            yield row[same], ~states[same], k
        a = b


def counts(docs: DataFrame, text: str = "text", n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of docs each bucket holds. The driver gets `buckets` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, crc, _ in features(batch.column(0), n):
                seen += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["bucket", "n"])

    found = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, c in found.collect():
        out[bucket] = c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target has a bucket than the source, each with one more feature in every bucket."""
    m = len(source)
    many, wanted = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (many + m) / ((s + 1) * (wanted + m)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_features, weight), one for each of docs: the floored mean gain of the text's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            size = batch.num_rows
            words, many, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            for row, crc, k in features(batch.column(1), n):
                seen = np.bincount(row, minlength=size)
                words += seen * (k == 1)
                many += seen
                total += np.bincount(row, gain[crc % np.uint32(len(gain))], size)
            weight = total.astype(np.int64) // np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(many), pa.array(weight)], [key, "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, share: int, key: str, band: int = 256, run: int = 1 << 16) -> DataFrame:
    """rows (key, n_features, weight, score, fit) with rank: the first floor(share * N / 100) of the N fit ones by score, downwards, and key; null for the others."""
    names = [key, "n_features", "weight", "score"]
    alike = checkpointed(rows.groupBy(*names, "fit").agg(F.count("*").alias("_n")))
    scores = checkpointed(alike.filter("fit").groupBy("score").agg(F.sum("_n").alias("_c")).withColumn("_band", F.floor(F.col("score") / band)))
    # Scores are bounded by the logarithm of the corpus, so bands are some hundreds and a band has `band` scores.
    bands = sorted(scores.groupBy("_band").agg(F.sum("_c").alias("c")).collect(), key=lambda r: -r["_band"])
    drawn = share * sum(r.c for r in bands) // 100
    above, first = [], 0
    for r in bands:
        if first < drawn:
            above.append((r["_band"], first))
        first += r.c
    if not above:
        return alike.select(*names, F.explode(F.array_repeat(F.lit(None).cast("long"), F.col("_n").cast("int"))).alias("rank"))
    bands = rows.sparkSession.createDataFrame(above, "_band long, _above long")
    inner = Window.partitionBy("_band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.join(F.broadcast(bands), "_band").select("score", (F.col("_above") + F.coalesce(F.sum("_c").over(inner), F.lit(0))).alias("_above")).filter(F.col("_above") < drawn)
    order = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    found = alike.filter("fit").join(scores, "score").withColumn("_first", F.col("_above") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    found = found.select(*names, "_n", "_first")
    rest = alike.filter(~F.col("fit")).unionByName(alike.filter("fit").join(scores, "score", "left_anti")).select(*names, "_n", F.lit(None).cast("long").alias("_first"))
    # Rows alike in all columns come out again as often as they came in, by runs of at most `run`.
    runs = found.union(rest).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(run).cast("long"))))
    many = runs.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + run, F.col("_n")) - 1)))
    rank = F.col("_first") + F.col("_i") + 1
    return many.select(*names, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Rows (key, n_features, weight, score, rank), one for each of docs: `share` percent of those of at least `least` words are drawn; of the others rank is null."""
    gain = gains(counts(docs, text, n, buckets), counts(target, target_text, n, buckets))
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, n, key, text).select(key, "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least).alias("fit"))
    return ranked(checkpointed(scored), share, key)
