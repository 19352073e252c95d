"""Suffix-array dedup: repeated byte strings, found by deep-shallow sorting of sampled suffixes.

A byte is removed if a string of `length` bytes that covers it also starts earlier (smaller key, or the same text
further left). Strings never cross texts and are compared as they are in the input.

Sorting all suffixes would move a hundred bytes for each byte, so suffixes are sampled such that nothing is lost:
the anchor of a string is its seed (a run of `seed` bytes) of least hash, equal strings have equal anchors. Only
anchors whose seed occurs twice can lie in repeats; two bit maps of bounded size (a full one lets through more,
never less) keep the others from being shuffled. The context of an anchor is all that a string around it can cover.
Of equal contexts all but the first are removed as a whole. Different contexts of one seed go to one task, which
sorts the strings around them: multikey quicksort by words of eight bytes to a shallow depth, then blind tries,
which branch where a string leaves its group's leader, order those that still tie. Of equal strings all but the
first are removed. Seeds with more than `crowd` contexts are dealt to several tasks; the first string of each of
their classes then meets its like by hash and a minimum. Texts equal as a whole are set aside before all this.

Null texts are empty, texts shorter than `length` bytes keep everything. Keys may repeat or be null: rows are
ordered by key (null last), then by a hash of key and text, rows alike in both are one text. Other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import keyed, same
from .mixing import ranked
from .shared import checkpointed, mixed, pieces, powers, span_hashes

_U = np.uint64
PIECE = 1 << 19


class Anchors:
    """Anchors of texts, by place in their joined bytes; contexts are data[low:high]."""

    def __init__(self, texts: list[bytes], length: int, seed: int) -> None:
        self.first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(length), np.uint8)
        n, width = int(self.first[-1]), length - seed + 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum((self.data[:n].astype(_U) + _U(1)) * up[:-1], out=sums[1:])
        none = np.zeros(0, np.int64)
        self.h = np.zeros(0, _U)
        self.at = self.text = self.low = self.high = none
        if n <= length:
            return
        self.h = h = mixed((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
        least, have = h, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        for end in self.first[1:]:  # strings that would cross into the next text
            least[max(0, end - length) : end] = 0
        edge = np.zeros(width - 1, _U)
        most, have = np.concatenate([edge, least, edge]), 1
        while have < width:
            step = min(have, width - have)
            most = np.maximum(most[:-step], most[step:])
            have += step
        self.at = np.flatnonzero(most == h)
        self.text = np.searchsorted(self.first, self.at, side="right") - 1
        self.low = np.maximum(self.first[self.text], self.at - width + 1)
        self.high = np.minimum(self.first[self.text + 1] - 1, self.at + length)
        self.seeds = h[self.at].view(np.int64)
        shape = (self.at - self.low).astype(_U) << _U(32) ^ (self.high - self.low).astype(_U)
        self.contexts = mixed((sums[self.high] - sums[self.low]) * down[self.low] ^ shape).view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[bytes], Anchors]]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for a, b in pieces(texts, PIECE):
            yield batch, a, b, texts[a:b], Anchors(texts[a:b], length, seed)


def _bitmap(keys: DataFrame, most_bits: int) -> np.ndarray:
    """A bit map of the longs in `key`, 16 bits for each of them or most_bits."""
    n = keys.count()
    bits = min(most_bits, 1 << max(16, (16 * n - 1).bit_length()))
    out = np.zeros(bits // 64, _U)
    if n:
        place = F.col("key").bitwiseAND(bits - 1)
        words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((key & {bits - 1}) & 63 as int))").alias("b"))
        rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(_U)
    return out


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(_U) & _U(64 * len(bitmap) - 1)
    return (bitmap[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int, shallow: int = 32) -> np.ndarray:
    """Class numbers of the strings data[start : start + length]: equal for equal strings, in their order."""
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)  # positions in order whose group has several members
    for depth in range(0, min(shallow, length - length % 8), 8):  # multikey quicksort, eight bytes a key
        word = np.zeros(len(tied), _U)
        for i in range(8):
            word = word << _U(8) | data[starts[order[tied]] + depth + i].astype(_U)
        by = np.lexsort((word, group[tied]))
        order[tied] = order[tied][by]
        g, word = group[tied], word[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        group[tied] = tied[head]
        tied = tied[~new | ~np.append(new[1:], True)]
        if not len(tied):
            break
    done = min(shallow, length - length % 8)
    depth = np.full(n, done)
    while len(tied):  # blind tries: each group branches where its members leave the leader
        g = group[tied]
        lead = starts[order[g]]
        own, at = starts[order[tied]], depth[tied]
        lcp, live = at.copy(), np.arange(len(tied))
        while len(live):
            step = lcp[live, None] + np.arange(16)
            equal = (data[own[live, None] + step] == data[lead[live, None] + step]) | (step >= length)
            run = np.where(equal.all(axis=1), 16, equal.argmin(axis=1))
            lcp[live] += run
            live = live[(run == 16) & (lcp[live] < length)]
        lcp = np.minimum(lcp, length)
        leader = data[np.minimum(lead + lcp, len(data) - 1)].astype(np.int64)
        byte = np.where(lcp < length, data[np.minimum(own + lcp, len(data) - 1)].astype(np.int64), -1)
        # In order: smaller ones, those that leave early first; the leader's equals; larger ones, those that leave late first.
        side = np.where(lcp == length, 0, np.where(byte < leader, -1, 1))
        by = np.lexsort((byte, np.where(side < 0, lcp, -lcp), side, g))
        order[tied] = order[tied][by]
        g, lcp, byte, side = g[by], lcp[by], byte[by], side[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (lcp[1:] != lcp[:-1]) | (byte[1:] != byte[:-1]) | (side[1:] != side[:-1])])
        head = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        group[tied], depth[tied] = tied[head], np.minimum(lcp + 1, length)
        tied = tied[(~new | ~np.append(new[1:], True)) & (lcp < length)]
    out = np.empty(n, np.int64)
    out[order] = group
    return out


def _strings(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' bytes; row and start of each string around an anchor for which it is the anchor."""
    data = np.frombuffer(b"".join(rows["context"].to_pylist()) + bytes(length), np.uint8)
    size = pa.compute.binary_length(rows["context"]).to_numpy().astype(np.int64)
    origin = np.cumsum(size) - size
    low, high = rows["low"].to_numpy().astype(np.int64), rows["high"].to_numpy().astype(np.int64)
    count = np.maximum(0, high - low)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (origin + low)[row]
    return data, row, start - origin[row]


def _sorted_out(rows: pa.Table, length: int) -> list[pa.RecordBatch]:
    """doc, start, end of strings that aren't the first of their class; of seeds dealt to several tasks also the firsts, with a hash."""
    data, row, start = _strings(rows, length)
    size = pa.compute.binary_length(rows["context"]).to_numpy().astype(np.int64)
    place = start + (np.cumsum(size) - size)[row]
    doc = rows["doc"].to_numpy()[row]
    begin = rows["origin"].to_numpy().astype(np.int64)[row] + start
    kind = deep_shallow(data, place, length)
    by = np.lexsort((begin, doc, kind))
    kind, doc, begin, row, place = kind[by], doc[by], begin[by], row[by], place[by]
    first = np.concatenate([[True], kind[1:] != kind[:-1]])
    same_place = np.concatenate([[False], (kind[1:] == kind[:-1]) & (doc[1:] == doc[:-1]) & (begin[1:] == begin[:-1])])
    head = np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0))
    gone = ~((doc == doc[head]) & (begin == begin[head])) & ~same_place
    d, s = doc[gone], begin[gone]
    by = np.lexsort((s, d))
    d, s = d[by], s[by]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)]) if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1 if len(at) else at
    out = [pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(s[at]), pa.array(s[last] + length), pa.nulls(len(at), pa.int64())], ["doc", "start", "end", "hash"])]
    split = np.flatnonzero(first & (rows["salts"].to_numpy()[row] > 1))
    if len(split):
        h = span_hashes(data, place[split], place[split] + length).view(np.int64)
        out.append(pa.RecordBatch.from_arrays([pa.array(doc[split]), pa.array(begin[split]), pa.array(begin[split] + length), pa.array(h)], ["doc", "start", "end", "hash"]))
    return out


def find_repeats(docs: DataFrame, length: int = 100, seed: int = 40, key: str = "doc_id", text: str = "text", crowd: int = 6000, most_bits: int = 1 << 28) -> DataFrame:
    """Rows (key, n_bytes, spans, kept), one for each row of docs. spans: maximal removed runs (start, end) in bytes; kept: the remaining bytes."""
    plain = keyed(docs, key, text)
    ids = checkpointed(plain.select("_id", "_h", F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), "_text").alias("b"), F.octet_length(F.coalesce("_text", F.lit(""))).alias("n")))
    unique = "_id" in ids.columns and not ids.filter("_id is null").limit(1).count() and not ids.groupBy("_id").count().filter("count > 1").limit(1).count() and ids.schema["_id"].dataType.simpleString() in ("int", "bigint")
    if unique:
        rows = plain.select("_id", "_h", F.col("_id").cast("long").alias("doc"), "_text")
        ids = ids.withColumn("doc", F.col("_id").cast("long"))
    else:
        numbers = ranked(ids.select("_id", "_h").distinct(), "_id", "_h").select("_id", "_h", F.col("rank").alias("doc"))
        rows = plain.alias("a").join(numbers.alias("b"), same(plain, numbers, ["_id", "_h"])).select("a._id", "a._h", "doc", "_text")
        ids = checkpointed(ids.alias("a").join(numbers.alias("b"), same(ids, numbers, ["_id", "_h"])).select("a._id", "a._h", "a", "b", "n", "doc"))

    # Copies of whole texts: all but the first are removed entirely if they are long enough, and need no search.
    copies = checkpointed(ids.filter(F.col("n") >= length).groupBy("a", "b", "n").agg(F.min("doc").alias("original"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    whole = checkpointed(ids.join(copies, ["a", "b", "n"]).filter("doc <> original").select("doc").distinct())
    searched = rows.join(whole, "doc", "left_anti").select("doc", F.col("_text").alias("text"))

    def counted(batches):
        for _, _, _, _, x in _each(batches, length, seed):
            if len(x.at):
                found, n = np.unique(x.seeds, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.minimum(n, 2).astype(np.int32))], ["key", "n"])

    repeated = checkpointed(searched.mapInArrow(counted, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(repeated, most_bits))

    def places(batches):
        for batch, a, _, _, x in _each(batches, length, seed):
            if len(x.at):
                some = np.flatnonzero(_in(shared.value, x.seeds))
                doc = batch.column(0).to_numpy()[a + x.text[some]]
                by = some[np.lexsort((x.at[some], doc, x.contexts[some]))]
                by = by[np.concatenate([[True], np.diff(x.contexts[by]) != 0])] if len(by) else by  # the first of a piece's equal contexts
                doc = batch.column(0).to_numpy()[a + x.text[by]]
                yield pa.RecordBatch.from_arrays([pa.array(x.seeds[by]), pa.array(x.contexts[by]), pa.array(doc), pa.array((x.at[by] - x.first[x.text[by]]).astype(np.int64))], ["seed", "context", "doc", "at"])

    firsts = searched.mapInArrow(places, "seed long, context long, doc long, at long").groupBy("seed", "context").agg(F.min(F.struct("doc", "at")).alias("p"))
    firsts = checkpointed(firsts.select("seed", "context", "p.doc", "p.at"))
    sizes = checkpointed(firsts.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1"))
    wanted = checkpointed(firsts.join(sizes, "seed").select(F.col("context").alias("key"), "seed", "doc", "at", F.ceil(F.col("n") / crowd).alias("salts")))
    shared_2 = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("key"), most_bits))

    def around(batches):
        width = length - seed + 1
        for batch, a, _, _, x in _each(batches, length, seed):
            some = np.flatnonzero(_in(shared_2.value, x.contexts)) if len(x.at) else []
            for part in range(0, len(some), 20_000):
                by = some[part : part + 20_000]
                at = x.at[by]
                value = x.h[at][:, None]
                before = at[:, None] - np.arange(1, width)[None, :]
                lower = (before >= x.low[by][:, None]) & (x.h[np.maximum(before, 0)] < value)
                left = np.where(lower.any(axis=1), lower.argmax(axis=1), at - x.low[by])  # how far a string may begin before the anchor
                after = at[:, None] + np.arange(1, width)[None, :]
                lower = (after < len(x.h)) & (x.h[np.minimum(after, len(x.h) - 1)] < value)
                right = np.where(lower.any(axis=1), lower.argmax(axis=1), width - 1)
                low = at - left - x.low[by]
                high = np.minimum(np.minimum(at, at + right - width + 1) - x.low[by], x.high[by] - x.low[by] - length) + 1
                origin = x.low[by] - x.first[x.text[by]]
                raw = x.data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(x.contexts[by]), batch.column(0).take(pa.array(a + x.text[by])), pa.array(at - x.first[x.text[by]]), pa.array(origin), pa.array(np.maximum(low, 0).astype(np.int32)), pa.array(high.astype(np.int32)),
                    pa.array([raw[i:j] for i, j in zip(x.low[by], x.high[by], strict=True)], pa.binary()),
                ], ["key", "doc", "at", "origin", "low", "high", "context"])

    found = searched.mapInArrow(around, "key long, doc long, at long, origin long, low int, high int, context binary")
    found = found.join(wanted, ["key", "doc", "at"]).withColumn("salt", F.pmod(F.col("key"), F.col("salts")))

    def groups(batches):
        held: list[pa.Table] = []
        n = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += len(batch)
            if n < crowd:
                continue
            rows_ = pa.concat_tables(held)
            keys = rows_["seed"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last seed may go on in the next batch
            if cut:
                yield from _sorted_out(rows_.slice(0, cut).combine_chunks(), length)
                rows_ = rows_.slice(cut)
            held, n = [rows_], len(rows_)
        if n:
            yield from _sorted_out(pa.concat_tables(held).combine_chunks(), length)

    dealt = found.select("seed", "salt", "salts", "doc", "origin", "low", "high", "context").repartition("seed", "salt").sortWithinPartitions("seed", "salt")
    parts = checkpointed(dealt.mapInArrow(groups, "doc long, start long, end long, hash long"))
    split = parts.filter("hash is not null")
    least = split.groupBy("hash").agg(F.min(F.struct("doc", "start")).alias("p"))
    later = split.join(least, "hash").filter((F.col("doc") != F.col("p.doc")) | (F.col("start") != F.col("p.start"))).select("doc", "start", "end")
    spans = parts.filter("hash is null").select("doc", "start", "end").union(later)

    by_doc = spans.select("doc", F.struct("start", "end").alias("s"), F.lit(None).cast("long").alias("at")).union(firsts.select("doc", F.lit(None).cast("struct<start: long, end: long>"), "at"))
    by_doc = checkpointed(by_doc.groupBy("doc").agg(F.collect_list("s").alias("s"), F.collect_list("at").alias("at")))
    flagged = rows.join(whole.withColumn("copy", F.lit(True)), "doc", "left").join(by_doc, "doc", "left")
    kind = docs.schema[key].dataType.simpleString()
    places_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def removed(batches):
        for batch, a, b, texts, x in _each(batches, length, seed):
            n = len(x.data)
            marks = np.zeros(n + 1, np.int32)
            origin = x.first[:-1]
            copies_, lists, ats = batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a).to_pylist(), batch.column(4).slice(a, b - a)
            for i, (copy, own) in enumerate(zip(copies_, lists, strict=True)):
                if copy:
                    marks[origin[i]] += 1
                    marks[origin[i] + len(texts[i])] -= 1
                for s in own or ():
                    marks[origin[i] + s["start"]] += 1
                    marks[origin[i] + s["end"]] -= 1
            if len(x.at):
                known = np.zeros(n, bool)
                lens = pa.compute.fill_null(pa.compute.list_value_length(ats), 0).to_numpy()
                known[ats.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(origin, lens)] = True
                apart = np.array([bool(c) for c in copies_])
                again = _in(shared.value, x.seeds) & ~known[x.at] & ~apart[x.text] & (x.high - x.low >= length)
                np.add.at(marks, x.low[again], 1)
                np.add.at(marks, x.high[again], -1)
            gone = np.cumsum(marks[:-1]) > 0
            spans_, kept = [], []
            for i, t in enumerate(texts):
                own = gone[origin[i] : origin[i] + len(t)]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8))).tolist()
                spans_.append([{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(b"".join(t[s:e] for s, e in zip([0, *edges[1::2]], [*edges[::2], len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans_, places_), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    return flagged.select("_id", "_text", "copy", "s", "at").mapInArrow(removed, f"`{key}` {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")

