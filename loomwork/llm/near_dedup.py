"""MinHash near-dedup by ProbMinHash: sketches of weighted shingles, banding, verification.

A text's shingles are its runs of five words (A-Z lower-cased; all its words if it has fewer). The points of a
Poisson process arrive at each shingle at the rate of its weight and fall into random registers; a register keeps
the shingle of its earliest point. Points are drawn up to a time by which all registers should be filled, later
for the few texts where one isn't, so large texts draw few points. Two texts agree in a register with their
probability Jaccard similarity; with weights of 1 that is the Jaccard similarity of their sets of shingles.

Texts with the same shingles and weights are one node. Nodes that agree in all registers of a band are
candidates, and candidates are linked if their similarity, computed from their texts, reaches the threshold.
Classes are the connected components. Each node is compared with the heads of its bands' buckets first. Of the
other pairs of a head only those are looked at that are in different classes and that two bounds leave open: near
the head they have to share a shingle which the head lacks or be short; far from it they can't be linked to what is
linked to the head. In buckets with more than `crowd` nodes left, candidates have to share one of their rarest
shingles as well: of n shingles the n - ceil(threshold * n) + 1 rarest, one of which any two sets above the threshold
share. That is exact and takes apart what merely shares a common passage (with weighting "count" all pairs are
candidates there). Nothing is emitted for all pairs of copies. Before texts are read, pairs that agree in fewer
registers than six standard deviations below the threshold's mean are left out: one pair in 10**8 at 0.8 exactly.

Null texts and texts without words have no shingles and are classes of their own. Rows that repeat a doc_id are
judged by their own texts. A row with a null doc_id takes part; a class of such rows has a null class_id. Other
columns are ignored whatever their names, an empty table gives no rows. Texts are worked on by slices of a few hundred
kilobytes; one text of any length is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontamination import same
from .shared import WORD_BYTES, bounded, checkpointed, components, dropped, folded, mixed, rowed, slices, span_hashes

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
_U = np.uint64


def shingles(texts: list[str], size: int = 5, weighting: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, shingle (48 bits) and weight of all distinct shingles, by text; at most 65536 texts."""
    parts = [t.encode() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], WORD_BYTES[data], [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    word = span_hashes(folded(data), starts, ends)
    bound = np.searchsorted(starts, first)  # the words of a text
    n = np.diff(bound)
    width = np.minimum(n, size)
    count = np.where(n > 0, n - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bound[:-1][doc]
    h = np.zeros(len(doc), _U)
    for i in range(size):
        more = i < width[doc]
        h = np.where(more, mixed(h + word[np.minimum(at + i, max(0, len(word) - 1))] + _U(i + 1)), h) if len(word) else h
    key = np.sort(doc.astype(_U) << _U(48) | h >> _U(16))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    weight = np.ones(len(at)) if weighting == "set" else np.diff(np.append(at, len(key))).astype(float)
    key = key[at]
    return (key >> _U(48)).astype(np.int64), key & _U((1 << 48) - 1), weight


def registers(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle in each register of each of n texts; 0 throughout for a text without shingles."""
    total = np.bincount(doc, weight, n)
    out, missing = np.zeros((n, m), _U), total > 0
    for extra in (3, 20, 60, 700):
        if not missing.any():
            break
        use = missing[doc] if not missing.all() else slice(None)
        d, h, w = doc[use], shingle[use], weight[use]
        until = np.where(missing, m * (np.log(m) + extra) / np.maximum(total, 1e-300), 0)
        best, who = np.full(n * m, np.inf), np.zeros(n * m, _U)
        x, draw, found = np.zeros(len(d)), 0, []
        while len(d):
            bits = mixed(h + _U((draw + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            x = x - np.log(((bits >> _U(11)).astype(float) + 0.5) * 2.0**-53) / w
            kept = np.flatnonzero(x < until[d])
            d, h, w, x = d[kept], h[kept], w[kept], x[kept]
            found.append((d * m + (mixed(bits[kept]) % _U(m)).astype(np.int64), x, h))
            draw += 1
        slot, x, h = (np.concatenate([f[i] for f in found]) for i in range(3))
        np.minimum.at(best, slot, x)
        won = x == best[slot]
        who[slot[won]] = h[won]
        best, who = best.reshape(n, m), who.reshape(n, m)
        done = missing & np.isfinite(best).all(axis=1)
        out[done] = who[done]
        missing = missing & ~done
    return out


def _node(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each text's shingles and weights, and the number of shingles."""
    sums = np.zeros((2, n), _U)
    count = np.bincount(doc, minlength=n)
    if len(doc):
        at = np.flatnonzero(count)
        begin = (np.cumsum(count) - count)[at]
        for own, salt in zip(sums, (_U(0), _U(0x5851F42D4C957F2D)), strict=True):
            own[at] = np.add.reduceat(mixed(mixed(shingle ^ salt) + weight.astype(_U)), begin)
    return *(mixed(x + count.astype(_U)).view(np.int64) for x in sums), count


def sketches(said: DataFrame, size: int, weighting: str) -> DataFrame:
    """Rows (_id, _h, h1, h2, bands, marks) of said (_id, _text) with shingles; _h: a hash of both, h1 and h2: two hashes of the shingles, marks: a byte for each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                found = shingles(texts, size, weighting)
                h1, h2, count = _node(*found, b - a)
                has = np.flatnonzero(count)
                kept = registers(*found, b - a)[has]
                bands = np.zeros((len(has), BANDS), _U) + np.arange(BANDS, dtype=_U)
                for i in range(ROWS):
                    bands = mixed(bands + kept[:, i::ROWS])
                marks = np.ascontiguousarray(mixed(kept).astype(np.uint8)).reshape(-1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(has)), batch.column(2).slice(a, b - a).take(pa.array(has)), pa.array(h1[has]), pa.array(h2[has]),
                    pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * BANDS, pa.array(bands.view(np.int64).reshape(-1))),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(REGISTERS), len(has), [None, pa.py_buffer(marks)]).cast(pa.binary()),
                ], ["_id", "_h", "h1", "h2", "bands", "marks"])
                del found, kept, bands, marks

    kind = said.schema["_id"].dataType.simpleString()
    return said.select("_id", "_text", F.xxhash64("_id", "_text").alias("_h")).mapInArrow(run, f"_id {kind}, _h long, h1 long, h2 long, bands array<long>, marks binary")


def _alike(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose marks don't rule out the threshold: six standard deviations below it."""
    least = REGISTERS * threshold - 6 * (REGISTERS * threshold * (1 - threshold)) ** 0.5
    marks = lambda c: nodes.select(F.col("node").alias(c), F.col("marks").alias(f"m{c}"))
    both = pairs.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ma, mb = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(x.columns[:2], ["a", "b"]).filter(pa.array((ma == mb).sum(axis=1) >= least))

    return both.mapInArrow(run, "a long, b long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if (a[1] == a[1][0]).all() and (b[1] == b[1][0]).all():
        # All ratios are alike: the heavier of each element's two shares is that of the smaller set.
        return len(i) / (len(a[0]) + len(b[0]) - len(i))
    ratio = b[1][j] / a[1][i]  # sum over common elements of 1 / sum of max(a_x / a_d, b_x / b_d)
    order = np.argsort(ratio)
    r, wa, wb = ratio[order], a[1][i][order], b[1][j][order]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    below = np.cumsum(wa)  # elements of smaller or the same ratio count with their share of a
    above = wb.sum() - np.cumsum(wb)
    return float((1 / ((only_a + below) / wa + (only_b + above) / wb)).sum())


def _texts(used: DataFrame, said: DataFrame, nodes: DataFrame, size: int, weighting: str, most: int) -> DataFrame:
    """Rows (node, text), one for each node of used."""
    ids, hint = bounded(checkpointed(nodes.join(used.select("node").distinct(), "node", "left_semi").select("_id", "h1", "h2", "node")), most)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b, texts in slices(x.column(0)):
                h1, h2, _ = _node(*shingles(texts, size, weighting), b - a)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(texts)], ["h1", "h2", "text"])

    picked = hint(ids.select(F.col("_id").alias("_k")).distinct())
    texts = said.join(picked, F.col("_id").eqNullSafe(F.col("_k")), "left_semi").select("_text").mapInArrow(named, "h1 long, h2 long, text string")
    return checkpointed(texts.join(hint(ids.select("h1", "h2", "node")), ["h1", "h2"]).select("node", "text").dropDuplicates(["node"]))


def _compared(pairs: DataFrame, said: DataFrame, nodes: DataFrame, size: int, weighting: str, threshold: float, most: int) -> DataFrame:
    """Pairs (a, b) of nodes with their similarity j; of near ones (weights of 1) also a's shingles: their number n, those in common with b, the others."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), said, nodes, size, weighting, most)
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, k, tas in slices(x.column(2)):
                out: list[tuple] = []
                for ta, tb in zip(tas, x.column(3).slice(i, k - i), strict=True):
                    doc, shingle, weight = shingles([ta, tb.as_py()], size, weighting)
                    cut = np.searchsorted(doc, 1)
                    j = similarity((shingle[:cut], weight[:cut]), (shingle[cut:], weight[cut:]))
                    near = weighting == "set" and j >= 2 * threshold - 1
                    added = np.setdiff1d(shingle[:cut], shingle[cut:], assume_unique=True).view(np.int64) if near else []
                    out.append((j, cut, cut - len(added) if near else 0, near, added))
                j, n, common, near, added = zip(*out, strict=True)
                ids = [x.column(c).slice(i, k - i) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(j, pa.float64()), pa.array(n, pa.int64()), pa.array(common, pa.int64()), pa.array(near, pa.bool_()), pa.array(added, pa.list_(pa.int64()))], ["a", "b", "j", "n", "common", "near", "added"])

    return both.mapInArrow(judged, "a long, b long, j double, n long, common long, near boolean, added array<long>")


def _rarest(nodes_: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Rows (bucket, node, label, far) of nodes_ (node, label, far): the nodes by their rarest shingles, so many that two sets of at least the threshold share one."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b, said in slices(x.column(1)):
                doc, shingle, _ = shingles(said, size)
                n = np.bincount(doc, minlength=b - a)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(shingle.view(np.int64)))
                yield pa.RecordBatch.from_arrays([x.column(0).slice(a, b - a), lists], ["node", "s"])

    all_ = checkpointed(texts.mapInArrow(listed, "node long, s array<long>"))
    # A shingle that only one node has is rarer than all others and shared with none: its number counts, not itself.
    common = all_.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    held = all_.select("node", F.explode("s").alias("s")).join(common, "s")
    ordered = held.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy("c", "s"))).withColumn("shared", F.count("*").over(W.partitionBy("node")))
    n = all_.select("node", F.size("s").alias("n"))
    kept = ordered.join(n, "node").filter(F.col("rank") <= F.col("shared") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    return checkpointed(kept.select("node", F.col("s").alias("bucket")).join(nodes_, "node").select("bucket", "node", "label", "far"))


def _crossing(buckets: DataFrame, crowd: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes of different classes that share a bucket, one of them far from its head (rows bucket, node, label, far), and the rows of larger buckets."""
    sizes = checkpointed(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("far").alias("far")).filter("low <> high and far").select("bucket", "n"))
    small = sizes if crowd is None else sizes.filter(F.col("n") <= crowd)
    rows = buckets.join(small, "bucket").select("bucket", "node", "label", "far")
    other = rows.select("bucket", F.col("node").alias("b"), F.col("label").alias("_l"), F.col("far").alias("_f"))
    pairs = rows.join(other, "bucket").filter("node < b and label <> _l and (far or _f)").select(F.col("node").alias("a"), "b").distinct()
    large = sizes.filter(F.lit(False)) if crowd is None else sizes.filter(F.col("n") > crowd)
    return pairs, buckets.join(large, "bucket", "left_semi")


def _around(near: DataFrame, threshold: float, block: int = 512, entries: int = 1 << 22, most: int = 500_000) -> DataFrame:
    """Pairs of nodes of different classes near one head (rows node, head, label, j, n, common, added), of which one isn't linked to the head and that can be linked.

    x and y have in common at most the smaller `common` of the two and the shingles that both have and the head lacks;
    linked pairs have at least (|x| + |y|) / (1 + 1/threshold). The nodes of a head are dealt into blocks of about
    `block` nodes and `entries` shingles at most; a task counts what the nodes of two blocks share and returns the pairs
    that the bound leaves, no others.
    """
    sizes = near.groupBy("head").agg(F.count("*").alias("_n"), F.sum(F.size("added")).alias("_s"), F.min("j").alias("_j"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_s") / entries), F.lit(1))
    sizes = sizes.filter((F.col("_j") < threshold) & (F.col("_low") != F.col("_high"))).select("head", blocks.cast("int").alias("_b"))
    sizes, hint = bounded(checkpointed(sizes), most)  # without a shuffle by head, in which the nodes of a head would be one task's
    dealt = near.join(hint(sizes), "head").withColumn("_at", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    first, second = F.least("_at", "_to").alias("p"), F.greatest("_at", "_to").alias("q")
    sent = dealt.select("head", first, second, (F.col("_at") == F.least("_at", "_to")).alias("left"), "node", "label", (F.col("j") < threshold).alias("apart"), "n", "common", "added")
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def left_open(t: pa.Table) -> pa.Table:
        node, label, n, common = (t[c].to_numpy().astype(np.int64) for c in ("node", "label", "n", "common"))
        apart, left = (t[c].to_numpy(zero_copy_only=False) for c in ("apart", "left"))
        one = t["p"][0].as_py() == t["q"][0].as_py()
        i, j = np.flatnonzero(left), np.flatnonzero(left if one else ~left)
        if not len(i) or not len(j) or not apart.any():
            return none
        added = t["added"].combine_chunks()
        owner = np.repeat(np.arange(len(node)), added.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        by = np.argsort(said := added.flatten().to_numpy(zero_copy_only=False), kind="stable")
        said, owner = said[by], owner[by]
        cuts = np.flatnonzero(np.concatenate([[True], said[1:] != said[:-1], [True]])) if len(said) else np.zeros(1, np.int64)
        row, column = np.full(len(node), -1), np.full(len(node), -1)
        row[i], column[j] = np.arange(len(i)), np.arange(len(j))
        shared = np.zeros((len(i), len(j)), np.int32)
        for k in np.flatnonzero(np.diff(cuts) > 1):
            held = owner[cuts[k] : cuts[k + 1]]
            r, c = row[held], column[held]
            shared[np.ix_(r[r >= 0], c[c >= 0])] += 1
        open_ = n[i][:, None] + n[j][None, :] <= (1 + 1 / threshold) * (np.minimum(common[i][:, None], common[j][None, :]) + shared) + 1e-9
        open_ &= (label[i][:, None] != label[j][None, :]) & (apart[i][:, None] | apart[j][None, :])
        x, y = np.nonzero(open_)
        x, y = node[i[x]], node[j[y]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    # Rows are dealt by head here; without the repartition all blocks of a head would stay in one task.
    return sent.repartition("head", "p", "q").groupBy("head", "p", "q").applyInArrow(left_open, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, weighting: str = "set", key: str = "doc_id", text: str = "text", crowd: int = 48, most: int = 500_000, sift: bool = True) -> DataFrame:
    """Rows (key, class_id, kept, row_hash), one for each row of docs. class_id: the smallest key of the class; kept: whether the row has it. weighting: "set" or "count". sift: candidates whose sketches rule out the threshold but for a chance of 1e-8 aren't compared; False compares all. most bounds the rows of a broadcast table; crowd is the size above which buckets are taken apart by rare shingles."""
    said = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    found = checkpointed(sketches(said, size, weighting))
    nodes = checkpointed(found.groupBy("h1", "h2").agg(F.min("_id").alias("_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks")).withColumn("node", F.monotonically_increasing_id()))
    members = checkpointed(found.select("_id", "_h", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("_id", "_h", "node"))

    # A bucket's head is its node with the most company in all its buckets: the text that the others derive from.
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = checkpointed(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    held = checkpointed(buckets.join(sizes, "bucket"))
    company = checkpointed(held.groupBy("node").agg(F.sum("n").alias("company")))
    held_by = held.select("bucket", "node").join(company, "node")
    heads = checkpointed(held_by.groupBy("bucket").agg(F.max_by("node", F.struct("company", "node")).alias("head")))
    held = held.select("bucket", "node").join(heads, "bucket").filter("node <> head")

    def compare(pairs: DataFrame) -> DataFrame:
        return checkpointed(_compared(pairs, said, nodes, size, weighting, threshold, most))

    stars = compare(checkpointed(held.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()))
    links = stars.filter(F.col("j") >= threshold).select("a", "b")
    labels = checkpointed(components(links.toDF("u", "v")))

    # What is left: pairs of nodes of different classes with a common head, neither of them the head.
    judged = checkpointed(stars.withColumnsRenamed({"a": "node", "b": "head"}).join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")))
    pairs = _around(judged.filter("near"), threshold, most=most)
    # Far from the head: those below 2 * threshold - 1 can't be linked to what is linked to the head, as 1 - j is a metric.
    apart = judged.filter(F.col("j") < threshold) if weighting == "set" else judged
    shared = checkpointed(held.join(apart.select("node", "head", "label", (~F.col("near")).alias("far")), ["node", "head"]).select("bucket", "node", "label", "far"))
    more, large = _crossing(shared, crowd if weighting == "set" else None)
    pairs = pairs.union(more)
    if large.limit(1).count():
        inside = checkpointed(large.groupBy("node").agg(F.min("label").alias("label"), F.max("far").alias("far")))
        more, _ = _crossing(_rarest(inside, _texts(inside, said, nodes, size, weighting, most), size, threshold), None)
        pairs = pairs.union(more)
    some = pairs.distinct()
    more = compare(checkpointed(_alike(some, nodes, threshold) if sift else some)).filter(F.col("j") >= threshold).select("a", "b")
    if more.limit(1).count():
        labels = checkpointed(components(links.union(more).toDF("u", "v")))

    least = checkpointed(members.join(labels, "node", "left").select("_id", F.coalesce("component", "node").alias("label")).groupBy("label").agg(F.min("_id").alias("class_id")))
    named = checkpointed(nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label")).join(least, "label").select("node", "class_id"))
    out = members.join(named, "node").select("_id", "_h", "class_id")
    rows = said.select("_id", F.xxhash64("_id", "_text").alias("_h"))
    alone = rows.alias("a").join(found.select("_id", "_h").distinct().alias("b"), same(rows, found, ["_id", "_h"]), "left_anti")
    out = out.union(alone.select("_id", "_h", F.col("_id").alias("class_id")))
    for df in (shared, heads, sizes, company):
        dropped(df)
    return out.select(F.col("_id").alias(key), "class_id", F.col("_id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("_h").alias("row_hash"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 500_000, **options) -> DataFrame:
    """docs, with all columns, without the texts that aren't the first of their class; of rows alike in key and text one stays.

    Null texts and texts without words stay, as classes of their own. Of a class the row of the smallest key stays (a
    null key only if the class has no other). Columns may have any names, an empty table gives no rows.
    """
    found = checkpointed(near_duplicates(docs, key=key, text=text, most=most, **options).select(F.col(key).alias("_id"), F.col("row_hash").alias("_h"), "kept"))
    gone, hint = bounded(found.filter("not kept").select("_id", "_h").distinct(), most)
    own = F.col("row").getField(key), F.col("row").getField(text)
    out = rowed(docs).join(hint(gone), own[0].eqNullSafe(F.col("_id")) & (F.xxhash64(*own) == F.col("_h")), "left_anti").select("row.*")
    repeated = found.filter("kept").groupBy("_id", "_h").count().filter("count > 1").limit(1).count()
    return out.dropDuplicates([key, text]) if repeated else out
