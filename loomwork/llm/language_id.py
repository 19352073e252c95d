"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of `width` bytes. In each window one network reads forwards,
another backwards, and both states at a byte label that byte; a text's probabilities are the means over all its bytes of
letters, in all of its windows. Thousands of windows are read at once, a byte of each in a step, longest first, so that
a step has no padding. Prediction is a scan of whole texts: nothing is shuffled.

The weights are trained in numpy by backpropagation through time on windows of a bounded sample: of each of the `classes`
most frequent languages the `sample` rows of least hash that aren't held out, and of each at most `windows` windows, spread
evenly over its whole text. Windows are taken in the tasks, so that one task gets
classes * sample * windows * width bytes at most, and the driver the weights.

Null texts and texts without a letter are `und` with score 0, as all are where no row bears a language. Rows whose
language is null, and those held out, aren't learned from. Repeated rows get the same result, an empty table gives no
rows, other columns are ignored. Texts are never cut off: each of their bytes is labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import folded

UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])  # bytes of letters, or of characters beyond ASCII
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)
GATES = 3  # reset, update and candidate: each a table of 256 rows for the byte read and a square matrix for the state


class Network:
    """The weights by name; of each direction `table` (gate, byte, unit), `state` (gate, unit, unit), `bias` of the candidate's state and `out` (unit, class), and one `base` (class)."""

    def __init__(self, classes: int, units: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights = {"base": np.zeros(classes, np.float32)}
        for way in "fb":
            self.weights |= {
                f"{way}table": rng.normal(0, 0.3, (GATES, 256, units)).astype(np.float32),
                f"{way}state": rng.normal(0, units**-0.5, (GATES, units, units)).astype(np.float32),
                f"{way}bias": np.zeros(units, np.float32),
                f"{way}out": rng.normal(0, units**-0.5, (units, classes)).astype(np.float32),
            }

    def read(self, way: str, data: np.ndarray, active: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The classes' scores at each step (steps, classes, windows). data (steps, windows) has a byte of each window in a step, active the number of windows that still have one; kept gets what backpropagation needs."""
        table, state, bias, out = (self.weights[way + x] for x in ("table", "state", "bias", "out"))
        scores = np.zeros((len(data), out.shape[1], data.shape[1]), np.float32)
        h = np.zeros((data.shape[1], state.shape[1]), np.float32)
        for t, m in enumerate(active.tolist()):
            x, was = data[t, :m], h[:m]
            r = was @ state[0]
            r += table[0].take(x, 0)
            z = was @ state[1]
            z += table[1].take(x, 0)
            for gate in (r, z):  # the logistic function as a tangent
                np.multiply(gate, 0.5, out=gate)
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            s = was @ state[2]
            s += bias
            n = r * s
            n += table[2].take(x, 0)
            np.tanh(n, out=n)
            now = was - n
            now *= z
            now += n
            if kept is not None:
                kept.append((x, was, r, z, s, n, now))
            h = now
            np.matmul(out.T, now.T, out=scores[t, :, :m])
        return scores

    def back(self, way: str, kept: list, grads: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a direction's weights from those of its scores, through time."""
        table, state, out = (self.weights[way + x] for x in ("table", "state", "out"))
        g_state, g_bias, g_out = np.zeros_like(state), np.zeros(state.shape[1], np.float32), np.zeros_like(out)
        by_byte, read = [], []
        dh = np.zeros((0, state.shape[1]), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            x, was, r, z, s, n, now = kept[t]
            g = grads[t, :, : len(x)].T
            g_out += now.T @ g
            d = g @ out.T
            d[: len(dh)] += dh
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (was - n) * z * (1 - z)
            dr = dn * s * r * (1 - r)
            ds = dn * r
            for k, gate in enumerate((dr, dz, ds)):
                g_state[k] += was.T @ gate
            g_bias += ds.sum(0)
            by_byte.append(np.stack([dr, dz, dn]))
            read.append(x)
            dh = d * z + dr @ state[0].T + dz @ state[1].T + ds @ state[2].T
        every, x = np.concatenate(by_byte, 1), np.concatenate(read)
        order = np.argsort(x, kind="stable")
        at = np.flatnonzero(np.diff(x[order].astype(np.int16), prepend=-1))
        g_table = np.zeros_like(table)
        g_table[:, x[order][at]] = np.add.reduceat(every[:, order], at, axis=1)
        return {way + "table": g_table, way + "state": g_state, way + "bias": g_bias, way + "out": g_out}


def _steps(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of windows (longest first) by steps, from their front and from their back; windows that have a byte in each step."""
    k = np.arange(int(sizes[0]))[:, None]
    inside = k < sizes
    ahead = data[np.where(inside, starts + k, starts)]
    return ahead, data[np.where(inside, starts + sizes - 1 - k, starts)], inside.sum(1)


def _labels(net: Network, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kept: tuple[list | None, list | None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (steps, classes, windows) of each byte, and which bytes are letters of a window."""
    ahead, behind, active = _steps(data, starts, sizes)
    scores = net.read("f", ahead, active, kept[0])
    scores += _turned(net.read("b", behind, active, kept[1]), sizes)
    scores += net.weights["base"][:, None]
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(1, keepdims=True)
    return scores, (np.arange(len(ahead))[:, None] < sizes) & _LETTER[ahead]


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """x (steps, classes, windows) with the steps of each window from its other end; what lies behind its end is undefined."""
    if sizes[0] == sizes[-1]:
        return x[::-1]
    turn = np.maximum(sizes - 1 - np.arange(len(x))[:, None], 0)
    return np.take_along_axis(x, turn[:, None, :], 0)


def train(parts: list[bytes], labels: list[int], classes: int, units: int = 12, epochs: int = 4, batch: int = 512, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from windows of one length or shorter and their classes; every class bears the same weight."""
    net, rng = Network(classes, units, seed), np.random.default_rng(seed)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    data, y = folded(np.frombuffer(b"".join(parts), np.uint8)), np.array(labels)
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)
    share = (share / share[y].mean()).astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(v) for k, v in net.weights.items()}
    total, i = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        mixed_up = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = mixed_up[a : a + batch]
            rows = rows[np.argsort(-sizes[rows], kind="stable")]
            kept: tuple[list, list] = ([], [])
            p, letters = _labels(net, data, starts[rows], sizes[rows], kept)
            p[:, y[rows], np.arange(len(rows))] -= 1
            p *= (letters * share[y[rows]] / max(1, int(sizes[rows].sum())))[:, None]
            grads = net.back("f", kept[0], p) | net.back("b", kept[1], _turned(p, sizes[rows])) | {"base": p.sum((0, 2))}
            i += 1
            now = rate * min(1, 1.1 - i / total)
            norm = max(1, float(np.sqrt(sum((g * g).sum() for g in grads.values()))))
            for k, g in grads.items():
                g = g / norm
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.weights[k] -= (now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net.weights


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = 400, windows: int = 8, width: int = 64, units: int = 12, classes: int = 64, key: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 7) -> dict:
    """The model: languages, width and weights. Learns from rows with a language that aren't held out, within the bounds above."""
    known = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_key")))
    many = known.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(classes).collect()
    names = sorted(r["_lang"] for r in many)
    model = {"names": names, "width": width, "units": units, "weights": None}
    if not names:
        return model
    hashed = known.withColumn("_h", F.xxhash64(F.lit(seed), "_key"))
    least = reduce(DataFrame.union, [hashed.filter(F.col("_lang") == name).select("_h").orderBy("_h").limit(sample).agg(F.lit(i).alias("i"), F.max("_h").alias("h")) for i, name in enumerate(names)])
    bound = {names[r.i]: r.h for r in least.collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for i in range(b.num_rows):
                t = b.column(0)[i].as_py().encode()
                n = -(-len(t) // width)
                at = [k * n // min(n, windows) * width for k in range(min(n, windows))]
                rows += [i] * len(at)
                parts += [t[a : a + width] for a in at]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), b.column(1).take(pa.array(rows, pa.int64())), b.column(2).take(pa.array(rows, pa.int64()))], ["part", "y", "_h"])

    label = reduce(lambda c, i: c.when(F.col("_lang") == names[i], F.lit(i)), range(len(names)), F).alias("y")
    taken = hashed.filter(reduce(lambda a, b: a | b, [(F.col("_lang") == n) & (F.col("_h") <= h) for n, h in bound.items()])).select("_text", label, "_h")
    rows = taken.mapInArrow(cut, "part binary, y int, _h long").orderBy("_h", "y", "part").limit(len(names) * sample * windows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for b in batches:
            parts += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
        weights = train(parts, labels, len(names), units, seed=seed) if parts else {}
        yield pa.RecordBatch.from_arrays([pa.array(list(weights), pa.string()), pa.array([w.astype("<f4").tobytes() for w in weights.values()], pa.binary())], ["name", "data"])

    shapes = {k: v.shape for k, v in Network(len(names), units).weights.items()}
    found = rows.coalesce(1).mapInArrow(learn, "name string, data binary").collect()
    model["weights"] = {r["name"]: np.frombuffer(bytes(r["data"]), "<f4").reshape(shapes[r["name"]]) for r in found} or None
    return model


def _pooled(net: Network, column: pa.Array, width: int, classes: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean probabilities of its bytes of letters, and the number of these bytes."""
    column = pc.fill_null(column, "") if column.null_count else column
    sums, many = np.zeros((len(column), classes)), np.zeros(len(column), np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or bounds[-1] == bounds[0]:
        return sums, many
    data = folded(np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]])
    bounds -= bounds[0]
    sizes = np.diff(bounds)
    each = -(-sizes // width)  # windows of each text
    text = np.repeat(np.arange(len(sizes)), each)
    starts = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * width
    sizes = np.minimum(bounds[text + 1] - starts, width)
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), block):
        at = order[a : a + block]
        p, letters = _labels(net, data, starts[at], sizes[at])
        own, place = np.unique(text[at], return_inverse=True)
        many[own] += np.bincount(place, letters.sum(0)).astype(np.int64)
        for k, each in enumerate(np.einsum("tkw,tw->kw", p, letters.astype(np.float32))):
            sums[own, k] += np.bincount(place, each)
    return sums / np.maximum(many, 1)[:, None], many


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score), one for each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def has_letter(data: pa.Array, pooled: np.ndarray) -> np.ndarray:
        out = pooled > 0
        for i in np.flatnonzero(out).tolist():
            t = data[i].as_py()
            out[i] = any(map(str.isalpha, t))  # ends at the first letter
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, width = shared.value["names"], shared.value["width"]
        net = Network(len(names), shared.value["units"])
        net.weights = shared.value["weights"]
        for b in batches:
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            if net.weights is not None:
                p, many = _pooled(net, b.column(1), width, len(names))
                said = has_letter(b.column(1), many)
                best[said], score[said] = p[said].argmax(1), np.minimum(p[said].max(1), 1)
            named = pa.array([names[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), named, pa.array(score)], [key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
