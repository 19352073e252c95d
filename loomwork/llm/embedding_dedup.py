"""Embedding near-dedup: dual traversal of cover trees, exact threshold pairs.

Vectors are scaled to unit length, so a cosine of at least c is a distance of at most sqrt(2 - 2c). Equal vectors
are one point with a multiplicity. The top of the tree is a set of at most `pivots` points drawn by a hash: each
point belongs to the cell of its nearest pivot, cells of more than `block` points are dealt into blocks. In each
block nested levels of centres with halving radii are built; a point's node at each level and its distance from it
are kept. Pairs of cells, and then of nodes, level by level, are pruned if their centres are farther apart than
the sum of their covering radii and the threshold; what is left is compared in double precision.

A pair of blocks gives, for each of its points, the number of its links and one edge to the smallest point that
links within the pair of blocks reach: no list of all pairs arises, however dense the groups are. Where the data
have no clusters (distances all alike) no bound prunes anything and all pairs of blocks are compared.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do vectors of
different lengths; such rows have no links and are components of their own. Rows that repeat a vec_id are points
of their own which share its component. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, components

RADII = (1.0, 0.5, 0.25, 0.125)


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length, in double precision."""
    flat = pa.chunked_array(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def cover(x: np.ndarray) -> np.ndarray:
    """For each point the index of its node's centre at each level; the levels are nested."""
    n = len(x)
    nearest, gap = np.zeros(n, np.int64), distances(x, x[:1])[:, 0]
    at = []
    for r in RADII:
        while True:
            far = int(np.argmax(gap))
            if gap[far] <= r:
                break
            d = distances(x, x[far : far + 1])[:, 0]
            d[far] = 0
            closer = d < gap
            nearest[closer], gap[closer] = far, d[closer]
        at.append(nearest.copy())
    levels = [at[-1]]
    for level in reversed(at[:-1]):
        levels.append(level[levels[-1]])  # a node's parent is the node of its centre
    return np.stack(levels[::-1], axis=1)


def linked(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """Which x and y have a cosine of at least `least`. nx, ny: cover() of each."""
    tau = np.sqrt(2 - 2 * least) + 1e-7

    def level(p: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centres, of = np.unique(nodes, return_inverse=True)
        radius = np.zeros(len(centres))
        np.maximum.at(radius, of, np.sqrt(((p - p[nodes]) ** 2).sum(axis=1)))
        return centres, of, radius

    open_: np.ndarray | None = None
    ofx = ofy = np.zeros(0, np.int64)
    for i in range(nx.shape[1]):
        cx, tox, rx = level(x, nx[:, i])
        cy, toy, ry = level(y, ny[:, i])
        if len(cx) * len(cy) * 2 > len(x) * len(y):
            break  # nearly as many nodes as points
        before = np.ones((len(cx), len(cy)), bool) if open_ is None else open_[np.ix_(ofx[cx], ofy[cy])]
        open_ = before & (distances(x[cx], y[cy]) <= tau + rx[:, None] + ry[None, :])
        ofx, ofy = tox, toy
    out = np.zeros((len(x), len(y)), bool)
    if open_ is None:
        return x @ y.T >= least
    rows, cols = np.flatnonzero(open_.any(axis=1)[ofx]), np.flatnonzero(open_.any(axis=0)[ofy])
    if len(rows) and len(cols):
        near = open_[np.ix_(ofx[rows], ofy[cols])]
        out[np.ix_(rows, cols)] = near & (x[rows] @ y[cols].T >= least)
    return out


def reached(hits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each point reaches; hits: links (rows, columns) between points of these positions."""
    low = np.arange(len(ids))
    order = np.argsort(ids)
    rank = np.empty_like(order)
    rank[order] = low
    now = rank.copy()
    a, b = hits
    while True:
        least = np.minimum(now[a], now[b])
        then = now.copy()
        np.minimum.at(then, a, least)
        np.minimum.at(then, b, least)
        then = np.minimum(then, then[order[then]])
        if (then == now).all():
            return ids[order[now]]
        now = then


def links(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", column: str = "embedding", block: int = 2048, pivots: int = 512) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of vectors."""
    spark = vectors.sparkSession
    number = F.transform(column, lambda v: v.cast("double"))
    good = F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    good = good & F.coalesce(F.exists(number, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_id"), F.col(column).alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    valid = rows.filter("good").select("_id", "v", F.xxhash64("v").alias("h"))
    points = checkpointed(valid.groupBy("h", "v").agg(F.count("*").alias("n"), F.min("_id").alias("least")).withColumn("p", F.monotonically_increasing_id()))
    total = points.count()

    # The top of the tree: pivots of each length of vector, at most `pivots` in all.
    wanted = min(pivots, -(-total // block)) if total else 0
    top = [(i, r.v) for i, r in enumerate(points.orderBy(F.xxhash64(F.lit(5), "h")).limit(wanted).select("v").collect())]
    shared = spark.sparkContext.broadcast(top)

    def assigned(batches):
        tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for _, v in shared.value}:
            own = [(i, v) for i, v in shared.value if len(v) == n]
            tops[n] = np.array([i for i, _ in own]), unit(pa.array([v for _, v in own]))
        for x in batches:
            column_, sizes = x.column(0), x.column(0).value_lengths().to_numpy()
            cell, far = -sizes.astype(np.int64), np.full(len(sizes), 2.0)  # lengths without a pivot are cells of their own
            for n in set(sizes) & set(tops):
                own = np.flatnonzero(sizes == n)
                d = distances(unit(column_.take(pa.array(own))), tops[n][1])
                at = d.argmin(axis=1)
                cell[own], far[own] = tops[n][0][at], d[np.arange(len(own)), at]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(cell), pa.array(far)], ["v", "n", "p", "cell", "far"])

    kind = points.schema["v"].dataType.simpleString()
    dealt = checkpointed(points.select("v", "n", "p").mapInArrow(assigned, f"v {kind}, n long, p long, cell long, far double"))

    # Cells, their radii, and which pairs of them can hold links: at most `pivots` squared.
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    tau = float(np.sqrt(2 - 2 * least)) + 1e-7
    centre = {i: unit(pa.array([v]))[0] for i, v in top}

    def may(a: int, b: int) -> bool:
        if a < 0 or b < 0 or len(centre[a]) != len(centre[b]):
            return a == b
        return float(np.linalg.norm(centre[a] - centre[b])) <= cells[a].far + cells[b].far + tau

    salts = {c: -(-r.n // block) for c, r in cells.items()}
    partners = [(c, salts[c], [[o, salts[o]] for o in cells if may(c, o)]) for c in cells]
    partners_ = F.broadcast(spark.createDataFrame(partners, "cell long, salts long, others array<array<long>>"))
    salted = dealt.join(partners_.select("cell", "salts"), "cell").withColumn("salt", F.pmod(F.xxhash64(F.lit(9), "p"), "salts"))

    def tree(t: pa.Table) -> pa.Table:
        nodes = cover(unit(t["v"]))
        own = t["p"].to_numpy()
        return pa.table({"v": t["v"], "n": t["n"], "p": t["p"], "cell": t["cell"], "salt": t["salt"], "nodes": pa.array(own[nodes].tolist(), pa.list_(pa.int64()))})

    trees = checkpointed(salted.select("v", "n", "p", "cell", "salt").groupBy("cell", "salt").applyInArrow(tree, f"v {kind}, n long, p long, cell long, salt long, nodes array<long>"))
    named = lambda c, s: F.struct(c.alias("c"), s.alias("s"))
    sent = trees.join(partners_.select("cell", "others"), "cell").withColumn("o", F.explode("others")).withColumn("os", F.explode(F.sequence(F.lit(0), F.col("o")[1] - 1)))
    me, it = named(F.col("cell"), F.col("salt")), named(F.col("o")[0], F.col("os"))
    sent = sent.select("v", "n", "p", "nodes", (me <= it).alias("first"), (me == it).alias("self"), F.least(me, it).alias("a"), F.greatest(me, it).alias("b"))

    def compared(t: pa.Table) -> pa.Table:
        first = t["first"].to_numpy()
        alone = bool(t["self"][0].as_py())
        p, n, x = t["p"].to_numpy(), t["n"].to_numpy(), unit(t["v"])
        where = {v: i for i, v in enumerate(p)}
        nodes = np.array([[where[c] for c in r] for r in t["nodes"].to_pylist()])
        i = np.flatnonzero(first)
        j = i if alone else np.flatnonzero(~first)
        none = pa.table({"p": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "q": pa.array([], pa.int64())})
        if not len(i) or not len(j):
            return none
        back = np.zeros(len(p), np.int64)
        back[i] = np.arange(len(i))
        nx = back[nodes[i]]
        back[j] = np.arange(len(j))
        hit = linked(x[i], nx, x[j], back[nodes[j]], least)
        if alone:
            np.fill_diagonal(hit, False)
            hit |= hit.T
        a, b = np.nonzero(hit)
        count = np.bincount(i[a], n[j[b]], len(p)).astype(np.int64)
        if not alone:
            count += np.bincount(j[b], n[i[a]], len(p)).astype(np.int64)
        low = reached((i[a], j[b]), p)
        some = np.flatnonzero(count)
        return pa.table({"p": p[some], "links": count[some], "q": low[some]})

    found = checkpointed(sent.groupBy("a", "b").applyInArrow(compared, "p long, links long, q long"))
    sums = found.groupBy("p").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("p").alias("u"), F.col("q").alias("v")))
    about = points.select("p", "h", "v", "n", "least").join(sums, "p", "left").join(labels, points.p == labels.node, "left")
    about = checkpointed(about.select("h", "v", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "p").alias("label")))
    smallest = about.groupBy("label").agg(F.min("least").alias("component_id"))
    about = checkpointed(about.join(smallest, "label").select("h", "v", "n_links", "component_id"))
    out = valid.join(about, ["h", "v"]).select("_id", "n_links", "component_id")
    out = out.union(rows.filter("not good").select("_id", F.lit(0).cast("long"), "_id"))
    return out.select(F.col("_id").alias(key), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
