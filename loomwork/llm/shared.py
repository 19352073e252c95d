"""What several operators share: reliable checkpoints, connected components, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset a folder of our own, which only executors on the driver's machine share."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(shared)
    return f"{shared}/{context.applicationId}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again: its lineage is cut, lost executors cost nothing."""
    path = _folder(df.sparkSession)
    small_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a df of checkpointed() that nothing reads any more."""
    if path := df.__dict__.pop("written_at", None):
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


#: The most bytes (as JSON, about what they take in memory) of a table that is broadcast.
BROADCAST_BYTES = 1 << 26


def bounded(df: DataFrame, most: int, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df and a hint for it and what is derived from it: broadcast() if it has no more than `most` rows and most_bytes bytes, else none: the join shuffles."""
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()
    return df, F.broadcast if n <= most and (size or 0) <= most_bytes else lambda x: x


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Lets Spark hand texts to Python in batches of `size`, where the session has its default of 64 MB: each task holds several batches outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, size)


def rowed(df: DataFrame) -> DataFrame:
    """df as one struct column `row`, so that no column of its own clashes with one that an operator adds."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; lower() does the same to ASCII texts and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component), component being the smallest node.

    Large-star and small-star steps alternate until the edges stay as they are. A step is a minimum per node,
    combined before the shuffle, joined back to the edges: no group of neighbours is ever gathered, so a node
    with very many links is no more than a skewed join key. Nodes without an edge to another node are absent.
    """
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == was or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        was = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The least neighbour itself is linked by the rows that its own larger neighbours emit.
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        old, now = now, checkpointed(small.filter("u <> v").distinct())
        dropped(old)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on each other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, np.uint64)
    down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse, modulo 2**64."""
    up, down = _powers(1 << max(16, (size - 1).bit_length()), base)
    return up[:size], down[:size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of data[start:end] (bytes) for many spans at once, from prefix sums of a polynomial."""
    up, down = powers(len(data) + 1, base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(48))


#: Bytes of words: ASCII letters and digits and all of UTF-8's longer characters; and A-Z to a-z.
WORD_BYTES = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


#: Bytes of text that are worked on at once: arrays over them have some ten times eight bytes a byte.
PIECE = 1 << 18


def pieces(texts: list[str], most: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes each, so that arrays over their bytes stay small."""
    out, first, size = [], 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            out.append((first, i))
            first, size = i, 0
        size += len(text) + 1
    return [*out, (first, len(texts))] if texts else []


def slices(column: pa.Array, most: int = PIECE, rows: int = 60_000) -> Iterator[tuple[int, int, list[str]]]:
    """A column of strings by slices of about `most` bytes and at most `rows` rows: first row, row after the last, texts (null: empty). No more than one slice is held as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(ends):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right"))
        b = min(max(a + 1, b), a + rows)
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b
