"""URL filters: longest-prefix host/path rules, held in Bloom filter cascades.

A rule is a host and a path prefix. The keys of a url are the concatenations host suffix + path prefix whose
shape (number of host labels, length of the path prefix) some rule has, so a url has at most as many keys as
the rules have shapes. The keys of all urls together are the universe. One cascade is built for each action:
level 0 is a Bloom filter of the listed keys, level 1 one of the unlisted keys of the universe that level 0
lets through, level 2 one of the listed keys that level 1 lets through, and so on until nothing is let through
wrongly. Within the universe the level at which a key first misses then tells exactly whether it is listed, so
urls are judged by a scan, without a join.

Null urls and urls without "://" have an empty host and path and no keys. The longest rule wins, of equally
long ones that with the longer host; a key listed for both actions is blocked. Urls that no rule fits get the
default verdict. Repeated urls are judged alike, other columns of the input are kept, an empty input gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, checkpointed, mixed

#: (action, host, path), the rules of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for urls without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a url with these rule shapes, the longest first."""
    one = lambda labels, chars: F.when(
        (host != "") & (F.length(path) >= chars) & (F.size(F.split(host, r"\.")) >= labels),
        F.struct(
            (F.length(F.substring_index(host, ".", -labels)) + chars).alias("n"),
            F.length(F.substring_index(host, ".", -labels)).alias("h"),
            F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)).alias("key"),
        ),
    )
    found = F.array_compact(F.array(*[one(*s) for s in shapes]))
    return F.transform(F.reverse(F.array_sort(found)), lambda x: x.key)


def _probes(h1: np.ndarray, h2: np.ndarray, level: int, m: int, k: int) -> np.ndarray:
    """The k bits of each key in a filter of m bits; each level hashes anew."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b = mixed(h1.view(np.uint64) ^ salt), mixed(h2.view(np.uint64) + salt) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(m) for i in range(k)])


class Cascade:
    """Bloom filters whose levels alternately encode listed and unlisted keys."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int, int]] = []

    def hits(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, m, k = self.levels[level]
        at = _probes(h1, h2, level, m, k)
        return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for all keys of the universe that the cascade was built over."""
        out = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for level in range(len(self.levels)):
            hit = self.hits(level, h1[left], h2[left])
            out[left[~hit]] = level % 2 == 1
            left = left[hit]
        out[left] = len(self.levels) % 2 == 1
        return out


#: Words of a filter that reach the driver at once.
SLICE = 1 << 20


def bits_of(n: int, p: float) -> int:
    return max(64, math.ceil(n * math.log2(1 / p) / math.log(2) / 64) * 64)


def _filter_of(keys: DataFrame, n: int, level: int, p: float) -> tuple[np.ndarray, int, int]:
    """A filter of n keys. Bits are set word by word in Spark; the driver gets the words."""
    m = bits_of(n, p)
    k = max(1, round(math.log2(1 / p)))

    def words(batches):
        for x in batches:
            at = _probes(x.h1.to_numpy(), x.h2.to_numpy(), level, m, k).ravel()
            yield pd.DataFrame({"w": (at >> np.uint64(6)).astype(np.int64), "b": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    bits = np.zeros(m // 64, np.uint64)
    found = keys.select("h1", "h2").mapInPandas(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    found = checkpointed(found) if m > 64 * SLICE else found
    for low in range(0, m // 64, SLICE):  # the driver holds one slice of words beside the filter
        part = found.filter(F.col("w").between(low, low + SLICE - 1)).toArrow()
        bits[part["w"].to_numpy()] = part["b"].to_numpy().view(np.uint64)
    return bits, m, k


def hashed(keys: DataFrame) -> DataFrame:
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: distinct (h1, h2). A level has at most some ten bits a key."""
    out = Cascade()
    n = listed.count()
    if not n:
        return out
    out.levels.append(_filter_of(listed, n, 0, 0.01))

    def let_through(level: int):
        def kept(batches):
            for x in batches:
                yield x[out.hits(level, x.h1.to_numpy(), x.h2.to_numpy())]

        return kept

    # The keys that level 0 lets through, listed or not: a flag and an aggregate tell which, not a join.
    through = universe.select("h1", "h2").mapInPandas(let_through(0), "h1 long, h2 long").withColumn("listed", F.lit(0))
    keys = through.union(listed.select("h1", "h2", F.lit(1))).groupBy("h1", "h2").agg(F.max("listed").alias("listed"))
    keys = checkpointed(keys)
    inner, outer = keys.filter("listed = 0").drop("listed"), keys.filter("listed = 1").drop("listed")
    while n := inner.count():
        level = len(out.levels)
        out.levels.append(_filter_of(inner, n, level, 0.5))
        inner, outer = checkpointed(outer.mapInPandas(let_through(level), "h1 long, h2 long")), inner
    return out


BLOCK, ALLOW, UNLISTED = 0, 1, 2


def _coded(cascades, part: int, parts: int):
    """A function of a url's keys (two hashes each) and their codes so far: those of this part's keys."""

    @F.pandas_udf("array<int>")
    def actions(h1: pd.Series, h2: pd.Series, codes: pd.Series) -> pd.Series:
        ends = np.cumsum([len(x) for x in h1])
        a, b, c = (np.concatenate([np.asarray(v, np.int64) for v in x]) if len(x) else np.zeros(0, np.int64) for x in (h1, h2, codes))
        own = np.flatnonzero(b % parts == part)
        block, allow = (x.contains(a[own], b[own]) for x in cascades.value)
        c[own] = np.where(block, BLOCK, np.where(allow, ALLOW, UNLISTED))
        return pd.Series(np.split(c, ends[:-1]) if len(ends) else [])

    return actions


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", max_bits: int = 1 << 31) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. rules: (action, host, path) on the driver, or more of them than fit there as a DataFrame of these columns. max_bits bounds a filter's first level and so what is broadcast; more rules take more scans. Columns of pages called host, path, rule or verdict give way to those of the result."""
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "action string, host string, path string")
    rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("host"), "path")
    # One shape a pair of label count and prefix length: as many as urls have, however many rules there are.
    shapes = [tuple(r) for r in rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("c")).distinct().sort("n", "c").collect()]
    names = {c: f"_in_{i}" for i, c in enumerate(pages.columns)}
    base = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    host, path = url_parts(F.col(names[url]))
    base = base.withColumn("host", host).withColumn("path", path)
    base = base.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<string>"))
    universe = hashed(base.select(F.explode("_keys").alias("key")).distinct())
    listed = lambda action: hashed(rules.filter(F.col("action") == action).select(F.concat("host", "path").alias("key")).distinct())
    h1, h2 = F.transform("_keys", lambda x: F.xxhash64(x)), F.transform("_keys", lambda x: F.xxhash64(F.lit(1), x))
    out = base.withColumn("_codes", F.transform("_keys", lambda x: F.lit(UNLISTED)))
    # Rules whose first levels would be larger than max_bits are split by a hash of the key: a cascade and a scan for each part.
    parts = -(-bits_of(max(listed("block").count(), listed("allow").count()), 0.01) // max_bits)
    for part in range(parts):
        own = lambda keys: keys.filter(F.pmod(F.col("h2"), F.lit(parts)) == part) if parts > 1 else keys
        cascades = spark.sparkContext.broadcast([build_cascade(own(listed(a)), own(universe)) for a in ("block", "allow")])
        out = out.withColumn("_codes", _coded(cascades, part, parts)(h1, h2, F.col("_codes")))
        if parts > 1:
            out = checkpointed(out)
            cascades.destroy()
    first = F.get(F.filter(F.arrays_zip("_keys", "_codes"), lambda x: x._codes != UNLISTED), F.lit(0))
    taken = {"host", "path", "rule", "verdict"}
    verdict = F.when(first._codes == 0, "block").when(first._codes == 1, "allow").otherwise(default)
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in taken], "host", "path", first._keys.alias("rule"), verdict.alias("verdict"))
