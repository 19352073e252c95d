"""Mixing sources to target weights by capped water-filling.

A source's target is its share by weight of the words of all sources, but at most max_epochs times its own
words; what is cut off goes to the others by weight, again and again until no target is above its cap. Every
text is taken floor(target / size) whole times; for the rest, texts are taken once more in a seeded order until
the target is reached, the last of them as a fraction, so each source gives floor(target) words exactly.

Null texts have no words, a null source is a source of its own (the last one), a source without words has the
target 0. Texts whose seeded key is equal (a repeated doc_id) are ordered by size; rows equal in both may
share a fraction between them in either way, with the same multiset of results. Other columns are kept, an
empty input gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import checkpointed

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with rank, 0 for the first by code point, null last: a range partitioning and an offset for each partition, no task sees all rows."""
    key = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    sorted_ = df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), *key).sortWithinPartitions(*key)
    sorted_ = checkpointed(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)))
    offset, pairs = 0, []
    for part, n in sorted(sorted_.groupBy("_part").count().collect()):
        pairs += [F.lit(part), F.lit(offset)]
        offset += n
    base = F.create_map(*pairs)[F.col("_part")] if pairs else F.lit(0)
    return sorted_.withColumn("rank", base + F.col("_at")).drop("_part", "_at")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources (source, source_size, weight) with target. Each round is an aggregate; the driver sees two sums."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        cap = F.col("source_size") * max_epochs
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]).cast("double") / F.lit(level[1]).cast("double") > cap
        rest, weights = sources.agg(F.lit(total) - F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if level == (rest, weights) or not weights:
            return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(F.col("weight") * F.lit(rest or 0).cast("double") / F.lit(weights or 1).cast("double")))
        level = (rest, weights)


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 7, key: str = "doc_id", bucket: int = 4096) -> DataFrame:
    """Rows (key, source, size, source_size, target, taken) of docs (key, text, source). bucket: about how many texts are put in order in one task. weights: (source, weight); without it sources by code point weigh 1, 2, 3, repeating."""
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = checkpointed(docs.select(F.col(key).alias("_key"), F.col("source").alias("_source"), words(F.col("text")).alias("size"), own.alias("_u")))
    sources = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = ranked(sources, "_source").withColumn("weight", F.col("rank") % 3 + 1)
    else:
        renamed = weights.select(F.col("source").alias("_s"), F.col("weight"))
        sources = checkpointed(sources.join(renamed, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight")))
    sources = water_fill(sources, max_epochs).select(F.col("_source").alias("_s"), "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("_whole", epochs.cast("long"))
    sources = checkpointed(sources.withColumn("_need", F.floor("target") - F.col("_whole") * F.col("source_size")))

    # Words before a text in its source's seeded order: sums of buckets of the order's first digits, so many that a bucket
    # has some thousand texts, then exact sums within the one bucket where the need ends.
    most = rows.groupBy("_source").count().agg(F.max("count")).first()[0] or 1
    digits = max(2, min(8, math.ceil(math.log(most / bucket, 16)))) if most > bucket else 2
    rows = rows.withColumn("_b", F.substring("_u", 1, digits))
    buckets = rows.groupBy("_source", "_b").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("_before", before).join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_source").withColumnsRenamed({"_b": "_c", "n": "_n"})
    joined = rows.join(buckets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))).drop("_s", "_c")
    split = (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") > F.col("_need"))
    # Texts alike in order and size (a repeated key, all null keys) are summed first; they are told apart only where the need ends among them.
    edge = joined.filter(split)
    alike = edge.groupBy(F.col("_source").alias("_s"), F.col("_u").alias("_v"), F.col("size").alias("_z")).agg(F.count("*").alias("_c"), F.max(F.col("_need") - F.col("_before")).alias("_left"))
    inside = F.coalesce(F.sum(F.col("_c") * F.col("_z")).over(W.partitionBy("_s").orderBy("_v", "_z").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    alike = alike.withColumn("_left", F.col("_left") - inside)
    edge = edge.join(alike, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_u") == F.col("_v")) & (F.col("size") == F.col("_z"))).drop("_s", "_v", "_z")
    among = (F.col("_c") > 1) & (F.col("_left") > 0) & (F.col("_left") < F.col("_c") * F.col("size"))
    nth = F.row_number().over(W.partitionBy("_source", "_u", "size").orderBy("_key")) - 1
    extra = lambda nth: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - nth * F.col("size"))).cast("long")
    some = edge.filter(among).withColumn("_extra", extra(nth)).unionByName(edge.filter(~among).withColumn("_extra", extra(F.lit(0)))).drop("_c", "_left")
    rest = joined.filter(~split).withColumn("_extra", F.when(F.col("_before") < F.col("_need"), F.col("size")).otherwise(0))
    taken = F.col("_whole") * F.col("size") + F.col("_extra")
    return some.unionByName(rest).select(F.col("_key").alias(key), F.col("_source").alias("source"), "size", "source_size", "target", taken.alias("taken"))
