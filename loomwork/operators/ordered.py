"""Operators that depend on order: global ranks, stride samples, chunks with context, rates, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.tables import checkpointed


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """df with rank (from 0) by key: a range partitioning, ranks inside the parts and the parts' sizes added up, so that no task sees all rows.

    The sorted parts are written and read again: where they end is sampled anew each time they are made, so that sizes
    and ranks of two runs don't fit together.
    """
    parts = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key)
    # An id is the part's number above 33 bits of the row's place in it.
    placed = checkpointed(parts.withColumn("_id", F.monotonically_increasing_id()))
    inside = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_offset"))
    return inside.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_offset") + F.col("_at")).drop("_id", "_part", "_at", "_offset")


def sample_stride(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Rows at the places floor(i * N / n) by key, n = max(1, floor(N * rate)): even and repeatable."""
    total = df.count()
    n = max(1, int(total * rate))
    if rate >= 1 or not total:
        return df
    rank = F.col("rank").cast("double")
    i = F.ceil(rank * n / total)  # the only i whose place can be this rank
    return global_rank(df, key).filter((i < n) & (F.floor(i * F.lit(total / n)) == F.col("rank"))).drop("rank")


def chunks(units: DataFrame, size: int = 8, overlap: int = 2) -> DataFrame:
    """Rows (source_file, chunk, n, prior): the units of a file in chunks; prior: the last lines before a chunk of several rows."""
    w = W.partitionBy("source_file").orderBy("line")
    rows = units.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_before", F.collect_list("original").over(w.rowsBetween(-overlap, -1)))
    rows = rows.withColumn("chunk", F.floor(F.col("_rn") / size))
    out = rows.groupBy("source_file", "chunk").agg(F.count("*").alias("n"), F.min_by("_before", "_rn").alias("prior"))
    return out.withColumn("prior", F.when(F.col("n") > 1, F.array_join("prior", "\n")).otherwise(""))


def rate(events: DataFrame, key: str, micros: Column, counter: Column, seconds: int = 8) -> DataFrame:
    """events with rate: growth of a counter per second over the last seconds, 0 for less than two samples or a second, never negative."""
    w = W.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    rows = events.withColumn("_t", micros).withColumn("_c", counter)
    gap = (F.col("_t") - F.first("_t").over(w)) / 1e6
    grown = F.col("_c") - F.first("_c").over(w)
    return rows.withColumn("rate", F.when(gap < 1, 0.0).otherwise(F.greatest(F.lit(0.0), grown / gap))).drop("_t", "_c")


def carry_forward(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def budget_trim(rows: DataFrame, group: str, delta: str, key: str, budget: int | str) -> DataFrame:
    """rows with dropped: from the largest delta down rows go until what is left of their group fits the budget (a number, or a column that is one number in each group); those that don't grow stay."""
    # What lies before a delta is summed over a group's different deltas; only the one inside which the budget ends is put in order.
    w = W.partitionBy("_g")
    values = rows.groupBy(F.col(group).alias("_g"), F.col(delta).alias("_d")).agg(F.count("*").alias("_n"), F.max(F.col(budget) if isinstance(budget, str) else F.lit(budget)).alias("_b"))
    sized = F.col("_n") * F.coalesce("_d", F.lit(0))
    before = F.coalesce(F.sum(sized).over(w.orderBy(F.desc("_d")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("_left", F.sum(sized).over(w) - before)
    names = rows.columns
    joined = rows.join(values, rows[group].eqNullSafe(F.col("_g")) & rows[delta].eqNullSafe(F.col("_d")))
    some = F.coalesce(F.col("_d") > 0, F.lit(False)) & (F.col("_left") > F.col("_b"))
    whole = F.col("_left") - (F.col("_n") - 1) * F.col("_d") > F.col("_b")
    split = some & ~whole
    nth = F.row_number().over(W.partitionBy("_g", "_d").orderBy(key)) - 1
    edge = joined.filter(split).withColumn("dropped", F.col("_left") - nth * F.col("_d") > F.col("_b"))
    return joined.filter(~split).withColumn("dropped", some).union(edge).select(*names, "dropped")
