"""Texts sent to a function in numbered batches: replies are taken by their numbers or not at all, with counts of what happened.

Each distinct text is sent once, in batches that follow the order of first occurrence, so that a run's batches are the
same whatever the partitions. A batch's reply has to be a JSON object with exactly the batch's numbers, each with a
string, and none of its texts may show the prompt; otherwise the whole batch counts for nothing, as a shifted number
would give texts the wrong targets, and its texts are sent one by one. Calls that fail are tried again after a pause that
doubles. Counts are observed while the job runs: no second pass, and nothing of the texts goes to the driver.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import outputs, placeholders
from loomwork.functions import text as T
from loomwork.operators import ordered
from loomwork.tables import checkpointed


def reconciled(reply: str | None, n: int) -> list[str] | None:
    """The texts of a reply by number from 1 to n; null if it isn't an object with just these numbers and a string for each."""
    said = re.sub(r"^`{3,}(?:json)?|`{3,}$", "", (reply or "").strip()).strip()
    for part in (said, said[said.find("{") : said.rfind("}") + 1]):
        try:
            held = json.loads(part)
        except ValueError:
            continue
        if isinstance(held, dict):
            fits = set(held) == {str(i) for i in range(1, n + 1)} and all(isinstance(v, str) for v in held.values())
            return [held[str(i)] for i in range(1, n + 1)] if fits else None
    return None


def transform(units: DataFrame, many: Callable[[dict[int, str]], str], one: Callable[[str], str], script: str = "hanzi", batch: int = 8, retries: int = 1, pause: float = 0.0, failures: tuple = (OSError, ValueError)) -> tuple[DataFrame, Observation]:
    """Rows (uid, original, target, how) of units (seq, uid, original), and counts that are there once the rows have been made.

    many gets {number: text} and returns a reply, one a text and its output; errors of `failures` are tried again `retries`
    times, after pause, twice the pause and so on. how: skipped, batched, single, the code of the rule that the last output
    broke (the output is kept: unverified), or failed (no target). Counts: units, skipped, unique, requests, batched and degraded batches, retried, unverified, failed.
    """

    def tried(call: Callable, x: object) -> tuple[str | None, int]:
        """An output, and how many calls it took."""
        for k in range(retries + 1):
            try:
                return call(x), k + 1
            except failures:  # of a service: waited for, as said above
                time.sleep(pause * 2**k)
        return None, retries + 1

    def ask(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        reply, calls = tried(many, dict(zip(f["i"].tolist(), f["protected"], strict=True)))
        got = reconciled(reply, len(f))
        return f.assign(out=got if got else None, calls=[calls, *[0] * (len(f) - 1)])[["original", "protected", "parts", "batch", "i", "out", "calls"]]

    def again(f: pd.DataFrame) -> pd.DataFrame:
        done = [(o, 0) if o is not None else tried(one, p) for o, p in zip(f["out"].where(f["out"].notna(), None), f["protected"], strict=True)]
        return f.assign(out=[o for o, _ in done], singles=[c for _, c in done])

    marked = units.withColumn("_skip", T.should_skip(F.col("original"), script))
    texts = marked.filter("not _skip").groupBy("original").agg(F.min("seq").alias("first"))
    rows = placeholders.protect(ordered.global_rank(checkpointed(texts), "first"), "original")
    rows = rows.withColumns({"batch": F.floor(F.col("rank") / batch), "i": (F.col("rank") % batch + 1).cast("int")})
    kept = "original string, protected string, parts array<string>, batch long, i int, out string, calls int"
    asked = rows.groupBy("batch").applyInPandas(ask, kept)
    cleaned = outputs.clean(F.col("out"))
    bad = F.col("out").isNull() | outputs.leaked(cleaned, F.col("protected")) | (cleaned == "")
    asked = asked.withColumn("degraded", F.max(bad).over(W.partitionBy("batch"))).withColumn("out", F.when(~F.col("degraded"), cleaned))
    done = asked.mapInPandas(lambda frames: map(again, frames), f"{kept}, degraded boolean, singles int")
    done = done.withColumn("out", outputs.clean(F.col("out"))).withColumn("out", F.when(F.col("out") != "", F.col("out")))
    code = T.check_immediate(F.col("protected"), F.col("out"))
    how = F.when(F.col("out").isNull(), "failed").otherwise(F.coalesce(code, F.when(F.col("degraded"), "single").otherwise("batched")))
    first = F.col("i") == 1
    done = checkpointed(done.select(F.col("original").alias("_o"), placeholders.restore(F.col("out"), F.col("parts")).alias("target"), how.alias("how"), (F.col("calls") + F.col("singles")).alias("requests"), (F.greatest(F.col("calls") - 1, F.lit(0)) + F.greatest(F.col("singles") - 1, F.lit(0))).alias("retried"), (first & ~F.col("degraded")).alias("batched"), (first & F.col("degraded")).alias("degraded"), F.lit(True).alias("own")))
    # A text's counts go with its first unit, so that the rows that come out hold them once.
    out = marked.join(done, F.col("original") == F.col("_o"), "left").join(texts.select(F.col("original").alias("_p"), "first"), F.col("original") == F.col("_p"), "left")
    mine = (F.col("seq") == F.col("first")) & F.coalesce("own", F.lit(False))
    counts = Observation()
    sums = [F.sum(F.when(mine, F.col(n).cast("long")).otherwise(0)).alias(n) for n in ("requests", "retried", "batched", "degraded")]
    ended = lambda *names: F.sum((mine & F.col("how").isin(*names)).cast("long"))
    out = out.observe(counts, F.count("*").alias("units"), F.sum(F.col("_skip").cast("long")).alias("skipped"), F.sum(mine.cast("long")).alias("unique"), *sums, ended("failed").alias("failed"), F.sum((mine & ~F.col("how").isin("failed", "single", "batched")).cast("long")).alias("unverified"))
    return out.select("uid", "original", "target", F.coalesce("how", F.lit("skipped")).alias("how")), counts
