"""The transformation of units by a function of texts, such as a model: each distinct text once, checked, fanned out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import placeholders
from loomwork.functions import text as T


def transform(units: DataFrame, call: Callable[[list[str]], list[str]], script: str = "hanzi", batch: int = 8, retries: int = 1, failures: tuple = (OSError, ValueError)) -> DataFrame:
    """Rows (uid, original, target, how) of units (uid, original); how: skipped, done, or the code of the rule that the last output breaks.

    call gets lists of at most `batch` texts with placeholders. A batch that fails (with one of `failures`; other errors
    end the job) or comes back in another length is done text by text. Texts whose output breaks a rule are tried again
    one by one, `retries` times; the last output is kept, how naming its rule, so that it can be looked at. What fails
    to the end has the target null and the code empty. Distinct texts are shuffled once and joined back; call runs inside
    tasks, whose retries after a lost executor repeat only their own texts.
    """

    def one(x: str) -> str | None:
        try:
            return call([x])[0]
        except failures:  # of a service: tried again with those that break a rule
            return None

    def many(xs: list[str]) -> list[str | None]:
        try:
            got = call(xs)
        except failures:  # as above: the batch is done text by text
            got = []
        return got if len(got) == len(xs) else [one(x) for x in xs]

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = f["protected"].tolist()
            yield f.assign(_out=[y for i in range(0, len(xs), batch) for y in many(xs[i : i + batch])])

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tried = [y if code is None else one(x) or y for x, y, code in zip(f["protected"], f["_out"], f["code"].where(f["code"].notna(), None), strict=True)]
            yield f.assign(_out=tried)[["original", "protected", "parts", "_out"]]

    kept = "original string, protected string, parts array<string>, _out string"
    open_ = units.filter(~T.should_skip(F.col("original"), script))
    done = placeholders.protect(open_.select("original").distinct(), "original").mapInPandas(first, kept)
    code = T.check_immediate(F.col("protected"), F.col("_out"))
    for _ in range(retries):
        done = done.withColumn("code", code).mapInPandas(again, kept)
    done = done.select(F.col("original").alias("_o"), placeholders.restore(F.col("_out"), F.col("parts")).alias("target"), F.coalesce(code, F.lit("done")).alias("how"))
    out = units.join(done, F.col("original") == F.col("_o"), "left")
    return out.select("uid", "original", "target", F.coalesce("how", F.lit("skipped")).alias("how"))
