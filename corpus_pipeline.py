"""The corpus pipeline: documents through five stages, each of them one operator over all that the one before kept.

All stages but the last return the columns of documents as they came, whatever other columns there are and however they
are called. Null and empty texts pass all stages (score 0, classes of their own, no words, nothing to redact, no words
to take). Rows that repeat a doc_id are judged by their own texts; of rows alike in doc_id and text near_dedup keeps one.
A null doc_id is a key like others. Texts of any length are worked on whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import decontamination, mixing, near_dedup, pii, toxicity
from loomwork.llm.shared import checkpointed, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below a half; without labels of both classes all of them."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each class of near duplicates; a null doc_id only where the class has no other."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in windows of benchmark items; without items all of them."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in angle brackets, n_chars counted anew (null for a null text)."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken; a null source is one of its own, ties go by doc_id."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("pii", private), ("mixing", mixture)]

#: Training a classifier and sketches are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
