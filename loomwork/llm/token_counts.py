"""Token counts: pieces are counted once per distinct pre-token and joined to each text's pre-token frequencies.

A pre-token is a run of bytes other than ASCII white space. The tokenizer's own pre-tokens never cross white
space and nothing that it normalises does, so the pieces of a text are the sum over its pre-tokens. The corpus is
read twice. First tasks give their distinct pre-tokens with frequencies (combined in a table of bounded size, so that
a frequent word is a row or two of a task), which add up to a table of all; its pieces are counted, once each. Then each
text's frequencies are joined to it: those of the most frequent pre-tokens, as many as `frequent` and `frequent_bytes`
allow, from a broadcast table, all others by a join on the pre-token, in which no key is hot as the hot ones are gone.
Sums come back to a text by the number of its row. No ids leave the tokenizer. Pre-tokens of more than `longest` bytes
are counted where they stand, so no key of a join is huge. The pieces of a sentencepiece model may cross white space, so
with a .model file each text is counted whole.

Null and empty texts have 0 bytes and 0 tokens. Every row is counted by itself, repeated rows alike; other
columns are ignored whatever their names, an empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, slices


def piece_counter(path: str):
    """A function from a list of strings to their numbers of pieces, for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _distinct(docs: DataFrame, text: str, table_size: int, longest: int) -> DataFrame:
    """Rows (word, n): all pre-tokens with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(known.keys()), pa.binary()), pa.array(list(known.values()), pa.int64())], ["word", "n"])
            known.clear()
            return out

        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for t in texts:
                    known.update(w for w in t.encode().split() if len(w) <= longest)
                if len(known) > table_size:
                    yield told()
        yield told()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(words: DataFrame, path: str) -> DataFrame:
    """words with pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = piece_counter(path)
        for batch in batches:
            counts = pieces_of([w.decode() for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["word", "n", "pieces"])

    return words.mapInArrow(run, "word binary, n long, pieces long")


def _most_frequent(words: DataFrame, frequent: int, frequent_bytes: int) -> tuple[dict[bytes, int], float]:
    """The pieces of the most frequent pre-tokens within both bounds, and the step of frequency (an eighth of a doubling) from which on they are those."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    least, n, size = float("inf"), 0, 0
    for row in sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.sum(F.octet_length("word")).alias("b")).collect(), key=lambda r: -r.step):  # at most 512 steps
        n, size = n + row.c, size + row.b
        if n > frequent or size > frequent_bytes:
            break
        least = float(row.step)
    rows = words.filter(step >= least).select("word", "pieces").toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["pieces"].to_pylist(), strict=True)), least


def _whole(docs: DataFrame, path: str, limit: int, key: str, text: str) -> DataFrame:
    """count_tokens() text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = piece_counter(path)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                n = pieces_of(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text", frequent: int = 400_000, frequent_bytes: int = 1 << 23, table_size: int = 200_000, longest: int = 4096) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit). path: a tokenizers file whose pre-tokens don't cross white space. frequent and frequent_bytes bound the broadcast table, table_size each task's table of frequencies."""
    if path.endswith(".model"):
        return _whole(docs, path, limit, key, text)
    words = checkpointed(_counted(checkpointed(_distinct(docs, text, table_size, longest)), path))
    shared = docs.sparkSession.sparkContext.broadcast(_most_frequent(words, frequent, frequent_bytes)[0])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces_of = shared.value, None
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                sizes, sums, ends, rest, times = [], [], [0], [], []
                for t in texts:
                    data, total = t.encode(), 0
                    for w, n in Counter(data.split()).items():
                        if (p := known.get(w)) is not None:
                            total += n * p
                        elif len(w) > longest:
                            pieces_of = pieces_of or piece_counter(path)
                            total += n * pieces_of([w.decode()])[0]
                        else:
                            rest.append(w)
                            times.append(n)
                    sizes.append(len(data))
                    sums.append(total)
                    ends.append(len(rest))
                left = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int32())], ["word", "times"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), left], ["_key", "n_bytes", "sum", "rest"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text).mapInArrow(joined, f"_key {kind}, n_bytes long, sum long, rest array<struct<word: binary, times: int>>")
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    more = rows.select("_row", F.inline("rest")).join(words.select("word", "pieces"), "word").groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = rows.select("_key", "n_bytes", "sum", "_row").join(more, "_row", "left").withColumn("n_tokens", F.col("sum") + F.coalesce("more", F.lit(0)))
    return out.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
