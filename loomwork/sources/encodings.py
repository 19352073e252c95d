"""Texts in any of several encodings: told by their marks, else by trial, and written back as the bytes they were.

Bytes in UTF-8, with or without a mark, which most are, are told and decoded by built-in functions; only others go
through Python, in batches. The trial is in order: what is valid UTF-8 is that, then what is valid Shift-JIS, then the
fallback, in which bytes that aren't valid are replaced; such a text isn't written back, as its bytes are lost.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Marks and the encodings that they name, by the first that fits.
MARKS = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "utf-8": b"\xef\xbb\xbf"}
TRIED = ["utf-8", "shift_jis"]
DECODED = StructType().add("text", "string").add("charset", "string").add("mark", "boolean").add("lossy", "boolean")


def told(data: bytes | None, fallback: str) -> tuple[str | None, str | None, bool, bool]:
    """Text, charset, whether a mark came first, whether bytes were lost."""
    if data is None:
        return None, None, False, False
    for charset, mark in MARKS.items():
        if data.startswith(mark):
            body = data[len(mark) :]
            try:
                return body.decode(charset), charset, True, False
            except UnicodeDecodeError:
                return body.decode(charset, "replace"), charset, True, True
    for charset in [*TRIED, fallback]:
        try:
            text = data.decode(charset)
        except UnicodeDecodeError:
            continue
        if text.encode(charset, "ignore") == data:  # some bytes have a second form
            return text, charset, False, False
    return data.decode(fallback, "replace"), fallback, False, True


def decoded(data: Column, fallback: str = "utf-16-le") -> Column:
    """A struct (text, charset, mark, lossy) of binary data; the text has no mark."""

    @F.pandas_udf(DECODED)
    def others(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([told(None if d is None else bytes(d), fallback) for d in x], columns=DECODED.names)

    mark = F.coalesce(F.substring(data, 1, 3) == F.lit(MARKS["utf-8"]), F.lit(False))
    plain = F.is_valid_utf8(data.cast("string")) & ~F.substring(data, 1, 2).isin(*[F.lit(m) for m in (MARKS["utf-16-le"], MARKS["utf-16-be"])])
    body = F.when(mark, F.substring(data, 4, 2**31 - 1)).otherwise(data).cast("string")
    own = F.struct(body.alias("text"), F.lit("utf-8").alias("charset"), mark.alias("mark"), F.lit(False).alias("lossy"))
    return F.when(plain, own).otherwise(others(F.when(~plain | plain.isNull(), data)))


def encoded(text: Column, charset: Column, mark: Column) -> Column:
    """The bytes of a text in its charset, its mark before; null where the charset can't say a sign of it."""

    @F.pandas_udf("binary")
    def others(texts: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(t: str | None, c: str | None) -> bytes | None:
            if t is None or c is None:
                return None
            try:
                return t.encode(c)
            except UnicodeEncodeError:
                return None

        return pd.Series([one(t, c) for t, c in zip(texts, charsets, strict=True)], dtype=object)

    plain = charset == "utf-8"
    body = F.when(plain, text.cast("binary")).otherwise(others(F.when(~plain, text), charset))
    first = F.lit(b"")
    for name, m in MARKS.items():
        first = F.when(mark & (charset == name), F.lit(m)).otherwise(first)
    return F.concat(first, body)


def read_texts(spark: SparkSession, path: str, fallback: str = "utf-16-le", largest: int = 8 << 20) -> DataFrame:
    """Rows (path, text, charset, mark, lossy, newline, trailing) of files of up to `largest` bytes."""
    raw = spark.read.format("binaryFile").load(path).filter(F.col("length") <= largest)
    x = raw.select("path", decoded(F.col("content"), fallback).alias("x")).select("path", "x.*")
    return x.withColumns({"newline": F.when(F.contains("text", F.lit("\r\n")), "\r\n").otherwise("\n"), "trailing": F.endswith("text", F.lit("\n"))})


def file_data(files: DataFrame, rel: Column) -> DataFrame:
    """Rows (rel, data) for the file sink, of files (text, charset, mark, lossy); files that lost bytes, or whose new text their charset can't say, are left out."""
    data = encoded(F.col("text"), F.col("charset"), F.col("mark"))
    return files.filter(~F.col("lossy")).select(rel.alias("rel"), data.alias("data")).filter("data is not null")
