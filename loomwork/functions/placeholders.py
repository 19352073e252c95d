"""Placeholders: what a transformation must not touch is taken out of a text, numbered, and put back afterwards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# The kinds of protected strings, in the order in which they are taken out.
PATTERNS = {
    "name in brackets": r"\[[A-Za-z_][\w\.\[\]'\"]*\]",
    "escaped sign": r"\\[\[\]{}<>#/:\\]",
    "tag behind #": r"#[^\s#$<]{1,64}",
    "word in brackets": r"(?<!\[)\[/?[A-Za-z][\w\-]*(?:\s*=\s*[^\]\s]*)?\]",
    "escaped letter": r"\\[nrt\"'\\]",
    "braces": r"\{[^{}]{0,120}\}",
    "percent form": r"%\d*\$?[sdifxXeEgc%]",
    "angle tag": r"</?[a-zA-Z][\w\-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^<>\"'\s]{1,120}))?\s*/?>",
    "numbered control": r"\\[VNCIEX]{1,2}\[\d+\]",
    "dollar name": r"\$[A-Za-z_][\w\.\[\]]*",
    "line mark": r"#line:[0-9a-fA-F]+\b",
    "double angle": r"<<.*?>>",
    "double bracket": r"\[\[[^\]]+\]\]",
}
#: Signs of which each of these strings holds one; most texts have none.
SIGNS = r"[\[\\#{%<$]"
OPEN, CLOSE = "【", "】"
NUMBER = f"{OPEN}[0-9]+{CLOSE}"
_NUMBER = re.compile(f"{OPEN}([0-9]+){CLOSE}")
#: A number as it may come back: in other brackets or with blanks.
VARIANT = rf"{NUMBER}|\[(?:0|[1-9][0-9]*)\]|\((?:0|[1-9][0-9]*)\)|{OPEN} ?(?:0|[1-9][0-9]*) ?{CLOSE}"


def _woven(text: Column, pattern: str, filling: Column) -> Column:
    """text, each match of pattern replaced by the string of filling at its place."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), filling, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _filled(text: Column, pattern: str, parts: Column) -> Column:
    """text, each number that parts have replaced by its part, in one pass: what is put in isn't looked at again."""
    at = lambda x: F.regexp_extract(x, "[0-9]+", 0).try_cast("int")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _woven(text, pattern, F.transform(found, lambda x: F.coalesce(F.get(parts, at(x)), x)))


def taken_out(text: str, patterns: list[re.Pattern]) -> tuple[str, list[str]]:
    """text with numbers, and what they stand for."""
    parts: list[str] = []
    for pattern in patterns:
        known = len(parts)

        def number(m: re.Match, known: int = known) -> str:
            inner = _NUMBER.sub(lambda n: parts[int(n[1])] if int(n[1]) < known else n[0], m[0])
            parts.append(inner)
            return f"{OPEN}{len(parts) - 1}{CLOSE}"

        text = pattern.sub(number, text)
    return text, parts


def has_protected(text: Column) -> Column:
    """Whether a text holds any protected string; null texts hold none."""
    return F.coalesce(text.rlike(SIGNS) & text.rlike("|".join(f"(?:{p})" for p in PATTERNS.values())), F.lit(False))


def protect(df: DataFrame, text: str, patterns: list[str] | None = None) -> DataFrame:
    """df with protected (text with numbers) and parts (what they stand for); null texts are empty. Parts hold no numbers of other parts.

    The patterns build on each other's results, so that as columns each would nest in the next; a batch of texts goes
    through them in one call instead; texts without any of the patterns' signs don't go there. Nothing is shuffled.
    """
    chosen = patterns or list(PATTERNS.values())

    def run(texts: pd.Series) -> pd.DataFrame:
        compiled = [re.compile(p) for p in chosen]
        return pd.DataFrame([taken_out(t or "", compiled) for t in texts], columns=["protected", "parts"])

    kind = StructType().add("protected", "string").add("parts", ArrayType(StringType()))
    some = F.coalesce(F.col(text).rlike(SIGNS), F.lit(False)) if patterns is None else F.lit(True)
    out = df.withColumn("_taken", F.pandas_udf(run, kind)(F.when(some, F.col(text))))
    none = F.array().cast("array<string>")
    return out.withColumns({"protected": F.when(some, F.col("_taken.protected")).otherwise(F.coalesce(F.col(text), F.lit(""))), "parts": F.when(some, F.col("_taken.parts")).otherwise(none)}).drop("_taken")


def restore(text: Column, parts: Column) -> Column:
    """text with the parts put back, also where a number's brackets have been changed; unknown numbers stay. Texts without parts, which most are, aren't looked through."""
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, _filled(text, VARIANT, parts)).otherwise(text)
