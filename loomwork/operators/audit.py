"""Audits of transformed units (uid, original, target, optionally protected_form): rules by row and one over equal targets.

A unit's source is its protected_form, the text with numbers for what must not be touched; where that is null, empty
or no column, the original. Targets are stripped, sources aren't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.terms import matching

#: Of each code its level and whether to send the unit again.
ISSUES = {
    "empty": ("warn", True), "placeholder": ("warn", True), "untranslated": ("warn", True), "term_miss": ("info", True), "dup_target": ("info", True),
    "too_short": ("info", True), "too_long": ("info", True), "prefix_residue": ("info", True), "identical": ("info", True), "model_flag": ("warn", True),
}


def sides(units: DataFrame) -> DataFrame:
    """Rows (uid, src, dst)."""
    src = F.coalesce(F.nullif(F.col("protected_form"), F.lit("")), "original") if "protected_form" in units.columns else F.col("original")
    return units.select("uid", F.coalesce(src, F.lit("")).alias("src"), T.strip(F.col("target")).alias("dst"))


def _misses(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    hit = matching(rows, glossary.filter("term <> '' and want <> ''"), "src").filter(~F.contains("dst", "want"))
    return hit.groupBy("uid").agg(F.min_by("term", "ord").alias("term"))


def term_misses(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """Rows (uid, term): the first glossary term (ord, term, want) that the source has and whose want the target lacks."""
    return _misses(sides(units).filter("dst <> ''"), glossary)


def audit_rows(rows: DataFrame, kana_target: bool = False) -> DataFrame:
    """Rows (uid, code) of sides(), as many for a unit as rules that it breaks: one scan, no shuffle. kana_target: the target's script is kana, so that kana left in it say nothing."""
    src, dst, n, m = F.col("src"), F.col("dst"), F.length("src"), F.length("dst")
    rows = rows.withColumn("_tokens", F.when(src.contains("【"), T.tokens(src))).withColumn("_kana", src.rlike(T.KANA))
    full = dst != ""
    codes = F.array_compact(F.array(
        F.when(~full, "empty"),
        F.when(full & F.col("_kana") & (src == dst), "identical"),
        F.when(full & F.col("_kana") & (src != dst) & (T.kana_share(dst) > 0.3), "untranslated") if not kana_target else F.lit(None),
        F.when(full & (F.size("_tokens") > 0) & (F.col("_tokens") != T.tokens(dst)), "placeholder"),
        F.when(full & (n >= 6) & (4 * m < n), "too_short"),
        F.when(full & (n >= 6) & (m > 4 * n), "too_long"),
        F.when(T.has_bad_prefix(dst), "prefix_residue"),
    ))
    return rows.select("uid", F.explode(codes).alias("code"))


def _doubled(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.length("dst") >= 2)
    groups = rows.groupBy("dst", "src").agg(F.count("*").alias("c")).groupBy("dst").agg(F.sum("c").alias("n"), F.count("*").alias("sources"), F.max(F.length("src")).alias("longest"))
    groups = groups.filter("n >= 2 and sources >= 2 and not (length(dst) <= 3 and longest <= 3)").select("dst", "n")
    return rows.join(groups, "dst").select("uid", F.col("dst").alias("target"), "n")


def dup_targets(units: DataFrame) -> DataFrame:
    """Rows (uid, target, n): units whose target different sources share. Groups are aggregates joined back, never gathered."""
    return _doubled(sides(units))


def issues(units: DataFrame, glossary: DataFrame, kana_target: bool = False) -> DataFrame:
    """Rows (uid, code) of all rules."""
    rows = sides(units)
    missed = _misses(rows.filter("dst <> ''"), glossary).select("uid", F.lit("term_miss").alias("code"))
    return audit_rows(rows, kana_target).union(missed).union(_doubled(rows).select("uid", F.lit("dup_target").alias("code")))


def described(found: DataFrame) -> DataFrame:
    """issues() with level and resend; other codes are info and sent again."""
    column = lambda i: F.create_map(*[F.lit(x) for code, meta in ISSUES.items() for x in (code, meta[i])])
    return found.withColumns({"level": F.coalesce(F.try_element_at(column(0), F.col("code")), F.lit("info")), "resend": F.coalesce(F.try_element_at(column(1), F.col("code")), F.lit(True))})
