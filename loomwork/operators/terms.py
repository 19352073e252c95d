"""Candidate terms by statistics, and the glossary terms that a text has."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as T

PROPER = r"[A-Z][A-Za-z'\-]*(?:\s+[A-Z][A-Za-z'\-]*){0,2}"
CJK_RUN = r"[぀-ヿ一-鿿]+"


def latin_terms(units: DataFrame, text: str = "original", longest: int | None = None) -> DataFrame:
    """Rows (term, n): capitalised terms of at least three characters; longest: the length above which texts are left out, the reference's 400 for interface strings."""
    some = units if longest is None else units.filter(F.length(text) <= longest)
    found = some.select(F.explode(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0))).alias("term"))
    return found.filter(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("n"))


def ngrams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cjk_terms(units: DataFrame, text: str = "original") -> DataFrame:
    """Rows (term, n, kana): runs of two to four characters within longer runs."""
    runs = units.select(F.explode(F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))).alias("run"))
    grams = runs.select(F.explode(F.concat(*[ngrams(F.col("run"), n) for n in (2, 3, 4)])).alias("term"))
    return grams.groupBy("term").agg(F.count("*").alias("n")).withColumn("kana", F.col("term").rlike(r"[぀-ヿ]"))


def candidates(units: DataFrame, least: int = 3, most: int = 300, longest: int | None = None) -> DataFrame:
    """Rows (term, n): the most frequent terms, those alike but for case as one, in its most frequent form. A top-k: no task sorts all."""
    forms = latin_terms(units, longest=longest)
    merged = forms.groupBy(F.lower("term").alias("k")).agg(F.max_by("term", F.struct("n", "term")).alias("term"), F.sum("n").alias("n"))
    return merged.filter(F.col("n") >= least).select("term", "n").orderBy(F.desc("n"), "term").limit(most)


# Words that begin sentences and are no names, and those taken off the front of a name.
STOP = """
the a an and but or if i you he she it we they this that these those what where when who why how yes no ok oh hey well now then so
just not do did does can could will would should shall may might must is are was were be been being am have has had having get got
go going come came let me my your his her its our their there here never ever always please thank thanks hello hi bye goodbye sir
ma am mr mrs ms dr one two three four five six seven eight nine ten hundred thousand day night morning evening time way thing man
woman boy girl people new old good bad big small long short right left next last first all none found yeah yep nope wow ouch ugh
huh ah eh um anything something everything nothing someone anyone everyone nobody maybe really very much many more most some any
every each other another such only also too still yet again once twice mine yours ours theirs
""".split()
LEAD = "the a an and but or if then so well now oh hey yes no ok just also still yet please thanks hello hi bye".split()
_BLANK = "(?:" + "|".join(map(re.escape, T.SPACES)) + ")"
_LEADING = rf"(?i)^(?:(?:{'|'.join(LEAD)}){_BLANK}+)+"
_CONTRACTION = rf"(?i)^(?:{'|'.join(STOP)})['’][A-Za-z]+$"


def latin_counts(units: DataFrame, order: list[str], text: str = "original", longest: int | None = None) -> DataFrame:
    """Rows (term, n, mid, first) of capitalised terms without leading words: how often, how often inside a sentence, first seen (order and place)."""
    t = T.strip(F.col(text))
    rows = units.select(*order, t.alias("_t")).filter(F.col("_t").rlike("[A-Z]"))
    rows = rows if longest is None else rows.filter(F.length("_t") <= longest)
    rows = rows.select(*order, F.regexp_extract_all("_t", F.lit(PROPER), F.lit(0)).alias("m"), F.split("_t", PROPER, -1).alias("between"))
    # What stands before a term: the end of the text between, or of the term before if there is none.
    near = lambda i: T.rstrip(F.get("between", i))
    last = lambda i: F.when(near(i) != "", F.right(near(i), F.lit(1))).otherwise(F.coalesce(F.right(F.get("m", i - 1), F.lit(1)), F.lit("")))
    found = rows.select(*order, F.posexplode(F.transform("m", lambda m, i: F.struct(m.alias("m"), last(i).alias("before")))).alias("at", "x"))
    term = F.regexp_replace(F.regexp_replace("x.m", _LEADING, ""), f"{_BLANK}+", " ")
    mid = (F.col("x.before") != "") & ~F.col("x.before").isin(*".!?\"'")
    found = found.select(term.alias("term"), mid.cast("long").alias("mid"), F.struct(*order, "at").alias("place")).filter(F.length("term") >= 3)
    return found.groupBy("term").agg(F.count("*").alias("n"), F.sum("mid").alias("mid"), F.min("place").alias("first"))


def noise(term: Column) -> Column:
    """Stop words, their contractions, numbers, and names of code."""
    code = ~term.rlike("[ '-]") & term.rlike("[a-z][A-Z]") & ((F.length(term) > 10) | (F.regexp_count(term, F.lit("[A-Z]")) >= 3))
    return F.lower(term).isin(STOP) | term.rlike("^[0-9]+$") | term.rlike(_CONTRACTION) | code


def scored(units: DataFrame, order: list[str], least: int = 2, most: int = 300, text: str = "original", longest: int | None = None) -> DataFrame:
    """Rows (term, n, score), the `most` best candidate terms; longest: the length above which texts are left out (none by default).

    A capitalised term scores its count, three times its count inside sentences, and its length; those that only begin
    sentences are no candidates. Runs of two to four characters of unspaced scripts score their count and length, with
    kana two more; without kana they have to occur twice as often. Forms alike but for case are one: the counts add up,
    the best score holds, a form with a capital first is shown before one of capitals only, and that before others.
    """
    latin = latin_counts(units, order, text, longest).filter((F.col("n") >= least) & (F.col("mid") > 0) & ~noise(F.col("term")))
    size = lambda most: F.least(F.length("term"), F.lit(most)) if most else F.length("term")
    latin = latin.select("term", "n", (F.col("n") + F.col("mid") * 3 + F.lit(0.3) * size(20)).alias("score"), F.struct(F.lit(0).alias("cjk"), "first").alias("first"))
    rows = units if longest is None else units.filter(F.length(T.strip(F.col(text))) <= longest)
    runs = rows.filter(F.col(text).rlike(CJK_RUN)).select(*order, F.posexplode(F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))).alias("at", "run"))
    grams = runs.select(F.struct(*order, "at").alias("place"), F.posexplode(F.concat(*[ngrams(F.col("run"), k) for k in (2, 3, 4)])).alias("gram", "term"))
    cjk = grams.groupBy("term").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    kana = F.col("term").rlike(r"[぀-ヿ]")
    cjk = cjk.filter(F.col("n") >= F.when(kana, least).otherwise(max(2 * least, 4)))
    cjk = cjk.select("term", "n", (F.col("n") + F.when(kana, 2).otherwise(0) + F.lit(0.3) * F.length("term")).alias("score"), F.struct(F.lit(1).alias("cjk"), "first").alias("first"))
    shown = F.when(F.col("term").rlike("^[A-Z](?:.*[a-z]|[^A-Z]+$)"), 3).when(F.col("term").rlike("^[^a-z]*[A-Z][^a-z]*$"), 2).otherwise(1)
    both = latin.union(cjk).withColumn("form", shown)
    merged = both.groupBy(F.lower("term").alias("k")).agg(F.min_by("term", F.struct(-F.col("form"), F.col("first"))).alias("term"), F.sum("n").alias("n"), F.max("score").alias("score"), F.min("first").alias("first"))
    return merged.orderBy(F.desc("score"), "first", "term").limit(most).select("term", "n", "score")


def with_names(terms: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (term) of terms and of the originals of units whose kind is a name, at most 40 characters long."""
    names = units.filter(F.lower("kind").contains("name")).select(T.strip(F.col("original")).alias("term")).filter(F.length("term").between(1, 40))
    return terms.select("term").union(names).distinct()


#: The most glossary rows that are compared with every text; above it texts and terms meet by their beginnings.
FEW = 1000


def matching(rows: DataFrame, glossary: DataFrame, text: str) -> DataFrame:
    """rows with the columns of glossary (term, ...), one row for each of its terms that the text holds.

    Up to FEW terms are broadcast and looked for in each text; more are joined by their first characters (three, or all
    of a shorter term) with the different runs of characters of a text, so work doesn't grow with texts times terms.
    """
    if glossary.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(glossary), F.contains(rows[text], glossary["term"]))
    wide = glossary.filter("term <> ''").withColumn("_gram", F.substring("term", 1, 3))
    sizes = [r.n for r in wide.select(F.length("_gram").alias("n")).distinct().sort("n").collect()]  # at most three
    grams = F.array_distinct(F.concat(*[ngrams(F.col(text), n) for n in sizes]))
    return rows.withColumn("_gram", F.explode(grams)).join(wide, "_gram").filter(F.contains(text, "term")).drop("_gram")


def relevant(units: DataFrame, glossary: DataFrame, most: int = 20) -> DataFrame:
    """Rows (uid, term, place): the terms (ord, term) in each text, the longest first; at most `most`, which is the feature."""
    hits = matching(units, glossary.filter("term <> ''"), "original")
    place = F.row_number().over(W.partitionBy("uid").orderBy(F.desc(F.length("term")), "ord"))
    return hits.select("uid", "term", place.alias("place")).filter(F.col("place") <= most)
