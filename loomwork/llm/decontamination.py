"""Benchmark decontamination by a distributed positional inverted index.

The corpus is read once to count the terms of the test items. Each window of an item (13 consecutive words; the
whole item if it has fewer) is then looked up by its two rarest terms: the corpus's postings (document, position)
of such terms are stored, adjusted by the term's place in the item to the diagonal position - place, and the
diagonals that the rarest and the second rarest terms have in common are the candidates. On these all windows
are compared word by word, so exact occurrences remain. near_phrases() does the same within a proximity.

A document word is hit if it lies in an occurrence. All of it is built-in DataFrame functions. Postings are rows
dealt by document and diagonal, so a frequent term or passage is never gathered in a task.

Null and empty texts have no words, items without words have no windows. Items with a null id hit words but are
not listed; rows that repeat an item_id count as one item. Rows that repeat a doc_id are judged by their own
texts. Other columns are ignored, an empty table gives no rows, an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, bounded, checkpointed, rowed

#: What lies between words, before and after A-Z are lower-cased: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words, not yet lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def words(text: Column) -> Column:
    return raw_words(ascii_lower(F.coalesce(text, F.lit(""))))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _h and text: rows alike in key and text share _id and _h."""
    return docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(key), F.col(text)).alias("_h"), F.col(text).alias("_text"))


def tokens(docs: DataFrame) -> DataFrame:
    """Rows (_id, _h, pos, term) of keyed()."""
    split = docs.select("_id", "_h", F.posexplode(raw_words(F.col("_text"))).alias("pos", "term"))
    return split.withColumn("term", ascii_lower(F.col("term")))


def same(a: DataFrame, b: DataFrame, names: list[str]) -> list[Column]:
    return [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct items: item, iwords, w (words in a window)."""
    items = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("iwords")).filter(F.size("iwords") > 0).distinct()
    return items.withColumn("w", F.least(F.lit(n), F.size("iwords"))).withColumn("_i", F.xxhash64("item", "iwords"))


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = 13, key: str = "doc_id", text: str = "text", most: int = 1_000_000) -> DataFrame:
    """Rows (_id, _h, item, start, w): windows of w words from word `start` of a document that some item has. most bounds the rows of a broadcast table; larger ones are shuffled."""
    rows = keyed(docs, key, text)
    items = checkpointed(item_windows(benchmark, n))
    places = items.select("_i", "w", F.size("iwords").alias("n"), F.posexplode("iwords").alias("q", "term"))

    vocabulary, hint = bounded(checkpointed(places.select("term").distinct()), most)
    found = checkpointed(tokens(rows).join(hint(vocabulary), "term", "left_semi").groupBy("term").count())

    # Each window's two rarest terms that occur; a window with a term that doesn't occur isn't anywhere.
    known = places.join(found, "term", "left").select("_i", "w", "n", "q", "term", F.coalesce("count", F.lit(0)).alias("count"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("w") + 1), F.least(F.col("q"), F.col("n") - F.col("w")))
    windows = known.withColumn("s", F.explode(starts)).groupBy("_i", "s").agg(F.slice(F.array_sort(F.collect_list(F.struct("count", "q", "term"))), 1, 2).alias("rare"))
    windows = windows.filter(F.col("rare")[0]["count"] > 0)
    anchors = windows.select("_i", F.posexplode("rare").alias("nth", "x")).select("_i", "nth", F.col("x.q").alias("q"), F.col("x.term").alias("term")).distinct()
    anchors = anchors.join(items.select("_i", F.size("iwords").alias("n"), "w"), "_i")
    anchors, hint = bounded(checkpointed(anchors), most)

    # The index: postings of the anchor terms.
    postings = checkpointed(tokens(rows).join(hint(anchors.select("term").distinct()), "term", "left_semi"))
    lists = postings.join(hint(anchors), "term").select("_id", "_h", "_i", "n", "w", (F.col("pos") - F.col("q")).alias("diagonal"), "nth")
    both = lists.groupBy("_id", "_h", "_i", "n", "w", "diagonal").agg(F.min("nth").alias("low"), F.max("nth").alias("high"))
    shared = checkpointed(both.filter("(low = 0 and high = 1) or n = 1").drop("low", "high"))

    # All windows of the candidates, word by word.
    some, hint = bounded(shared.select("_id", "_h").distinct(), most)
    read = rows.alias("a").join(hint(some).alias("b"), same(rows, some, ["_id", "_h"]), "left_semi").select("_id", "_h", words(F.col("_text")).alias("dwords"))
    # A candidate carries the words beside its item, not the text's: a text of n like words has n diagonals.
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    beside = F.slice("dwords", low + F.col("diagonal") + 1, F.col("n") - low)
    cand = read.alias("a").join(shared.alias("b"), same(read, shared, ["_id", "_h"])).select("a._id", "a._h", "_i", "diagonal", low.alias("low"), beside.alias("beside"))
    few, hint = bounded(items, most // 50)
    cand = cand.join(hint(few), "_i").filter(F.size("beside") >= F.col("w"))
    at = F.sequence(F.lit(0), F.size("beside") - F.col("w"))
    equal = F.filter(at, lambda i: F.slice("iwords", F.col("low") + i + 1, F.col("w")) == F.slice("beside", i + 1, F.col("w")))
    out = cand.select("_id", "_h", "item", "w", F.explode(equal).alias("i"), "diagonal", "low")
    return out.select("_id", "_h", "item", (F.col("i") + F.col("low") + F.col("diagonal")).alias("start"), "w").distinct()


def judge(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_hit, items, contaminated, row_hash), one for each row of docs. A document is contaminated if at least one word in `share` is hit."""
    found = checkpointed(occurrences(docs, benchmark, n, key, text))
    covered = found.select("_id", "_h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("w") - 1)).alias("pos")).distinct()
    hits = covered.groupBy("_id", "_h").agg(F.count("*").alias("n_hit"))
    names = found.filter("item is not null").groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    hits = hits.alias("a").join(names.alias("b"), same(hits, names, ["_id", "_h"]), "left").select("a._id", "a._h", "n_hit", "items")
    rows = keyed(docs, key, text).select("_id", "_h", F.size(raw_words(F.col("_text"))).cast("long").alias("n_words"))
    out = rows.alias("a").join(hits.alias("b"), same(rows, hits, ["_id", "_h"]), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("a._id").alias(key), "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"), F.col("a._h").alias("row_hash"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", most: int = 500_000, **options) -> DataFrame:
    """docs, with all columns, without the contaminated ones.

    Null and empty texts stay; rows that repeat a key are judged by their own texts, null keys too. Columns may have any
    names. An empty table gives no rows, an empty benchmark takes nothing out.
    """
    found = judge(docs, benchmark, key=key, text=text, **options).filter("contaminated")
    gone, hint = bounded(checkpointed(found.select(F.col(key).alias("_id"), F.col("row_hash").alias("_h")).distinct()), most)
    own = F.col("row").getField(key), F.col("row").getField(text)
    return rowed(docs).join(hint(gone), own[0].eqNullSafe(F.col("_id")) & (F.xxhash64(*own) == F.col("_h")), "left_anti").select("row.*")


def near_phrases(docs: DataFrame, phrases: DataFrame, slack: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (_id, item, start, end): where all the words of a short item occur in order, each at most `slack` words after its place behind the one before."""
    rows = keyed(docs, key, text)
    items = checkpointed(item_windows(phrases, 1 << 20))
    places = items.select("_i", F.size("iwords").alias("n"), F.posexplode("iwords").alias("q", "term"))
    listed = tokens(rows).join(places, "term").select("_id", "_h", "_i", "n", "q", "pos")
    now = listed.filter("q = 0").select("_id", "_h", "_i", "n", F.col("pos").alias("start"), F.col("pos").alias("end"))
    longest = items.agg(F.max(F.size("iwords"))).first()[0] or 0
    out = now.filter("n = 1")
    for q in range(1, longest):
        then = listed.filter(F.col("q") == q).drop("n", "q")
        near = (F.col("b.pos") > F.col("a.end")) & (F.col("b.pos") <= F.col("a.end") + 1 + slack)
        now = now.alias("a").join(then.alias("b"), [*same(now, then, ["_id", "_h", "_i"]), near]).select("a._id", "a._h", "a._i", "a.n", "a.start", F.col("b.pos").alias("end")).distinct()
        # All ends of a start go on: a later one may be the only one from which the next word is in reach.
        now = checkpointed(now)
        out = out.union(now.filter(F.col("n") == q + 1))
    out = out.groupBy("_id", "_h", "_i", "start").agg(F.min("end").alias("end"))
    return out.join(items.select("_i", "item"), "_i").select("_id", "item", "start", "end").distinct()
