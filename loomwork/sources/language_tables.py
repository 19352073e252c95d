"""Language tables anywhere in trees: objects that hold a list of terms and a list of languages, at any depth of JSON.

Trees are VARIANT values. Their levels are explodes: each round tells the tables of a level by their shape and passes
the children of all other nodes on, so that a tree of any form is searched without a walker of its own. A table's source
column is its first English language, else its first real one; languages without a code are columns of data about terms,
whose texts must not be changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import outputs
from loomwork.functions import text as T
from loomwork.tables import checkpointed

TERMS, LANGUAGES, TEXTS, CODE = "mTerms", "mLanguages", "Languages", "Code"


def trees(files: DataFrame, text: str = "text") -> DataFrame:
    """files with tree: text as VARIANT, null for what isn't JSON."""
    return files.withColumn("tree", F.try_parse_json(text))


def _held(node: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def tables(files: DataFrame, key: str = "path", text: str = "text", most_depth: int = 64) -> DataFrame:
    """Rows (key, place, node): the language tables of files (key, text); place is the way to the table, keys and numbers as strings.

    A table has a list of terms that isn't empty, and a list of languages; tables lie in tables too, but not in terms.
    Texts that aren't JSON have none. Rows of a key are searched each by itself. Nodes below most_depth levels fail the
    query, they aren't passed over.
    """
    some = files.filter(F.contains(text, F.lit(TERMS)))
    now = trees(some, text).select(F.col(key).alias("key"), F.array().cast("array<string>").alias("place"), F.col("tree").alias("node")).filter("node is not null")
    found = []
    for _ in range(most_depth + 1):
        now = checkpointed(now)
        if now.isEmpty():
            break
        terms = _held(F.col("node"), TERMS, "array<variant>")
        is_table = F.coalesce(F.size(terms) > 0, F.lit(False)) & F.schema_of_variant("node").rlike(rf"^OBJECT<(.*, )?{LANGUAGES}: ")
        has = F.when(F.to_json("node").contains(f'"{TERMS}"'), is_table).otherwise(F.lit(False))
        marked = now.withColumn("is_table", has)
        found.append(marked.filter("is_table").drop("is_table"))
        # Only what may still hold a table goes on: objects and lists in whose JSON the name of the terms stands.
        marked.createOrReplaceTempView("language_nodes")
        below = now.sparkSession.sql(f"""SELECT n.key, array_append(n.place, coalesce(c.key, CAST(c.pos AS STRING))) AS place, c.value AS node
            FROM language_nodes n, LATERAL variant_explode(n.node) c WHERE NOT (n.is_table AND c.key <=> '{TERMS}')""")
        now = below.filter(F.to_json("node").rlike(rf'^[\[{{].*"{TERMS}"'))
    else:
        raise ValueError(f"trees of more than {most_depth} levels")
    if not found:
        return now
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def source_column(node: Column) -> Column:
    """The number of a table's source column: its first language whose code begins with en, else the first with a code; null without any."""
    codes = F.transform(_held(node, LANGUAGES, "array<variant>"), lambda x, i: F.struct(i.alias("i"), F.trim(F.coalesce(_held(x, CODE, "string"), F.lit(""))).alias("code")))
    real = F.filter(codes, lambda x: x["code"] != "")
    english = F.filter(real, lambda x: F.lower(x["code"]).startswith("en"))
    return F.get(F.concat(english, real), F.lit(0))["i"]


def language_units(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Rows (key, place, original) of files (key, text): the texts of the source column of all their language tables that people read, stripped."""
    held = tables(files, key, text).withColumn("column", source_column(F.col("node"))).filter("column is not null")
    terms = held.select("key", "place", "column", F.posexplode(_held(F.col("node"), TERMS, "array<variant>")).alias("i", "term"))
    value = F.get(_held(F.col("term"), TEXTS, "array<variant>"), F.col("column"))
    said = terms.withColumn("value", value).filter(F.schema_of_variant("value") == "STRING").withColumn("value", F.try_variant_get("value", "$", "string"))
    place = F.concat("place", F.array(F.lit(TERMS), F.col("i").cast("string"), F.lit(TEXTS), F.col("column").cast("string")))
    return said.filter(outputs.table_text_ok(F.col("value"))).select(F.col("key").alias(key), place.alias("place"), T.strip(F.col("value")).alias("original"))
