"""Change logs, translation memories, packages and overlays: joins by key with a defined winner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import ordered


def latest(journal: DataFrame) -> DataFrame:
    """Rows (uid, t, uv): the last entry of each uid by seq of those with a text. An aggregate, combined before the shuffle."""
    return journal.filter("t is not null").groupBy("uid").agg(F.max_by(F.struct("t", "uv"), "seq").alias("x")).select("uid", "x.t", "x.uv")


def replay(units: DataFrame, journal: DataFrame) -> DataFrame:
    """units (uid, ..., target) with the last entries of the journal written in; unknown uids have no effect."""
    last = latest(journal).withColumnsRenamed({"t": "_t", "uv": "_uv"})
    out = units.join(last, "uid", "left")
    return out.withColumn("target", F.coalesce("_t", "target")).withColumn("unverified", F.coalesce(F.col("_uv") == 1, F.lit(False))).drop("_t", "_uv")


def memory(pairs: DataFrame) -> DataFrame:
    """Rows (original, target): the most frequent target of each original of pairs (seq, original, target), the first seen on ties."""
    counted = pairs.filter("original <> '' and target <> ''").groupBy("original", "target").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counted.groupBy("original").agg(F.max_by("target", F.struct("n", -F.col("first"))).alias("target"))


def import_package(units: DataFrame, package: DataFrame, use_memory: bool = True) -> DataFrame:
    """units (uid, original, target) with how (kept, uid, memory or missed) and filled: from package (seq, uid, original, target) by uid, else by text."""
    exact = package.filter("target <> ''").groupBy("uid").agg(F.max_by("target", "seq").alias("_u"))
    out = units.join(exact, "uid", "left")
    known = memory(package).select(F.col("original").alias("_o"), F.col("target").alias("_m"))
    out = out.join(known, F.col("original") == F.col("_o"), "left") if use_memory else out.withColumn("_m", F.lit(None).cast("string"))
    how = F.when(F.coalesce("target", F.lit("")) != "", "kept").when(F.col("_u").isNotNull(), "uid").when(F.col("_m").isNotNull(), "memory").otherwise("missed")
    return out.select("uid", "original", how.alias("how"), F.coalesce(F.when(F.col("target") != "", F.col("target")), "_u", "_m").alias("filled"))


def overlay(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value, side) of either side; what lies over wins."""
    a, b = base.select(key, F.col(value).alias("_a")), over.select(key, F.col(value).alias("_b"))
    side = F.when(F.col("_b").isNull(), "base").when(F.col("_a").isNull(), "new").otherwise("over")
    return a.join(b, key, "full").select(key, F.coalesce("_b", "_a").alias(value), side.alias("side"))


def fingerprint_verdicts(games: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows (game, package, verdict) for packages that share a feature name with a game, by an equi-join on features: match if all of the package's are there, else partial."""
    feature = lambda df, name: df.select(name, F.explode("features").alias("f")).select(name, F.lower("f").alias("f")).distinct()
    total = feature(packages, "package").groupBy("package").agg(F.count("*").alias("all"))
    shared = feature(games, "game").join(feature(packages, "package"), "f").groupBy("game", "package").agg(F.count("*").alias("n"))
    return shared.join(total, "package").select("game", "package", F.when(F.col("n") == F.col("all"), "match").otherwise("partial").alias("verdict"))


#: Classes of names by which a game and a package are compared.
CLASSES = ["exe", "data_dirs", "packs", "dirs"]


def _named(df: DataFrame, key: str) -> DataFrame:
    """df with mask: a bit for each class that has names."""
    bit = lambda c, i: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 1 << i).otherwise(0)
    return df.withColumn("mask", sum(bit(c, i) for i, c in enumerate(CLASSES)))


def _names(df: DataFrame, key: str) -> DataFrame:
    by_class = F.array(*[F.struct(F.lit(i).alias("class"), F.col(c).alias("names")) for i, c in enumerate(CLASSES)])
    rows = df.select(key, "mask", F.explode(by_class).alias("x")).select(key, "mask", "x.class", F.explode("x.names").alias("name"))
    return rows.withColumn("name", F.lower("name")).distinct()


def class_verdicts(games: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows (game, package, verdict) for pairs that share a name of some class: match if all classes that both have share one, else partial.

    games (game, and an array of names for each class), packages (package and the same). Pairs without a row are
    mismatches if both have names of some class, else nothing is known; best_packages() tells. An equi-join on names.
    """
    a, b = _names(_named(games, "game"), "game"), _names(_named(packages, "package"), "package").withColumnRenamed("mask", "other")
    hits = a.join(b, ["class", "name"]).select("game", "package", "class", F.col("mask").bitwiseAND(F.col("other")).alias("both")).distinct()
    counted = hits.groupBy("game", "package", "both").agg(F.count("*").alias("n"))
    return counted.select("game", "package", F.when(F.col("n") == F.bit_count("both"), "match").otherwise("partial").alias("verdict"))


def best_packages(games: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows (game, package, verdict): for each game the first package (created, then name, the newest first) of the best verdict: match, partial, unknown, mismatch.

    Packages (package, created, error, names by class) with an error don't take part. No pairs are made of what shares
    no name: packages without a common class are told by which classes they have, of which there are 16 sets.
    """
    rows = packages.filter(F.coalesce(F.col("error"), F.lit("")) == "").withColumn("newest", F.struct("created", "package"))
    shared = class_verdicts(games, rows).join(rows.select("package", "newest"), "package")
    shared = shared.groupBy("game").agg(F.max(F.struct((F.col("verdict") == "match").alias("whole"), "newest")).alias("x"))
    sets = F.broadcast(_named(rows, "package").groupBy(F.col("mask").alias("other")).agg(F.max("newest").alias("newest")))  # at most 16 rows
    apart = _named(games, "game").select("game", "mask").join(sets).groupBy("game").agg(F.max(F.struct((F.col("mask").bitwiseAND(F.col("other")) == 0).alias("unknown"), "newest")).alias("y"))
    out = apart.join(shared, "game", "left")
    verdict = F.when(F.col("x.whole"), "match").when(F.col("x").isNotNull(), "partial").when(F.col("y.unknown"), "unknown").otherwise("mismatch")
    return out.select("game", F.coalesce("x.newest.package", "y.newest.package").alias("package"), verdict.alias("verdict"))


def default_picks(best: DataFrame) -> DataFrame:
    """best_packages() where the package may be taken without asking."""
    return best.filter(F.col("verdict").isin("match", "partial"))


def match_gate(imported: DataFrame, least: float = 0.05) -> DataFrame:
    """One row of import_package()'s rows: total, by_uid, by_memory, missed, ratio, and whether the package fits: something matched, and by uid or at least this share."""
    of = lambda how: F.count_if(F.col("how") == how)
    counts = imported.agg(F.count("*").alias("total"), of("uid").alias("by_uid"), of("memory").alias("by_memory"), of("missed").alias("missed"))
    ratio = (F.col("by_uid") + F.col("by_memory")) / F.greatest(F.lit(1), F.col("total"))
    return counts.withColumn("ratio", ratio).withColumn("fits", (F.col("ratio") > 0) & ((F.col("by_uid") > 0) | (F.col("ratio") >= least)))


#: Verdicts, the best last.
VERDICTS = ["mismatch", "unknown", "partial", "match"]


def ranked_packages(names: dict[str, list[str]], packages: DataFrame, local: str | None = None) -> DataFrame:
    """Rows (place, package, verdict, shared, error) of all packages for one game, places from 0: by verdict, then the newest first (created, then name), after the game's own texts if it has any (local: their name).

    names has the game's names by class, packages (package, created, error, names by class). match: all classes that both
    have share a name, which `shared` lists; partial: some do; mismatch: none; unknown: there are no such classes, or the
    package has an error. One scan; the places come from a range partitioning, so no task sees all packages.
    """
    own = {c: [n.lower() for n in names.get(c) or []] for c in CLASSES}
    has = {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in CLASSES if own[c]}
    hit = {c: has[c] & F.coalesce(F.arrays_overlap(F.transform(c, F.lower), F.array(*map(F.lit, own[c]))), F.lit(False)) for c in has}
    none = F.array().cast("array<string>")
    shared = F.filter(F.array(*[F.when(hit[c], F.lit(c)) for c in hit]), lambda x: x.isNotNull()) if hit else none
    both = sum((has[c].cast("int") for c in has), F.lit(0))
    broken = F.coalesce(F.col("error"), F.lit("")) != ""
    verdict = F.when(broken | (both == 0), "unknown").when(F.size("shared") == both, "match").when(F.size("shared") > 0, "partial").otherwise("mismatch")
    rows = packages.withColumn("shared", shared).withColumn("verdict", verdict)
    rows = rows.select("package", "created", "verdict", "shared", F.coalesce("error", F.lit("")).alias("error"), F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).alias("weight"))
    rows = rows.withColumn("_key", F.struct("weight", "created", "package"))
    n, first = rows.count(), int(local is not None)
    out = ordered.global_rank(rows, "_key").select((n - 1 + first - F.col("rank")).cast("long").alias("place"), "package", "verdict", "shared", "error")
    if local is None:
        return out
    mine = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(local).alias("package"), F.lit("match").alias("verdict"), none.alias("shared"), F.lit("").alias("error"))
    return mine.union(out)


def default_place(ranked: DataFrame) -> int | None:
    """The place of the first package without an error that matches, whole or in part; none else."""
    return ranked.filter(F.col("verdict").isin("match", "partial") & (F.col("error") == "")).agg(F.min("place")).first()[0]
