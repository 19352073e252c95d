"""Extractors by name in SQL: a table function that takes a table and returns what the extractor named finds in its rows.

    SELECT * FROM extract('nodes', TABLE(SELECT page_id AS key, html AS text FROM pages))
    SELECT * FROM put_back('nodes', TABLE(SELECT key, text, edits FROM changed))

An extractor is a class that states the columns it needs and those it returns; when the query is analysed the function
asks it for both, so a wrong name or a missing column is an error before anything runs. One that carries something
from row to row also states by which columns its table has to be dealt out and in which order its rows come; Spark then
deals and sorts them, and each group gets an extractor of its own. Others work on rows wherever they lie, without a
shuffle. Own extractors are handed to install() and travel with the function to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import StructType


class Extractor:
    """What install() takes. row() gets each row of the table, end() comes after a group's last (after a task's last without groups)."""

    needs: tuple[str, ...] = ("key", "text")
    schema = "key string, ord int, start int, original string"
    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def row(self, row: Row) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        """Starts and texts of the units of one text, for row() and for putting back."""
        raise NotImplementedError

    def put(self, text: str, edits: dict[int, tuple[str, str]]) -> tuple[str, int]:
        """text with edits {ord: (original, target)} in the units' places, and how many; a unit that isn't the original stays."""
        out, last, n = [], 0, 0
        for i, (start, original) in enumerate(self.places(text)):
            if i in edits and edits[i][0] == original:
                out += [text[last:start], edits[i][1]]
                last, n = start + len(original), n + 1
        return "".join([*out, text[last:]]), n


class Places(Extractor):
    """Units of one text that don't depend on other rows."""

    def row(self, row: Row) -> Iterator[tuple]:
        for i, (start, original) in enumerate(self.places(row["text"] or "")):
            yield row["key"], i, start, original


class Nodes(Places):
    """Texts between tags, stripped, that hold a letter."""

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        for m in re.finditer(">([^<>]+)<", text):
            said = m[1].strip()
            if any(map(str.isalpha, said)):
                yield m.start(1) + m[1].index(said), said


class Lines(Places):
    """Lines, stripped, that hold a letter."""

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        for m in re.finditer(r"[^\n]+", text):
            said = m[0].strip()
            if any(map(str.isalpha, said)):
                yield m.start() + m[0].index(said), said


class Paragraphs(Extractor):
    """Lines up to a blank one, joined by a space: rows (key, line, text) are dealt by key and come in the order of line."""

    needs = ("key", "line", "text")
    schema = "key string, first_line int, n_lines int, original string"
    by, order = ("key",), ("line",)

    def __init__(self) -> None:
        self.key, self.first, self.said = None, 0, []

    def row(self, row: Row) -> Iterator[tuple]:
        said = (row["text"] or "").strip()
        if not said:
            yield from self.end()
            return
        if not self.said:
            self.key, self.first = row["key"], row["line"]
        self.said.append(said)

    def end(self) -> Iterator[tuple]:
        if self.said:
            yield self.key, self.first, len(self.said), " ".join(self.said)
        self.said = []


EXTRACTORS: dict[str, type[Extractor]] = {"nodes": Nodes, "lines": Lines, "paragraphs": Paragraphs}


def _checked(known: dict[str, type[Extractor]], name: AnalyzeArgument, table: AnalyzeArgument, needs: tuple[str, ...] | None = None) -> type[Extractor]:
    if not name.isConstantExpression or name.value not in known:
        raise ValueError(f"no extractor is called {name.value!r}; there are {', '.join(sorted(known))}")
    if not table.isTable:
        raise ValueError("the second argument is a table: TABLE(SELECT ...)")
    lacks = [c for c in needs or known[name.value].needs if c not in table.dataType.names]
    if lacks:
        raise ValueError(f"{name.value} needs the columns {', '.join(lacks)}")
    return known[name.value]


def install(spark: SparkSession, own: dict[str, type[Extractor]] | None = None) -> None:
    """Registers the table functions extract and put_back for the extractors of this module and for `own`."""
    known = EXTRACTORS | (own or {})
    # Functions are analysed in a process without a session, where texts of schemas can't be read.
    schemas = {name: StructType.fromDDL(x.schema) for name, x in known.items()}
    put_schema = StructType.fromDDL("key string, text string, n_replaced int")

    class Extract:
        def __init__(self) -> None:
            self.extractor = None

        @staticmethod
        def analyze(name: AnalyzeArgument, table: AnalyzeArgument) -> AnalyzeResult:
            x = _checked(known, name, table)
            return AnalyzeResult(schemas[name.value], partitionBy=[PartitioningColumn(c) for c in x.by], orderBy=[OrderingColumn(c) for c in x.order])

        def eval(self, name: str, row: Row) -> Iterator[tuple]:
            self.extractor = self.extractor or known[name]()
            yield from self.extractor.row(row)

        def terminate(self) -> Iterator[tuple]:
            if self.extractor:
                yield from self.extractor.end()

    class PutBack:
        @staticmethod
        def analyze(name: AnalyzeArgument, table: AnalyzeArgument) -> AnalyzeResult:
            _checked(known, name, table, ("key", "text", "edits"))
            return AnalyzeResult(put_schema)

        def eval(self, name: str, row: Row) -> Iterator[tuple]:
            edits = {e["ord"]: (e["original"], e["target"]) for e in row["edits"] or [] if e["target"] is not None}
            text, n = known[name]().put(row["text"] or "", edits)
            yield row["key"], text, n

    spark.udtf.register("extract", udtf(Extract))
    spark.udtf.register("put_back", udtf(PutBack))
