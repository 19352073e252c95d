"""Personal data by bootstrapped contextual extraction.

Seeds are what four base patterns find in whole texts (e-mail addresses, IP addresses, card numbers that pass Luhn,
phone numbers) and, of a fifth kind, strings that are random beyond doubt: tokens of 16 and more letters and digits that
change into each other once in three signs. Many random strings don't; they, and identifiers of any other form, are
found by the patterns alone. A seed's lexical patterns are the two tokens before it, the one before it, the two before
that one (a gap of one token) and the two behind it, of random ones also their first four letters. Patterns that
stand at no fewer than `support` different seeds are looked up in all texts: what stands there forms a graph of
patterns and instances. Spark scores it in rounds: a pattern's score for a kind is the sum of its different instances'
scores over all different things that stand there, ordinary words included; an instance's score is 1 for a seed and
else the noisy-or of its patterns. What may be a secret by its shape, being long and mixed, counts against a pattern
of secrets no more than it counts for it. Tokens with a digit or an @ at a pattern of at least `confidence` are
finds of its kind; those of cards and phone numbers go on over further groups of digits, with the blanks, hyphens
and brackets that the kind has. What is found counts as a seed in the next cycle: other patterns at its places are
looked up as well, for `cycles` cycles or until no pattern is new. Random strings are finds only at such patterns.
Ordinary contexts are mostly followed by ordinary words, so they never get there. Copies add nothing to a score.

The different ordinary words of a pattern are counted by sketches: a task passes on the `SKETCH` smallest hashes and
the bound below which it has them all, so counts up to SKETCH are exact and larger ones are off by some 13 %. A
pattern with more than four different ordinary words for a seed is dropped.

A token is a run of letters, digits and . - _ @ + %, or a run of other signs; A-Z are lower-cased in patterns.
Base matches are leftmost and don't overlap within a kind; those that fail the kind's check are dropped without
another try. Finds of the method never overlap a base match. Positions count code points, ends are exclusive.

Null texts count as empty and hold nothing. Rows that repeat a doc_id are judged by their own texts. Other columns
are ignored whatever their names, an empty table gives no rows. Texts are never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import keyed, same
from .shared import bounded, checkpointed, folded, mixed, rowed, slices, span_hashes

KINDS = ["email", "ip", "card", "phone", "secret"]
SECRET = 4
#: In place of a kind: identifiers of none, those that may be secrets by their shape, ordinary words.
OPEN, SHAPED, PLAIN = -3, -1, -2
_SIGNS = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RANDOM = re.compile(r"[A-Za-z0-9_+-]{16,}")
_CHANGE = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match in the middle of a run of digits would have begun at its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CLASS = np.array([0 if c in b" \t\n\v\f\r\0" else 1 if c >= 128 or chr(c).isalnum() or chr(c) in ".-_@+%" else 2 for c in range(256)], np.uint8)
#: The tokens of a context by their places from the find's first token (the last RIGHT: from its last): the pair before, the one before, a pair with a gap, the pair after.
_PLACES = [(-2, -1), (-1, -1), (-3, -2), (1, 2)]
RIGHT, BEGIN, SIDES = 3, 4, 5  # the last side is a token's own beginning: its first four letters
#: Least length of a find of the method: characters, of cards and phone numbers digits.
LEAST = [3, 3, 4, 3, 8]
#: How often a seed that is a random string changes between letters and digits, in so many signs.
CHANGES = 1, 3
#: Hashes of ordinary words that a task passes on for a pattern; different ordinary words for a seed, above which a pattern is dropped.
SKETCH, ORDINARY = 64, 4
_MOST = np.uint64((1 << 63) - 1)
_NUMBER = re.compile(r"[0-9]+(?:[.-][0-9]+)*")
_LEAD = re.compile(r"[(\[][0-9]+[)\]]?")
_EDGE = r"(?![0-9]*[A-Za-z_@+%])"
#: Further groups of digits of a kind, behind a group and before one.
_BETWEEN = {k: (re.compile(rf"{x}[0-9]+(?:[.-][0-9]+)*{_EDGE}(?![0-9])"), re.compile(rf"(?<![A-Za-z0-9_@+%.-])[0-9]+(?:[.-][0-9]+)*{x}\Z")) for k, x in ((2, r"[ -]"), (3, r"(?: ?- ?|[)\]][ -]?| ?\(| )"))}
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    if not _SIGNS.search(text):
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LETTERS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p) < 4 or len(p.lstrip("0")) < 4 for p in m[0].split(".")) and all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else []:
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _instance(text: str) -> int:
    return int(span_hashes(np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([len(text.encode())])).view(np.int64)[0])


def contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: text, start and end in code points, the hashes of its contexts (SIDES of them, 0: fewer tokens), its own hash, the number of its code points that are digits or @ (0 for signs)."""
    parts = [t.encode() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _CLASS[data]
    change = np.flatnonzero(np.diff(kind)) + 1
    bounds = np.concatenate([[0], change, [len(data)]])
    starts, ends = bounds[:-1], bounds[1:]
    kept = kind[starts] > 0
    starts, ends = starts[kept], ends[kept]
    h = span_hashes(folded(data), starts, ends)
    doc = np.searchsorted(first, starts, side="right") - 1
    around = np.zeros((SIDES, len(h)), np.uint64)  # the three low bits tell the sides apart
    for side, (i, j) in enumerate(_PLACES):
        lo, hi = max(0, -i, -j), len(h) - max(0, i, j)
        if lo < hi:
            a, b = h[lo + i : hi + i], h[lo + j : hi + j]
            one = doc[lo + i : hi + i] == doc[lo:hi]
            same_text = one & (doc[lo + j : hi + j] == doc[lo:hi])
            own = mixed(mixed(a) + b if i != j else a) & ~np.uint64(7) | np.uint64(2 * side + 1)
            around[side, lo:hi] = np.where(same_text, own, 0)
    long = np.flatnonzero(ends - starts >= 8)
    letters = np.concatenate([[0], np.cumsum((folded(data) >= 97) & (folded(data) <= 122))])
    long = long[letters[starts[long] + 4] - letters[starts[long]] == 4]
    around[BEGIN, long] = span_hashes(folded(data), starts[long], starts[long] + 4) & ~np.uint64(7) | np.uint64(2 * BEGIN - 1)
    signs = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57) | (data == 64))])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    origin = points[first[:-1]][doc]
    some = np.where(kind[starts] == 1, signs[ends] - signs[starts], 0)
    return doc, points[starts] - origin, points[ends] - origin, around.view(np.int64), h.view(np.int64), some


def _random(text: str, start: int, end: int) -> bool:
    """Whether a token is random beyond doubt, so that it may be a seed."""
    token = text[start:end].rstrip(".-_@+%")
    return bool(_RANDOM.fullmatch(token)) and len(_CHANGE.findall(token)) * CHANGES[1] >= len(token) * CHANGES[0]


def _mixed_up(text: str, start: int, end: int) -> bool:
    """Whether a token has the shape of a secret, which alone makes it neither a seed nor a find."""
    token = text[start:end].rstrip(".-_@+%")
    return bool(_RANDOM.fullmatch(token)) and len(_CHANGE.findall(token)) >= 4


def _seeds(rows: DataFrame) -> DataFrame:
    """_id, _h, spans (kind, start, end, ctx (one of each side), inst)."""
    kinds = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("ctx", pa.list_(pa.int64())), ("inst", pa.int64())])

    def of(text: str) -> list[dict]:
        spans, found = base_spans(text), []
        random = [m.start() for m in _RANDOM.finditer(text)] if _SIGNS.search(text) else []
        if not spans and not random:
            return found
        _, start, end, around, _, _ = contexts([text])
        for k, a, b in spans:
            i, last = np.searchsorted(start, a), np.searchsorted(start, b) - 1
            before = around[:RIGHT, i] if i < len(start) and start[i] == a else np.zeros(RIGHT, np.int64)
            found.append({"kind": k, "start": a, "end": b, "ctx": [*before.tolist(), int(around[RIGHT, last])], "inst": _instance(text[a:b].lower())})
        for i in sorted({int(np.searchsorted(start, a, side="right")) - 1 for a in random}):
            a, b = int(start[i]), int(end[i])
            if _random(text, a, b) and not any(s[1] < b and s[2] > a for s in spans):
                b = a + len(text[a:b].rstrip(".-_@+%"))
                found.append({"kind": SECRET, "start": a, "end": b, "ctx": around[:, i].tolist(), "inst": _instance(text[a:b].lower())})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([of(t) for t in texts], pa.list_(kinds))], ["_id", "_h", "spans"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _h long, spans array<struct<kind: int, start: int, end: int, ctx: array<long>, inst: long>>")


def _groups(text: str, a: int, b: int, most: int, between: re.Pattern, others: list[tuple[int, int, int]], back: bool) -> tuple[int, int]:
    """The span of the groups of digits from (a, b) on, or before it if back, that lie whole between others and have at most `most` digits."""
    digits = sum(c.isdigit() for c in text[a:b])
    while True:
        if back:
            m = between[1].search(text, max(0, a - 40), a)
            c, d = (m.start(), b) if m else (a, b)
            added = text[c:a]
        else:
            m = between[0].match(text, b)
            c, d = (a, m.end()) if m else (a, b)
            added = text[b:d]
        digits += sum(x.isdigit() for x in added)
        if not m or digits > most or any(s[1] < d and s[2] > c for s in others):
            return a, b
        a, b = c, d


def extents(text: str, start: int, end: int, others: list[tuple[int, int, int]], back: bool = False) -> list[tuple[int, int]]:
    """A find's (start, end) for each kind, of the token (start, end) behind a pattern, or before it if back; (0, 0) if it's none. Numbers go on over groups of digits as the kind's base pattern allows."""
    b = start + len(text[start:end].rstrip(".-_@+%"))
    plain = (start, b) if b - start >= LEAST[0] and _SIGNS.search(text, start, b) and not any(s[1] < b and s[2] > start for s in others) else (0, 0)
    out = [plain, plain]
    for kind, most in ((2, 19), (3, 15)):
        lead = _LEAD.match(text, start, start + 40) if kind == 3 and not back and text[start] in "([" else None
        a, b = (start, lead.end()) if lead else (start, start + len(text[start:end].rstrip(".-_@+%")))
        if not any(s[1] < b and s[2] > a for s in others) and (lead or _NUMBER.fullmatch(text, a, b)):
            a, b = _groups(text, a, b, most, _BETWEEN[kind], others, back)
            if back and kind == 3 and a and text[a - 1] == "(" and ")" in text[a:b]:
                a -= 1
            if text.count("(", a, b) > text.count(")", a, b) and text[b : b + 1] == ")":
                b += 1
            out.append((a, b) if sum(c.isdigit() for c in text[a:b]) >= LEAST[kind] else (0, 0))
        else:
            out.append(plain)
    return [*out, plain if plain[1] - plain[0] >= LEAST[SECRET] else (0, 0)]


class Ordinary:
    """A task's different ordinary words by pattern: of each the smallest hashes, as many as tell whether it's to be dropped."""

    def __init__(self, patterns: int, seeds: np.ndarray) -> None:
        self.most = np.where(seeds <= 1000, ORDINARY * seeds + 1, 0)
        self.kept = np.maximum(self.most, SKETCH + 1)
        self.at, self.word, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.waiting = 0

    def add(self, at: np.ndarray, word: np.ndarray) -> None:
        self.held.append((at, word))
        self.waiting += len(at)
        if self.waiting > max(200_000, len(self.at)):
            self.settle()

    def settle(self) -> None:
        at, word = (np.concatenate([own, *(h[i] for h in self.held)]) for i, own in enumerate((self.at, self.word)))
        by = np.lexsort((word, at))
        at, word = at[by], word[by]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (word[1:] != word[:-1])])[: len(at)]
        at, word = at[new], word[new]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        near = rank < self.kept[at]
        self.at, self.word, self.held, self.waiting = at[near], word[near], [], 0

    def sketches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns, hashes and bounds: below its bound all words are told; bound 0: the pattern is dropped."""
        self.settle()
        at, word = self.at, self.word
        first = np.searchsorted(at, at)
        rank, n = np.arange(len(at)) - first, np.searchsorted(at, at, side="right") - first
        over = (self.most[at] > 0) & (n >= self.most[at])
        bound = np.where(over, 0, np.where(n > SKETCH, word[np.minimum(first + SKETCH, max(0, len(at) - 1))], _MOST.astype(np.int64))) if len(at) else word
        told = np.where(over, rank == 0, rank < SKETCH)
        return at[told], word[told], bound[told]


def _followers(rows: DataFrame, wanted: np.ndarray, seeds: np.ndarray) -> DataFrame:
    """What stands at the wanted contexts (sorted; seeds: how many they have): identifiers with their places (kind OPEN or SHAPED; spans: one for each kind; all: all contexts of the place), ordinary words as sketches (kind PLAIN, bound)."""
    shared = rows.sparkSession.sparkContext.broadcast((wanted, seeds))
    names = ["_id", "_h", "ctx", "inst", "kind", "spans", "all", "bound"]
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_seeds = shared.value
        table = np.zeros(1 << 16, bool)
        table[known >> 16 & 0xFFFF] = True
        words = Ordinary(len(known), n_seeds)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi, texts in slices(batch.column(2)):
                found: list[tuple] = []
                doc, start, end, around, h, some = contexts(texts)
                h = (mixed(h.view(np.uint64)) >> np.uint64(1)).astype(np.int64)
                spans: dict[int, list] = {}
                extents_: dict[tuple[int, bool], list] = {}
                for side, ctx in enumerate(around):
                    near = np.flatnonzero(table[ctx >> 16 & 0xFFFF] & (ctx != 0))
                    at = np.minimum(np.searchsorted(known, ctx[near]), len(known) - 1)
                    near, at = near[known[at] == ctx[near]], at[known[at] == ctx[near]]
                    plain = (some[near] == 0) & (end[near] - start[near] >= 3)
                    for j in np.flatnonzero(~plain).tolist():
                        i = int(near[j])
                        d, a, b = int(doc[i]), int(start[i]), int(end[i])
                        text = texts[d]
                        if some[i] == 0 and not _LEAD.match(text, a):
                            plain[j] = True
                            continue
                        own = spans[d] if d in spans else spans.setdefault(d, base_spans(text))
                        if any(s[1] < b and s[2] > a for s in own):
                            continue
                        place = (i, side == RIGHT)
                        if place not in extents_:
                            extents_[place] = extents(text, a, b, own, side == RIGHT)
                        if ends := [x for x in extents_[place] if x[1]]:
                            p, q = min(ends)[0], max(x[1] for x in ends)
                            found.append((lo + d, int(ctx[i]), _instance(text[p:q].lower()), extents_[place], around[:, i].tolist(), SHAPED if _mixed_up(text, a, b) else OPEN))
                        else:
                            plain[j] = True
                    words.add(at[plain], h[near[plain]])
                if found:
                    i, c, x, e, all_, open_ = zip(*found, strict=True)
                    n = len(i)
                    lists = pa.array([[{"start": p, "end": q} for p, q in each] for each in e], pa.list_(pair))
                    ids = [batch.column(k).take(pa.array(i, pa.int64())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(c, pa.int64()), pa.array(x, pa.int64()), pa.array(open_, pa.int32()), lists, pa.array(all_, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names)
        if kind is not None:
            at, word, bound = words.sketches()
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array(known[at]), pa.array(word), pa.array([PLAIN] * n, pa.int32()), pa.nulls(n, pa.list_(pair)), pa.nulls(n, pa.list_(pa.int64())), pa.array(bound)], names)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _h long, ctx long, inst long, kind int, spans array<struct<start: int, end: int>>, all array<long>, bound long")


def ordinary(edges: DataFrame) -> DataFrame:
    """Rows (ctx, plain): the number of different ordinary words, from the sketches of all tasks; infinite for dropped patterns."""
    plain = edges.filter(F.col("kind") == PLAIN)
    least = plain.groupBy("ctx").agg(F.min("bound").alias("least"))
    below = plain.select("ctx", "inst").distinct().join(least, "ctx").groupBy("ctx", "least").agg(F.sum(F.when(F.col("inst") < F.col("least"), 1).otherwise(0)).alias("n"))
    return below.select("ctx", F.when(F.col("least") == 0, float("inf")).otherwise(F.col("n") / (F.col("least") / float(1 << 63))).alias("plain"))


def score_patterns(edges: DataFrame, seeds: DataFrame, rounds: int = 4) -> DataFrame:
    """Rows (ctx, kind, score) of edges (of _followers) and seeds (ctx, inst, kind), at the contexts of `edges` and seeds alike. Copies count once, ordinary words too."""
    found = edges.filter(F.col("kind") != PLAIN).select("ctx", "inst", "kind").union(seeds.select("ctx", "inst", "kind"))
    graph = checkpointed(found.groupBy("ctx", "inst").agg(F.max("kind").alias("kind")))
    shaped = F.col("kind") == SHAPED
    some = graph.groupBy("ctx").agg(F.count("*").alias("different"), F.count_if(F.col("kind") >= 0).alias("s"), F.count_if(shaped).alias("shaped")).join(ordinary(edges), "ctx", "left")
    plain = F.coalesce("plain", F.lit(0.0))
    size = checkpointed(some.filter(plain <= ORDINARY * F.greatest("s", F.lit(1))).select("ctx", (F.col("different") + plain).alias("size"), "shaped"))
    fixed = graph.filter("kind >= 0").groupBy("ctx", "kind").agg(F.count("*").cast("double").alias("mass"), F.lit(0.0).alias("of_shaped"))
    open_ = graph.filter("kind < 0").select("ctx", "inst", shaped.alias("shaped"))

    def scored(masses: DataFrame) -> DataFrame:
        neutral = F.when(F.col("kind") == SECRET, F.col("shaped") - F.col("of_shaped")).otherwise(0)
        return masses.join(size, "ctx").select("ctx", "kind", (F.col("mass") / (F.col("size") - neutral)).alias("score"))

    scores = scored(fixed)
    for _ in range(rounds):
        scores = checkpointed(scores)
        sure = F.lit(1.0) - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))
        # The sides of one place aren't independent: noisy-or within a side, the largest of the sides.
        guessed = open_.join(scores, "ctx").groupBy("inst", "kind", F.col("ctx").bitwiseAND(7).alias("side")).agg(sure.alias("s")).groupBy("inst", "kind").agg(F.max("s").alias("s"))
        more = open_.join(guessed, "inst").groupBy("ctx", "kind").agg(F.sum("s").alias("mass"), F.sum(F.when(F.col("shaped"), F.col("s")).otherwise(0.0)).alias("of_shaped"))
        scores = scored(fixed.union(more).groupBy("ctx", "kind").agg(F.sum("mass").alias("mass"), F.sum("of_shaped").alias("of_shaped")))
    return checkpointed(scores)


def extract(docs: DataFrame, support: int = 5, confidence: float = 0.8, rounds: int = 4, cycles: int = 3, key: str = "doc_id", text: str = "text", most: int = 2_000_000) -> DataFrame:
    """Rows (_id, _h, base, added), one for each row of docs; base, added: arrays of (kind, start, end), kind as the index in KINDS. most bounds the number of patterns looked up in one scan; more of them take more scans."""
    rows = keyed(docs, key, text)
    found = checkpointed(_seeds(rows))
    seeds = found.select(F.explode("spans").alias("s")).select(F.explode("s.ctx").alias("ctx"), "s.inst", "s.kind").filter("ctx <> 0").groupBy("ctx", "inst").agg(F.max("kind").alias("kind"))
    seeds = checkpointed(seeds)
    marks, looked, edges, hits = seeds.select("ctx", "inst"), None, None, None
    for _ in range(cycles):
        wanted = marks.groupBy("ctx").agg(F.count_distinct("inst").alias("n")).filter(F.col("n") >= support)
        wanted = checkpointed(wanted if looked is None else wanted.join(looked, "ctx", "left_anti"))
        if not (n := wanted.count()):
            break
        for part in range(parts := -(-n // most)):  # each part has a bounded number of patterns
            own = wanted.filter(F.pmod(F.xxhash64("ctx"), F.lit(parts)) == part).toArrow()
            ctx, count = own["ctx"].to_numpy(), own["n"].to_numpy()
            at = checkpointed(_followers(rows, np.sort(ctx), count[np.argsort(ctx)]))
            edges = at if edges is None else edges.union(at)
        looked = wanted.select("ctx") if looked is None else looked.union(wanted.select("ctx"))
        good = score_patterns(edges, seeds.join(looked, "ctx", "left_semi"), rounds).filter(F.col("score") >= confidence)
        best = checkpointed(good.groupBy("ctx").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("k"), F.max("score").alias("score")))
        hits = checkpointed(edges.filter(F.col("kind") != PLAIN).join(best, "ctx").withColumn("s", F.get("spans", F.col("k"))).filter("s.end > s.start").select("_id", "_h", "k", "s", "score", "inst", "all"))
        marks = seeds.select("ctx", "inst").union(hits.select(F.explode("all").alias("ctx"), "inst").filter("ctx <> 0"))
    of = F.filter("spans", lambda s: s["kind"] < SECRET)
    plain = found.select("_id", "_h", F.transform(of, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    if hits is None:
        return plain.withColumn("added", none)
    # Of a place's kinds the surest.
    places = hits.groupBy("_id", "_h", F.col("s.start").alias("start")).agg(F.max_by(F.struct("k", "s.end"), F.struct("score", -F.col("k"))).alias("x"))
    new = places.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct(F.col("x.k").alias("kind"), "start", "x.end"))).alias("added"))
    new, hint = bounded(checkpointed(new), 500_000)
    out = plain.alias("a").join(hint(new).alias("b"), same(plain, new, ["_id", "_h"]), "left")
    return out.select("a._id", "a._h", "base", F.coalesce("added", none).alias("added"))


def listed(spans: F.Column) -> F.Column:
    """kind:start:end, by kind and start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 500_000, **options) -> DataFrame:
    """docs, each find in its text replaced by its kind in angle brackets; overlapping ones by the kind of the first.

    Null and empty texts stay as they are, rows that repeat a key are redacted by their own texts. Other columns may
    have any names and pass through as they are. An empty table gives no rows.
    """
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = extract(docs, key=key, text=text, **options).select("_id", "_h", spans.alias("_spans")).filter(F.size("_spans") > 0).distinct()
    found, hint = bounded(checkpointed(found), most)
    own = F.col("row").getField(key), F.col("row").getField(text)
    both = rowed(docs).join(hint(found), (F.xxhash64(*own) == F.col("_h")) & own[0].eqNullSafe(F.col("_id")), "left")
    names, at = docs.columns, docs.columns.index(text)
    last = "_".join(["spans", *names])  # no column has a name longer than all together

    def redacted(said: str, spans: list[dict]) -> str:
        out, end = [], 0
        for s in spans:
            if s["start"] >= end:
                out += [said[end : s["start"]], f"<{KINDS[s['kind']]}>"]
            end = max(end, s["end"])
        return "".join([*out, said[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a, b, texts in slices(x.column(at)):
                part = x.slice(a, b - a)
                columns = part.columns[:-1]
                lists = part.column(len(names))
                if lists.null_count < b - a:
                    said = [redacted(t, s) if s else None if null else t for t, s, null in zip(texts, lists.to_pylist(), part.column(at).is_null().to_pylist(), strict=True)]
                    columns[at] = pa.array(said, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return both.select("row.*", F.col("_spans").alias(last)).mapInArrow(run, docs.schema)
