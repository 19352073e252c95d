"""Strings of JSON texts by their places: replaced where they stand, so that no other byte of a file changes, also inside strings that hold JSON themselves."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[\s]*(?:("(?:[^"\\]|\\.)*")|([{}\[\],:])|([^\s{}\[\],:"]+))')
Place = tuple[str, ...]


def places(said: str) -> tuple[dict[Place, tuple[int, int, str]], dict[Place, tuple[int, int, str]], set[Place]]:
    """Strings and keys of a valid JSON text by the way to them, with their bounds (quotes included) and values, of repeated keys the last; and all ways."""
    strings: dict[Place, tuple[int, int, str]] = {}
    keys: dict[Place, tuple[int, int, str]] = {}
    ways: set[Place] = set()
    at: list[str | int] = []  # the way to what comes next; in an object "" until its key is read
    key = False
    for m in _TOKEN.finditer(said):
        text, sign, _ = m.groups()
        if sign in ("}", "]"):
            at.pop()
            key = False
            continue
        if sign == ",":
            key = isinstance(at[-1], str)
            at[-1] = "" if key else at[-1] + 1
            continue
        if sign == ":":
            key = False
            continue
        if key and text is not None:
            at[-1] = json.loads(text)
            keys[tuple(map(str, at))] = (*m.span(1), at[-1])
            continue
        way = tuple(map(str, at))
        ways.add(way)
        if text is not None:
            strings[way] = (*m.span(1), json.loads(text))
        elif sign == "{":
            at.append("")
            key = True
        elif sign == "[":
            at.append(0)
            key = False
    return strings, keys, ways


def spliced(said: str, edits: list[tuple[Place, bool, str, str]], depth: int = 6) -> tuple[str, int]:
    """said with edits (way, whether the key itself is meant, original, target) put in where the original stands, and how many; ways go on inside strings that hold JSON, `depth` deep."""
    json.loads(said)  # else no places, but an error
    strings, keys, _ = places(said)
    put: dict[tuple[int, int], str] = {}
    inner: dict[Place, list[tuple[Place, bool, str, str]]] = {}
    done = 0
    for way, as_key, original, target in edits:
        held = (keys if as_key else strings).get(way)
        if held:
            if held[2] == original and held[:2] not in put:
                put[held[:2]] = target
                done += 1
            continue
        outer = next((way[:k] for k in range(len(way) - 1, 0, -1) if way[:k] in strings), None)
        if outer and depth:
            inner.setdefault(outer, []).append((way[len(outer) :], as_key, original, target))
    for outer, own in inner.items():
        a, b, value = strings[outer]
        if (a, b) in put:
            continue
        try:
            new, n = spliced(value, own, depth - 1)
        except ValueError:  # a string that holds no JSON: nothing of it is meant
            continue
        if n:
            put[a, b] = new
            done += n
    for (a, b), target in sorted(put.items(), reverse=True):
        said = said[:a] + json.dumps(target, ensure_ascii=False) + said[b:]
    return said, done
