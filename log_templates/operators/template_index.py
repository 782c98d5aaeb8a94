"""An inverted index of a bounded template table, for the tasks that look lines up in it.

A template is filed under its rarest whole constant word.  Every line it fits has that word,
so a line is tried only on the templates filed under its own words, and on those without
a whole constant word.  The table is small enough to be sent (the caller checks that);
it travels once per worker, and lines stay where they are.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F

from log_templates.functions.text import PLACEHOLDER

KEPT_INDEXES = 4  # in a worker


class Known(NamedTuple):
    """A template as it is tried: ``order`` is the negated number of hits."""

    order: int
    template_id: int
    template: str
    group: tuple
    words: int | None  # of its reference line; None without a length gate


def constant_words(template: str) -> set[str]:
    """Words of a template that stand whole in every line it fits."""
    return {w for w in template.split(" ") if w and PLACEHOLDER not in w}


def filled(line: str, parts: list[str]) -> str | None:
    """The template without the placeholders that are empty in this line; None if it does not fit."""
    first, last = parts[0], parts[-1]
    if len(parts) == 1:
        return first if line == first else None
    cursor, end = len(first), len(line) - len(last)
    if end < cursor or not line.startswith(first) or not line.endswith(last):
        return None
    out = [first]
    for part in parts[1:-1]:
        at = line.find(part, cursor) if part else cursor
        if at < 0:
            return None
        out += (PLACEHOLDER, part) if at > cursor else (part,)
        cursor = at + len(part)
    if end < cursor:
        return None
    out += (PLACEHOLDER, last) if end > cursor else (last,)
    return "".join(out)


class TemplateIndex:
    """Finds the first known template, by hits and id, that a blank-collapsed line fits."""

    def __init__(self, known: list[Known]):
        self.gated = any(k.words is not None for k in known)
        self.tried = 0
        frequency = Counter((k.group, w) for k in known for w in constant_words(k.template))
        self.templates = {(k.group, k.template) for k in known}
        self.files: dict[tuple, list[tuple]] = {}
        for nth, k in enumerate(sorted(known)):
            rarest = min(constant_words(k.template), key=lambda w: (frequency[k.group, w], w), default="")
            self.files.setdefault((k.group, rarest), []).append((nth, k.words, k.template.split(PLACEHOLDER)))

    def candidates(self, line: str, group: tuple) -> Iterator[list[str]]:
        """Parts of the templates to try on a line, in their order."""
        words = line.split(" ") if line else []
        n, found = len(words), []
        for word in {"", *words}:
            for entry in self.files.get((group, word), ()):
                if not self.gated or -1 <= entry[1] - n <= 1:
                    found.append(entry)
        found.sort(key=lambda entry: entry[0])
        return (entry[2] for entry in found)

    def find(self, line: str | None, group: tuple) -> str | None:
        if line is None or None in group:
            return None
        for parts in self.candidates(line, group):
            self.tried += 1
            hit = filled(line, parts)
            if hit is not None and (group, hit) in self.templates:
                return hit
        return None


_INDEXES: OrderedDict[int, TemplateIndex] = OrderedDict()


def _index(key: int, sent: Broadcast) -> TemplateIndex:
    if key not in _INDEXES:
        _INDEXES[key] = TemplateIndex([Known(*k) for k in sent.value])
        while len(_INDEXES) > KEPT_INDEXES:
            _INDEXES.popitem(last=False)
    return _INDEXES[key]


def lookup(sent: Broadcast, key: int, flat: Column, by: list[str]) -> Column:
    """The template of each blank-collapsed line, from a table sent to the workers as tuples."""

    @F.arrow_udf("string")
    def find(line: pa.Array, *groups: pa.Array) -> pa.Array:
        index = _index(key, sent)
        keys = zip(*(g.cast(pa.string()).to_pylist() for g in groups), strict=True) if groups else None
        lines = line.to_pylist()
        if keys is None:
            return pa.array([index.find(x, ()) for x in lines], pa.string())
        return pa.array([index.find(x, k) for x, k in zip(lines, keys, strict=True)], pa.string())

    return find(flat, *(F.col(c).cast("string") for c in by))
