"""Ordered substring replacements from large dictionaries.

Folding every rule over every text costs rules times text. Here one Aho-Corasick pass over a text names the rules whose
written form it holds; only those are carried out, in the dictionary's order. A replacement may complete the written form
of a later rule, so the neighbourhood of every replaced place is searched again: the rules carried out are
those that the plain fold would find something for, and the result is the same.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rules = Sequence[tuple[str, str]]


class Dictionary:
    """Rules ``(written, wanted)`` with a search tree over their written forms. Written forms are not empty."""

    def __init__(self, rules: Rules):
        self.rules = list(rules)
        self.longest = max((len(written) for written, _ in self.rules), default=0)
        places: dict[str, list[int]] = {}
        for at, (written, _) in enumerate(self.rules):
            places.setdefault(written, []).append(at)
        self.tree = ahocorasick.Automaton()
        for written, held in places.items():
            self.tree.add_word(written, tuple(held))
        if places:
            self.tree.make_automaton()

    def _named(self, text: str) -> set[int]:
        return {at for _, held in self.tree.iter(text) for at in held}

    def apply(self, text: str) -> str:
        """``text`` after all rules, in order."""
        if not self.rules:
            return text
        due = self._named(text)
        waiting = sorted(due)
        while waiting:
            at = heapq.heappop(waiting)
            written, wanted = self.rules[at]
            between = text.split(written)
            if len(between) == 1:
                continue
            text = wanted.join(between)
            named: set[int] = set()
            for stretch in self._changed(text, between, len(wanted)):
                named |= self._named(stretch)
            for later in named - due:
                if later > at:
                    due.add(later)
                    heapq.heappush(waiting, later)
        return text

    def _changed(self, text: str, between: list[str], width: int) -> Iterator[str]:
        """The stretches in which a replacement by ``width`` characters may have made a new written form."""
        around = self.longest - 1
        if (len(between) - 1) * (width + 2 * around) >= len(text):
            yield text
            return
        end = 0
        for part in between[:-1]:
            end += len(part) + width
            yield text[max(0, end - width - around):end + around]


# One dictionary per Python worker, the last one used.
_built: dict[str, Dictionary] = {}


def _dictionary(name: str, rules: Rules) -> Dictionary:
    if name not in _built:
        _built.clear()
        _built[name] = Dictionary(rules)
    return _built[name]


def apply_dictionary(c: Column, rules: Rules) -> Column:
    """``c`` after all rules, one after the other in their order; null stays null. The dictionary travels to
    every task, see ``sources.reviews.collect_rules`` for its bound."""
    rules = [(written, wanted) for written, wanted in rules]
    name = hashlib.sha256(repr(rules).encode("utf-8", "surrogatepass")).hexdigest()

    @F.arrow_udf(T.StringType())
    def applied(texts: pa.Array) -> pa.Array:
        dictionary = _dictionary(name, rules)
        return pa.array([None if t is None else dictionary.apply(t) for t in texts.to_pylist()], pa.string())

    return applied(c)
