"""Benchmark decontamination with SimHash of item-sized windows.

A text's words are cut into windows as long as a benchmark item. The SimHash of a window's weighted
shingles is looked up in a multi-index: fingerprints are cut into eight blocks, and if two differ in at
most ``RADIUS`` bits, one block differs in at most ``RADIUS // 8``, so looking up every block value that near
finds all of them. Fingerprints of similar windows can still differ in more bits, so every window that an upper
bound of its similarity does not rule out is a candidate too: the weight of the shingles it has in common with the
item is at most that of its places with a shingle of the item. Candidates are verified by exact similarity.

A shingle weighs 1 / (items of the whole benchmark that hold it), in whatever pass. As this makes a new word count
more than the words of a repeated item, a window matches if its weighted or its plain (all weights 1)
Jaccard similarity is high enough.

A window without a shingle of an item has similarity 0 to it, so fingerprints are computed only for
windows that hold one; no window that could match is left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.words import NON_ALNUM, U64, blocks, mix
from reviewlens.session import cut_lineage

WORDS, SIMILARITY = 5, 0.8
RADIUS = 24
BLOCKS = 8
# Items shipped to the tasks at once: more are handled in several passes over the texts.
ITEMS, CHARS = 20_000, 16_000_000

_NEAR = [
    np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) <= RADIUS // BLOCKS) for v in range(256)
]


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, U64)
    for k in range(size):
        out = mix(out + U64(k + 1)) + h[k : k + n]
    return mix(out + U64(size))


def _rolled_at(h: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The shingles that begin at ``places``."""
    out = np.zeros(len(places), U64)
    for k in range(size):
        out = mix(out + U64(k + 1)) + h[places + k]
    return mix(out + U64(size))


def _signs(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Eight bytes for each row of 64 sums."""
    return np.packbits(sums > 0, axis=1)


class Index:
    """Items by shingle, and by length and fingerprint block."""

    def __init__(self, items: list[tuple], words: int, similarity: float, held: dict[int, int] | None = None) -> None:
        """``held``: shingle -> items that hold it, for those that several hold; by default counted among ``items``."""
        self.words, self.similarity = words, similarity
        self.total = []  # weight and number of an item's shingles
        self.items = []  # (item_id, words in the item, shingle size, shingle -> weight)
        hashes = []
        column = pa.array([t for _, t in items], pa.string())
        for at, _, w in blocks(column, NON_ALNUM):
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                if b > a:
                    hashes.append((items[at + i][0], w.hash[a:b]))
        if held is None:
            held = Counter(s for _, h in hashes for s in set(_rolled(h, min(words, len(h))).tolist()))
        self.weight = {s: 1.0 / n for s, n in held.items()}  # shingles of many items say less
        self.by_shingle: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_length = defaultdict(list)
        for item_id, h in hashes:
            size = min(words, len(h))
            shingles = _rolled(h, size)
            k = len(self.items)
            self.items.append((item_id, len(h), size, self._weights(shingles)))
            self.total.append((sum(self.items[k][3].values()), len(shingles)))
            for s in set(shingles.tolist()):
                self.by_shingle[size][s].append(k)
            by_length[len(h)].append((k, _fingerprints(self._sums(shingles))[0]))
        self.sorted = {size: np.array(sorted(found), U64) for size, found in self.by_shingle.items()}
        self.by_length = {}
        for length, found in by_length.items():
            prints = np.stack([p for _, p in found])
            tables = [defaultdict(list) for _ in range(BLOCKS)]
            for row, p in enumerate(prints.tolist()):
                for b in range(BLOCKS):
                    tables[b][p[b]].append(row)
            self.by_length[length] = np.array([k for k, _ in found]), prints, tables

    def _weights(self, shingles: np.ndarray) -> dict[int, float]:
        return {s: n * self.weight.get(s, 1.0) for s, n in Counter(shingles.tolist()).items()}

    def _sums(self, shingles: np.ndarray) -> np.ndarray:
        weight = np.array([self.weight.get(s, 1.0) for s in shingles.tolist()], np.float32)
        return (_signs(shingles) * weight[:, None]).sum(0, keepdims=True)

    def near(self, length: int, prints: np.ndarray) -> list[np.ndarray]:
        """For every fingerprint, the items of ``length`` words within the radius."""
        items, own, tables = self.by_length[length]
        out = []
        for p in prints:
            rows = {r for b in range(BLOCKS) for v in _NEAR[p[b]].tolist() if v in tables[b] for r in tables[b][v]}
            rows = np.fromiter(sorted(rows), np.int64, len(rows))
            out.append(items[rows[np.bitwise_count(own[rows] ^ p).sum(1) <= RADIUS]])
        return out

    def similar(self, k: int, shingles: np.ndarray) -> tuple[float, float]:
        """Weighted and plain similarity."""
        a, b = self.items[k][3], Counter(shingles.tolist())
        common = weighted = 0.0
        size = all_ = 0.0
        for s, n in b.items():
            weight = self.weight.get(s, 1.0)
            size += n
            all_ += n * weight
            if s in a:
                both = min(n * weight, a[s])
                weighted += both
                common += both / weight
        total, number = self.total[k]
        return weighted / (total + all_ - weighted), common / (number + size - common)

    def _possible(self, k: int, h: np.ndarray, places: list[int]) -> np.ndarray:
        """Starts of the windows whose similarity to item ``k`` may be high enough, by the weight of ``places``."""
        _, length, size, _ = self.items[k]
        total, number = self.total[k]
        places = np.array(sorted(places))
        own = np.array([self.weight.get(s, 1.0) for s in _rolled_at(h, places, size).tolist()])
        if len(places) < self.similarity * number - 1e-9 and own.sum() < self.similarity * total - 1e-9:
            return places[:0]
        span, last = length - size + 1, max(0, len(h) - length)
        starts = np.unique(np.clip((places[:, None] - np.arange(span)).ravel(), 0, last))
        sums = np.concatenate([[0.0], np.cumsum(own)])
        low, high = np.searchsorted(places, starts), np.searchsorted(places, starts + span)
        return starts[(high - low >= self.similarity * number - 1e-9) | (sums[high] - sums[low] >= self.similarity * total - 1e-9)]

    def text(self, h: np.ndarray, hits: dict[int, list[int]]) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for every item that matches.

        ``hits``: places of shingles by item.
        """
        windows = defaultdict(set)  # (words in the window, shingle size) -> starts
        possible = defaultdict(lambda: defaultdict(set))  # likewise -> start -> items
        for k, places in hits.items():
            _, length, size, _ = self.items[k]
            span = length - size + 1  # shingles in a window
            last = max(0, len(h) - length)
            for p in places:
                windows[length, size].update(range(max(0, min(last, p - span + 1)), min(last, p) + 1))
            for start in self._possible(k, h, places).tolist():
                possible[length, size][start].add(k)
        best: dict[int, tuple[bool, float, int, int]] = {}
        for (length, size), starts in windows.items():
            shingles, starts = _rolled(h, size), np.array(sorted(starts))
            span = min(length - size + 1, len(shingles))
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                own = shingles[run[0] : run[-1] + span]
                weight = np.array([self.weight.get(s, 1.0) for s in own.tolist()])
                sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_signs(own) * weight[:, None], axis=0)])
                at = run - run[0]
                for start, found in zip(run.tolist(), self.near(length, _fingerprints(sums[at + span] - sums[at])), strict=True):
                    for k in sorted(possible[length, size][start].union(found.tolist())):
                        weighted, plain = self.similar(k, shingles[start : start + span])
                        value = max((weighted >= self.similarity, weighted), (False, plain))
                        if value[1] >= self.similarity and value > best.get(k, (False, 0.0))[:2]:
                            best[k] = (*value, start, min(length, len(h)))
        return [(k, *best[k][1:]) for k in sorted(best)]


def _passes(benchmark: DataFrame, words: int) -> tuple[int, Iterator[tuple[list[tuple], dict[int, int]]]]:
    """Number of passes, and of each its items, bounded in size and collected when it is reached, with the number of
    items of the whole benchmark that hold a shingle, for shingles that several hold (all others weigh 1)."""
    rows = benchmark.select("item_id", "text").filter("text is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).collect()[0]
    passes = max(1, -(-n // ITEMS), -(-chars // CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))

    def run(batches):
        for batch in batches:
            for _, _, w in blocks(batch.column("text"), NON_ALNUM):
                texts = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True) if b > a]
                found = [np.unique(_rolled(h, min(words, len(h)))) for h in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *found]).view(np.int64))], ["shingle"])

    def items():
        held = rows.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").toPandas()
        held = dict(zip(held["shingle"].to_numpy().astype(np.int64).view(U64).tolist(), held["n"].tolist(), strict=True))
        for k in range(passes):
            yield sorted(map(tuple, rows.filter(part == k).collect()), key=str), held

    return passes, items()


_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("similarity", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())]))


def _scan(docs: DataFrame, items: list[tuple], held: dict[int, int], words: int, similarity: float) -> DataFrame:
    def run(batches):
        index = Index(items, words, similarity, held)
        for batch in batches:
            rows = []
            for at, to, w in blocks(batch.column("text"), NON_ALNUM):
                hits: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
                for size, table in index.sorted.items():
                    grams = _rolled(w.hash, size)
                    place = np.minimum(np.searchsorted(table, grams), len(table) - 1)
                    found = np.flatnonzero(table[place] == grams)
                    text = np.searchsorted(w.first, found, side="right") - 1
                    for p, i in zip(found.tolist(), text.tolist(), strict=True):
                        if p + size <= w.first[i + 1]:
                            for k in index.by_shingle[size][int(grams[p])]:
                                hits[i][k].append(p - int(w.first[i]))
                for i in range(to - at):
                    found = index.text(w.hash[w.first[i] : w.first[i + 1]], hits[i]) if i in hits else []
                    rows.append([(None if index.items[k][0] is None else str(index.items[k][0]), *rest) for k, *rest in found])
            matches = [[dict(zip(("item_id", "similarity", "start", "n_words"), m, strict=True)) for m in found] for found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(matches, _MATCH)], ["doc_id", "text", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, text string, matches array<struct<item_id string, similarity double, start long, n_words long>>"
    )


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): every item that a text of ``docs`` (doc_id, text) holds.

    One row for each text row and item, with its best window (of equals, the first); similarity is the weighted one,
    or the plain one if no window's weighted similarity is high enough. An item shorter
    than ``words`` words is one shingle. Null, empty and wordless texts and items match nothing;
    items with equal texts all match; repeated rows are reported each. Other columns are ignored.
    """
    kind = benchmark.schema["item_id"].dataType
    out = None
    passes, items = _passes(benchmark, words)
    for part, held in items:
        found = _scan(docs, part, held, words, similarity).select("doc_id", F.explode("matches").alias("m"))
        found = found.select("doc_id", F.col("m.item_id").cast(kind).alias("item_id"), "m.similarity", "m.start", "m.n_words")
        found = cut_lineage(found) if passes > 1 else found  # lets go of the pass's items
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    passes, items = _passes(benchmark, words)
    for part, held in items:
        rows = _scan(rows, part, held, words, similarity).filter(F.size("matches") == 0).select("doc_id", "text")
        rows = cut_lineage(rows) if passes > 1 else rows
    return rows.select("doc_id.*")
