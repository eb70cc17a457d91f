"""Words and neighbouring words counted in every task, some megabytes of text at a time, before rows are made of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import segment as runs
from reviewlens.session import freed_shuffles

PIECE = 8 << 20  # bytes of text counted at once; a longer single text is a piece of its own
ROWS = 1 << 16  # pairs written out and handed over at once

# What \s matches becomes a space.
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[9:14] = 0x20


def _pieces(texts: pa.Array, piece: int | None = None) -> Iterator[pa.ListArray]:
    """The words between single blanks of every text that is not null, ``piece`` bytes of text at a time."""
    piece = piece or PIECE
    texts = texts.drop_null().cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + piece, side="right")) - 1)
        places = ends[at : to + 1] - ends[at]
        plain = _BLANKS[raw[ends[at] : ends[to]]]
        yield pc.split_pattern(pa.Array.from_buffers(pa.large_string(), to - at, [None, pa.py_buffer(places), pa.py_buffer(plain)]), " ")
        at = to


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code) of all words, and the distinct words by code, in the order of their bytes."""
    text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    found = lists.flatten().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return text, rank[found.indices.to_numpy(zero_copy_only=False)], found.dictionary.take(pa.array(order)).cast(pa.string())


def word_counts(df: DataFrame, text: Column) -> DataFrame:
    """(term, n, df): occurrences and texts of every word between single blanks, empty ones too."""

    def run(batches):
        for batch in batches:
            for lists in _pieces(batch.column(0)):
                row, code, words = _coded(lists)
                n = np.bincount(code, minlength=len(words))
                held = np.bincount(np.unique(row * len(words) + code) % max(len(words), 1), minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(held)], ["term", "n", "df"])

    return df.select(text.alias("text")).mapInArrow(run, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def text_terms(rows: DataFrame) -> DataFrame:
    """(row, length, term, tf) of rows (row, text): every word between single blanks of a text, empty ones too, how often it occurs
    there and how many words the text has; nothing for a null text."""

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for lists in _pieces(batch.column(1)):
                row, code, words = _coded(lists)
                cell, tf = np.unique(row * len(words) + code, return_counts=True)
                own, term = np.divmod(cell, max(len(words), 1))
                length = np.bincount(row, minlength=len(lists))
                for a in range(0, len(cell), ROWS):
                    part = own[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(part + at)), pa.array(length[part]), words.take(pa.array(term[a : a + ROWS])), pa.array(tf[a : a + ROWS])],
                        ["row", "length", "term", "tf"],
                    )
                at += len(lists)

    return rows.filter(F.col("text").isNotNull()).mapInArrow(run, "row long, length long, term string, tf long")


def _without_empty(row: np.ndarray, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Only the places of words that are not empty; the empty one sorts first."""
    filled = code > 0 if len(words) and words[0].as_py() == "" else np.ones(len(code), bool)
    return row[filled], code[filled], words


def _pairs(row: np.ndarray, code: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of words and of those ``distance`` words after them."""
    one = row[distance:] == row[: len(row) - distance] if len(row) > distance else np.zeros(0, bool)
    return code[: len(one)][one], code[distance:][one]


def _pair_hashes(words: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    own = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return runs._mixed(own[a] * runs._BASE + own[b])


def _frequent_pairs(rows: DataFrame, distances: Sequence[int], least: int):
    """A filter that lets all pairs seen ``least`` times through, shared with all tasks; see ``segment``."""
    spark, size = rows.sparkSession, rows.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    split = runs._split(size * len(distances))

    def count(batches):
        for batch in batches:
            for lists in _pieces(batch.column(0), max(1, PIECE // len(distances))):
                row, code, words = _without_empty(*_coded(lists))
                found = [_pair_hashes(words, *_pairs(row, code, d)) for d in distances]
                if any(map(len, found)):
                    yield runs._count_arrays(found, split)

    with freed_shuffles(spark):
        arrays = rows.mapInArrow(count, "part int, hashes binary, counts binary")
        return spark.sparkContext.broadcast(runs._filter_of(spark, runs.seen_often(arrays, least, split)))


def _counted(texts: pa.Array, distances: Sequence[int], ordered: bool, empty: bool, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of words and pairs, piece by piece, ``ROWS`` pairs at a time; with ``bits`` only pairs whose hash is set."""
    for lists in _pieces(texts, max(1, PIECE // len(distances))):
        row, code, words = _coded(lists) if empty else _without_empty(*_coded(lists))
        n = np.bincount(code, minlength=len(words))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(n[some])], ["a", "b", "n"])
        pairs = []
        for d in distances:
            a, b = _pairs(row, code, d)
            pairs.append(a * len(words) + b if ordered else np.minimum(a, b) * len(words) + np.maximum(a, b))
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        first, second = np.divmod(pair, max(len(words), 1))
        if bits is not None and len(pair):
            passed = runs._is_set(_pair_hashes(words, first, second), bits)
            first, second, n = first[passed], second[passed], n[passed]
        for at in range(0, len(n), ROWS):
            a, b = (words.take(pa.array(x[at : at + ROWS])) for x in (first, second))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(n[at : at + ROWS])], ["a", "b", "n"])


def pair_counts(df: DataFrame, text: Column, distances: Sequence[int], ordered: bool, empty: bool, least: int = 1) -> DataFrame:
    """(a, b, n): how often every word occurs (b null), and how often b stands one of ``distances`` words after a; unless
    ``ordered`` either way round, the smaller word as a. Empty words count only with ``empty``.

    Ordered pairs seen fewer than ``least`` times may be missing: a first pass over the text, which should be written, counts
    their hashes, and only what may be seen so often is counted as written. Pieces are the smaller the more distances there are.
    """
    rows = df.select(text.alias("text"))
    bits = _frequent_pairs(rows, distances, least) if least > 1 and ordered and not empty else None

    def run(batches):
        for batch in batches:
            yield from _counted(batch.column(0), distances, ordered, empty, bits and bits.value)

    return rows.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
