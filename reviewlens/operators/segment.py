"""Word segmentation: white-space separated syllables put together to words of one to four.

A lexicon gives words a cost. Of all ways to cut a sentence into words the cheapest is taken (shortest path
through the lattice of lexicon words, found by walking a trie from every place). Costs are whole numbers,
thousandths of a natural logarithm, so sums are exact and equal everywhere; of equally cheap ways the one whose first word
is longest, then the second, and so on.

Words never go over the end of a sentence, which is a syllable ending in one of ``.!?``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.operators.lookup import attach_by_key
from reviewlens.session import freed_shuffles, stored

LONGEST = 4
LEAST = 5
THRESHOLD = 100.0  # a joint must be so many times as frequent as chance makes it
UNKNOWN = 25_000  # cost of a syllable that is no word of the lexicon
LEXICON_LIMIT = 1_000_000  # words that may be sent to every task; larger lexicons are joined
JOINT = "_"

# What ends a sentence, and the same before a line break that is no white space, as ``$`` has it.
_END = r"[.!?]$"
_END_OF_RUN = r"[.!?][\x{85}\x{2028}\x{2029}]?$"
_NEVER = 1 << 40  # cost of a word that the lexicon does not have

_SLICE = 2_000  # rows looked at together within a task
_HELD = 2_000_000  # runs counted together before they leave a task
_PART = 8 << 20  # bytes of text whose hashes one part of them holds
_BLOCK = 11  # 2 ** 11 rows of a partition share one part of a joined lexicon
_FILTER = 27  # 2 ** 27 places in the filter of frequent runs (16 MB), whatever the corpus
_PLACES = 15  # 2 ** 15 places in a row of ``bitmap_construct_agg``
_BASE = np.uint64(0x9E3779B97F4A7C15)


# --- syllables of many texts -----------------------------------------------------------------


@dataclass
class _Syllables:
    """All syllables of some texts, one after the other."""

    flat: pa.Array
    offsets: np.ndarray  # of the texts
    codes: np.ndarray  # places in ``distinct``
    distinct: pa.Array

    def stops(self, pattern: str) -> np.ndarray:
        """True where a word must end: at the ends of sentences and texts."""
        ends = pc.match_substring_regex(self.distinct, pattern).to_numpy(zero_copy_only=False).astype(bool)
        stop = ends[self.codes] if len(self.codes) else np.zeros(0, bool)
        stop[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = True
        return stop


def _syllables(texts: pa.Array) -> _Syllables:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    filled = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))]).astype(np.int64)
    offsets = before[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    flat = flat.filter(filled)
    coded = flat.dictionary_encode()
    return _Syllables(flat, offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


# --- cutting ---------------------------------------------------------------------------------


@dataclass
class Trie:
    """The words of a lexicon as a tree in sorted arrays, level by level.

    A node of a level is the place of (node above) * (number of syllables) + syllable in ``keys``.
    """

    syllables: pa.Array
    keys: list[np.ndarray]
    costs: list[np.ndarray]


def _trie(words: pa.Array, costs: np.ndarray) -> Trie:
    parts = pc.split_pattern(words, JOINT)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    node, width = np.zeros(len(sizes), np.int64), len(coded.dictionary)
    out = Trie(coded.dictionary, [], [])
    for level in range(int(sizes.max(initial=0))):
        deep = sizes > level
        keys, place = np.unique(node[deep] * width + codes[first[deep] + level], return_inverse=True)
        node[deep] = place
        price = np.full(len(keys), _NEVER, np.int64)
        here = sizes == level + 1
        price[node[here]] = costs[here]
        out.keys.append(keys)
        out.costs.append(price)
    return out


def trie(costs: Mapping[str, int]) -> Trie:
    """The words of a lexicon, syllables joined by ``_``, as a tree."""
    return _trie(pa.array(list(costs), pa.string()), np.array(list(costs.values()), np.int64))


def _own_prices(found: _Syllables, root: Trie, stop: np.ndarray) -> Iterator[np.ndarray]:
    """Per number of syllables the cost of the tree's word from every place."""
    n, width = len(found.codes), len(root.syllables)
    own = pc.fill_null(pc.index_in(found.distinct, value_set=root.syllables), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = own[found.codes] if n else np.zeros(0, np.int64)
    at, node = np.arange(n), np.zeros(n, np.int64)
    for level, (keys, costs) in enumerate(zip(root.keys, root.costs, strict=True)):
        if level:
            more = ~stop[at + level - 1]
            at, node = at[more], node[more]
        code = codes[at + level]
        key = node * width + code
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (code >= 0) & (keys[place] == key)
        at, node = at[hit], place[hit]
        price = np.full(n, _NEVER, np.int64)
        price[at] = costs[node]
        yield price


def _prices(found: _Syllables, roots: Sequence[Trie], unknown: int) -> list[np.ndarray]:
    """Per number of syllables the cost of the word from every place; no word is in two of the trees."""
    stop, prices = found.stops(_END), [np.full(len(found.codes), _NEVER, np.int64)]
    for root in roots:
        for level, price in enumerate(_own_prices(found, root, stop)):
            if level < len(prices):
                np.minimum(prices[level], price, out=prices[level])
            else:
                prices.append(price)
    prices[0][prices[0] == _NEVER] = unknown
    return prices


def _word_starts(found: _Syllables, roots: Sequence[Trie], unknown: int) -> np.ndarray:
    """True at the first syllable of every word of the cheapest ways.

    Syllables that no longer word holds together are cut apart first; the rest are stretches, all walked at the same time,
    from their ends for the costs and from their beginnings for the words.
    """
    prices = _prices(found, roots, unknown)
    n = len(found.codes)
    held = np.zeros(n + 1, bool)  # together with the next
    for k, price in enumerate(prices[1:], 2):
        at = np.flatnonzero(price < _NEVER)
        for step in range(k - 1):
            held[at + step] = True
    starts = np.ones(n, bool)
    edge = np.diff(np.concatenate([[False], held[:n], [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # last: after the stretch
    order = np.argsort(first - last, kind="stable")
    first, last = first[order], last[order]
    size = last - first
    best, take = np.zeros(n + 1, np.int64), np.ones(n, np.int8)
    for step in range(1, int(size.max(initial=0)) + 1):
        at = last[: np.searchsorted(-size, -step, "right")] - step
        low = prices[0][at] + (best[at + 1] if step > 1 else 0)
        words = np.ones(len(at), np.int8)
        for k in range(2, min(len(prices), step) + 1):
            cost = prices[k - 1][at] + (best[at + k] if k < step else 0)
            better = cost <= low
            low, words = np.where(better, cost, low), np.where(better, np.int8(k), words)
        best[at], take[at] = low, words
    at = first
    starts[:n][held[:n]] = False
    starts[last - 1] = False
    while len(at):
        starts[at] = True
        at = at + take[at]
        inside = at < last
        at, last = at[inside], last[inside]
    return starts


def cheapest(syllables: Sequence[str], root: Trie, unknown: int = UNKNOWN) -> list[int]:
    """How many syllables each word of the cheapest way has."""
    starts = np.flatnonzero(_word_starts(_syllables(pa.array([" ".join(syllables)], pa.string())), [root], unknown))
    return np.diff(np.append(starts, len(syllables))).tolist()


def _joined(texts: pa.Array, roots: Sequence[Trie], unknown: int = UNKNOWN) -> pa.Array:
    """The texts as words; null texts stay null."""
    done = []
    for begin in range(0, len(texts), _SLICE):
        part = texts.slice(begin, _SLICE)
        found = _syllables(part)
        glue = np.where(np.append(_word_starts(found, roots, unknown)[1:], True)[: len(found.flat)], 0, 1)
        glue[found.offsets[1:][np.diff(found.offsets) > 0] - 1] = 2
        pieces = pc.binary_join_element_wise(found.flat, pa.array([" ", JOINT, ""]).take(pa.array(glue)), "")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), pieces), "")
        done.append(pc.if_else(pc.is_null(part), pa.scalar(None, pa.string()), whole))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


# --- runs of syllables -----------------------------------------------------------------------


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, factor) of words: the hash of a_b is hash(a) * factor(b) + hash(b), so equal strings agree however they are put together."""
    parts = pc.split_pattern(words, JOINT)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    single = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    single = single[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    value, factor = np.zeros(len(sizes), np.uint64), np.ones(len(sizes), np.uint64)
    for level in range(int(sizes.max(initial=0))):
        deep = sizes > level
        value[deep] = value[deep] * _BASE + single[first[deep] + level]
        factor[deep] *= _BASE
    return value, factor


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(29))


def _in_filter(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return _is_set(_mixed(value), bits)


def _is_set(mixed: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = (mixed & np.uint64((1 << _FILTER) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _runs(found: _Syllables, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, hashes) of all runs of up to ``longest`` syllables that stay within a sentence."""
    value, factor = _codes(found.distinct)
    value, factor = value[found.codes], factor[found.codes]
    stop, at = found.stops(_END_OF_RUN), np.arange(len(found.codes))
    run = value.copy()
    for k in range(1, longest + 1):
        if k > 1:
            more = ~stop[at + k - 2]
            at, run = at[more], run[more]
            run = run * factor[at + k - 1] + value[at + k - 1]
        yield k, at, run


def _written(found: _Syllables, at: np.ndarray, k: int) -> pa.Array:
    return pc.binary_join_element_wise(*[found.flat.take(pa.array(at + j)) for j in range(k)], JOINT)


def _may_be_frequent(found: _Syllables, longest: int, bits: np.ndarray, tested: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The runs that the filter lets through; above ``tested`` syllables those whose beginning and end it lets through."""
    before = np.zeros(0, bool)
    for k, at, run in _runs(found, longest):
        if k <= tested:
            passed = _in_filter(run, bits)
        else:
            passed = before[at] & before[at + 1]
        before = np.zeros(len(found.codes) + 1, bool)
        before[at[passed]] = True
        yield k, at[passed], run[passed]


def _filter_of(spark, values: DataFrame) -> np.ndarray:
    """One bit per place that any of ``values`` (h) has; of fixed size."""
    place = F.col("h").bitwiseAND(F.lit((1 << _FILTER) - 1))
    rows = values.select(place.alias("at")).groupBy(F.shiftright("at", _PLACES).alias("row")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << _PLACES) - 1))).alias("bits")
    ).collect()
    bits = np.zeros(1 << _FILTER >> 3, np.uint8)
    for r in rows:
        start = r["row"] << _PLACES >> 3
        bits[start : start + (1 << _PLACES >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _split(size: int) -> int:
    """Hashes of runs in ``size`` bytes of text are counted in 2 to the power of this parts."""
    return min(max((max(size, 1) - 1) // _PART, 0).bit_length(), 14)


def _count_arrays(held: list[np.ndarray], split: int) -> pa.RecordBatch:
    """(part, hashes, counts) of mixed hashes: per part 32 more bits of every distinct one, and how often it occurs."""
    value = np.concatenate(held)
    code, n = np.unique(((value & np.uint64((1 << split) - 1)) << np.uint64(32)) | (value >> np.uint64(split) & np.uint64(0xFFFFFFFF)), return_counts=True)
    part, first = np.unique(code >> np.uint64(32), return_index=True)
    ends = pa.py_buffer((np.append(first, len(code)) * 4).astype(np.int32))
    arrays = [(code & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, 0xFFFFFFFF).astype(np.uint32)]
    return pa.RecordBatch.from_arrays(
        [pa.array(part.astype(np.int32)), *[pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(x)]) for x in arrays]],
        ["part", "hashes", "counts"],
    )


def seen_often(arrays: DataFrame, least: int, split: int) -> DataFrame:
    """(h) of the hashes in rows of ``_count_arrays`` whose counts come to ``least``."""

    def add(table: pa.Table) -> pa.Table:
        part = np.uint64(table["part"][0].as_py())
        key, n = (np.concatenate([np.frombuffer(b, np.uint32) for b in table[c].to_pylist()]) for c in ("hashes", "counts"))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        often = key[first][np.add.reduceat(n, first) >= least].astype(np.uint64)
        return pa.table({"h": pa.array((often << np.uint64(split) | part).view(np.int64))})

    return arrays.groupBy("part").applyInArrow(add, "h long")


def _frequent(rows: DataFrame, least: int, sizes: range, bits=None, split: int = 0) -> DataFrame:
    """(h) of hashes of runs of these sizes seen ``least`` times; with the filter only runs whose beginning and end passed it.

    Hashes leave a task as sorted arrays with their counts, 2 ** ``split`` parts of them: no row is made of a run.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                found = _syllables(batch.column(0).slice(begin, _SLICE))
                runs = _runs(found, sizes[-1]) if bits is None else _may_be_frequent(found, sizes[-1], bits.value, sizes[0] - 1)
                held += [_mixed(run) for k, _, run in runs if k in sizes and len(run)]
                size = sum(map(len, held))
                if size >= _HELD:
                    yield _count_arrays(held, split)
                    held, size = [], 0
        if size:
            yield _count_arrays(held, split)

    return seen_often(rows.mapInArrow(count, "part int, hashes binary, counts binary"), least, split)


def _costs(counts: DataFrame, threshold: float) -> DataFrame:
    """(word, n, cost) from (word, n): -ln of the share of all, and ln(threshold) for every joint."""
    total = counts.agg(F.sum(F.when(~F.contains("word", F.lit(JOINT)), F.col("n"))).cast("double").alias("n")).collect()[0]["n"] or 1.0
    joints = F.size(F.split("word", JOINT)) - 1
    cost = F.round((F.log(F.lit(total)) - F.log(F.col("n").cast("double")) + joints * F.log(F.lit(float(threshold)))) * 1000)
    return counts.select("word", "n", cost.cast("long").alias("cost"))


def _gram_counts(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """(word, n) of runs seen ``least`` times. ``rows`` holds only text and is read several times.

    A run seen so often has a beginning and an end, shorter by one syllable, seen as often. Hashes are counted first, sizes one
    and two at once, and a filter of fixed size says which runs may be frequent; what it lets through is counted as written, so
    neither clashing hashes nor a full filter change a count.
    """
    spark, text = rows.sparkSession, F.col(rows.columns[0])
    about = rows.agg(F.max(F.contains(text, F.lit(JOINT))).alias("joint"), F.sum(F.octet_length(text)).alias("bytes")).collect()[0]
    split = _split(about["bytes"] or 0)
    if not about["joint"]:
        first, tested = range(1, min(longest, 2) + 1), max(longest - 1, 1)
    else:
        # A syllable that holds the joint is written like a run, and what is written so often need not begin so.
        first, tested = range(1, longest + 1), longest
    with freed_shuffles(spark):
        bits = _filter_of(spark, _frequent(rows, least, first, split=split))
        for k in range(first[-1] + 1, tested + 1):
            shared = spark.sparkContext.broadcast(bits)
            bits = bits | _filter_of(spark, _frequent(rows, least, range(k, k + 1), shared, split))
    shared = spark.sparkContext.broadcast(bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                found = _syllables(batch.column(0).slice(begin, _SLICE))
                for k, at, _ in _may_be_frequent(found, longest, shared.value, tested):
                    counts = _written(found, at, k).value_counts()
                    yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

    words = rows.mapInArrow(write, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _only_text(df: DataFrame, text: str, written: bool) -> DataFrame:
    rows = df.select(F.col(text).alias("text"))
    return rows if written else stored(rows, "texts")


def _gram_table(rows: DataFrame, longest: int, least: int) -> DataFrame:
    with freed_shuffles(rows.sparkSession):
        return stored(_gram_counts(rows, longest, least), "grams")


def gram_lexicon(
    df: DataFrame, text: str = "cmt", longest: int = LONGEST, least: int = LEAST, threshold: float = THRESHOLD, written: bool = False
) -> DataFrame:
    """(word, n, cost) of all runs of syllables seen at least ``least`` times. A ``written`` table is read as it is, several times."""
    return _costs(_gram_table(_only_text(df, text, written), longest, least), threshold)


def _tree(lexicon: DataFrame) -> Trie:
    rows = lexicon.select("word", "cost").toArrow()
    return _trie(_whole(rows["word"]), rows["cost"].to_numpy().astype(np.int64))


def _least_of(lexicon: DataFrame, limit: int) -> int:
    """The smallest count that no more than ``limit`` words of a lexicon reach."""
    table = lexicon.groupBy("n").count().toArrow().sort_by([("n", "descending")])
    n, fit = table["n"].to_numpy(), np.cumsum(table["count"].to_numpy()) <= limit
    return int(n[fit][-1]) if fit.any() else int(n.max(initial=0)) + 1


def _whole(column) -> pa.Array:
    """One array of strings from a column of a table."""
    return pa.concat_arrays(column.chunks).cast(pa.string()) if column.num_chunks else pa.array([], pa.string())


def segment(df: DataFrame, lexicon: DataFrame, text: str = "cmt", limit: int = LEXICON_LIMIT, longest: int = LONGEST) -> DataFrame:
    """Rewrite ``text``: words of the lexicon (word, cost) in one piece, their syllables joined by ``_``, single blanks between.

    The lexicon is measured. Up to ``limit`` words go to every task; of a larger one (with counts n) the most frequent do, and every
    block of rows gets just the others it may need, by a join that no frequent word can stall. Both give the same text. A null text
    stays null.
    """
    if lexicon.count() <= limit:
        known = _tree(lexicon)
        # Plain arrays: a task need not know this class to read them.
        shared = df.sparkSession.sparkContext.broadcast((known.syllables, known.keys, known.costs))

        @F.arrow_udf(T.StringType())
        def whole(column: pa.Array) -> pa.Array:
            return _joined(column, [Trie(*shared.value)])

        return df.withColumn(text, whole(text))

    # The text is written once, beside the other columns; only these are joined with the new text.
    others = [c for c in df.columns if c != text]
    beside = [F.struct(*others).alias("all")] if others else []
    rows = stored(df.select(*beside, F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")), "rows")
    done = _cut_blocks(rows.select("row", "text"), lexicon, limit, longest)
    back = rows.select("row", "all").join(done, "row", "left") if others else done
    return back.select(*(F.col("done").alias(c) if c == text else F.col("all")[c].alias(c) for c in df.columns))


def _cut_blocks(rows: DataFrame, lexicon: DataFrame, limit: int, longest: int) -> DataFrame:
    """(row, done): the texts of written rows (row, text) cut by a lexicon of more than ``limit`` words."""
    spark, least = rows.sparkSession, _least_of(lexicon, limit)
    known, rest = _tree(lexicon.filter(F.col("n") >= least)), lexicon.filter(F.col("n") < least)
    shared = spark.sparkContext.broadcast((known.syllables, known.keys, known.costs))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(_codes(batch.column(0))[0]).view(np.int64))], ["h"])

    bits = spark.sparkContext.broadcast(_filter_of(spark, rest.select("word").mapInArrow(hashes, "h long")))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                found = _syllables(batch.column("text").slice(begin, end - begin))
                for k, at, _ in _may_be_frequent(found, longest, bits.value, longest):
                    words = _written(found, at, k).unique()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), blocks[begin])), words], ["block", "word"])

    texts = rows.select(F.shiftright("row", _BLOCK).alias("block"), "row", "text")
    spots = texts.select("block", "text").mapInArrow(seen, "block long, word string")
    # A word's occurrences bound the blocks that hold it.
    own = attach_by_key(spots, rest.select("word", "cost", "n"), "word", "n").select("block", "word", "cost")

    def cut(part: pa.Table, words: pa.Table) -> pa.Table:
        costs = words["cost"].to_numpy().astype(np.int64)
        done = _joined(_whole(part["text"]), [Trie(*shared.value), _trie(_whole(words["word"]), costs)])
        return pa.table({"row": part["row"], "done": done})

    return texts.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(cut, "row long, done string")


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of texts (one column), counted in every task before rows are made of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                found = _syllables(batch.column(0).slice(begin, _SLICE))
                yield pa.RecordBatch.from_arrays([found.distinct, pa.array(np.bincount(found.codes, minlength=len(found.distinct)))], ["word", "n"])

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_lexicon(
    df: DataFrame, text: str = "cmt", rounds: int = 3, longest: int = LONGEST, least: int = LEAST,
    threshold: float = THRESHOLD, limit: int = LEXICON_LIMIT,
) -> DataFrame:
    """(word, n, cost) learned from ``text`` alone.

    All frequent runs of syllables are words at first. Each round cuts every text with the present costs, counts
    the words used, drops those used less than ``least`` times and takes new costs from the counts.
    """
    # Written once, numbered, for the first count and all rounds.
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")), "texts")
    lexicon = _costs(_gram_table(rows.select("text"), longest, least), threshold)
    for _ in range(rounds):
        with freed_shuffles(rows.sparkSession):
            if lexicon.count() <= limit:
                words = segment(rows.select("text"), lexicon, "text", limit, longest)
            else:
                words = _cut_blocks(rows, lexicon, limit, longest).select("done")
            counts = _word_counts(words).filter(F.col("n") >= least)
            lexicon = _costs(stored(counts, "words"), threshold)
    return lexicon
