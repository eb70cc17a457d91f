"""Language-model scores with a probabilistic suffix tree over words, and one over the bytes that spell them.

The tree's symbols are the words of a text and its end, a state is a sequence of up to ``WORDS`` words read before. With t
occurrences of a state's words among the training tokens, followed by k kinds of symbols, a symbol that followed n times has
the probability ``(max(n - 1, 0) + k p) / t``, p being that of the state's longest retained suffix: each kind gives up one
occurrence, dealt out as the suffix would. A state is retained if this raises the log likelihood of what followed it, every
occurrence predicted from the others, by more than ``DIVERGENCE``; the longest retained suffix of what was read predicts the next symbol. Sequences that occur once take no part in a sum
but through t and k, so those that occur twice, their number and t give the exact result. Counts are grouped by Spark, one
length after the other; states are tables, and texts are joined with them.

The state of no words is the model of single words below. Its tree is over the bytes of lower-cased words, each closed by a space. A context of up to ``DEPTH``
bytes, not reaching back beyond the space before its word, is a candidate however rare it is in
the training texts, and is retained if its next-symbol distribution diverges from that of its suffix
(count times Kullback-Leibler divergence). A state's distribution is smoothed by its suffix's, and the longest
retained suffix of what was read is the state that predicts the next symbol.

A word's spelling probability q is the product over its bytes and the closing space; the end of a text is
one more symbol. With c occurrences among N training tokens of V kinds, the word's probability is
``(max(c - D, 0) + D (E + (1 - E) V q)) / (N + 1)``: each kind gives up D of a count, and of what is given up E is
dealt out evenly, as the base does, and the rest by the tree. As in the base, all new words share what is left.

Corpus counts are grouped by Spark, which also grows the tree, level by level with joins. The retained contexts with all
their next symbols are sent to every task; they are as many as pass the divergence test. So are words of at
least 1 / ``HOT`` of all tokens; all other words are joined.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.words import U64, Words, blocks, mix
from reviewlens.operators.lookup import attach_by_key
from reviewlens.session import cut_lineage, scratch_path, stored

DEPTH = 5
DIVERGENCE = 12.0  # nats gained over all occurrences of a context
DISCOUNT, EVEN = 0.9, 0.8
GAMMA = 4.0  # weight of the suffix's distribution in a state's
HOT = 1 << 21
CHUNK = 200_000  # words whose n-grams are combined before they leave a task
WORDS = 2  # longest state of the tree over words
GRAMS = 1_000_000  # sequences of words combined before they leave a task
FILTER = 1 << 26  # bits of the filter that keeps sequences of no use from being shuffled
ENDING = U64(0x5851F42D4C957F2D)  # stands for the end of a text among words' hashes
SPACE, END, TOTAL = 0x20, 0x0A, 0x0B  # neither END nor TOTAL occurs in a word


def _strings(w: Words, at: np.ndarray) -> pa.Array:
    """The words numbered ``at`` as strings."""
    size = w.end[at] - w.begin[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = w.data[np.repeat(w.begin[at] - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and for each the sum of every array of values."""
    keys, where = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(where, weights=v, minlength=len(keys)).astype(np.int64) for v in values)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, word, c, n): occurrences of every word in texts with ``learn`` and in all; docs: text, learn."""

    def run(batches):
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            for at, to, w in blocks(batch.column("text")):
                keys, first, where = np.unique(w.hash, return_index=True, return_inverse=True)
                n = np.bincount(where, minlength=len(keys))
                c = np.bincount(where, weights=learn[at:to][w.row()], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), _strings(w, first).cast(pa.string()), pa.array(c), pa.array(n)], ["h", "word", "c", "n"]
                )

    rows = docs.select("text", "learn").mapInArrow(run, "h long, word string, c long, n long")
    return rows.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word its bytes and a closing space: (symbols, place in the word, number of the word)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.diff(places) + 1
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(ends[-1] if len(ends) else 0) - (ends - size)[word]
    symbols = np.full(len(word), SPACE, np.uint64)
    inner = place < size[word] - 1
    symbols[inner] = np.frombuffer(data, np.uint8)[(places[:-1][word] + place)[inner]]
    return symbols, place, word


def _contexts(symbols: np.ndarray, place: np.ndarray):
    """(d, places, context keys) for every context length d at the places that have one. A word's first symbol has the
    space before it as its only context."""
    context = np.zeros(len(symbols), U64)
    yield 0, np.arange(len(symbols)), context
    for d in range(1, DEPTH + 1):
        at = np.flatnonzero(place >= d - 1)
        older = np.full(len(at), SPACE, U64)
        inside = place[at] >= d
        older[inside] = symbols[at[inside] - d]
        context = context.copy()
        context[at] |= older << U64(8 * (d - 1))
        yield d, at, U64(d) << U64(48) | context[at]


def ngram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): occurrences of every context and next symbol, ``TOTAL`` for all next symbols; words: word, c."""

    def grams(column: pa.Array, c: np.ndarray) -> pa.RecordBatch:
        symbols, place, word = _symbols(column)
        keys, counts = [], []
        for _, at, context in _contexts(symbols, place):
            for following in (symbols[at], np.full(len(at), TOTAL, U64)):
                k, n = _sums(context << U64(8) | following, c[word[at]])
                keys.append(k)
                counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts))], ["gram", "n"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                table, held, rows = pa.Table.from_batches(held).combine_chunks(), [], 0
                yield grams(table.column("word").chunk(0), table.column("c").to_numpy())
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield grams(table.column("word").chunk(0), table.column("c").to_numpy())

    return words.filter("c > 0").select("word", "c").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Tree(NamedTuple):
    """Sorted tables: retained contexts with the share left to their suffix, and next symbols with their smoothed probability."""

    states: np.ndarray
    left: np.ndarray
    grams: np.ndarray
    probability: np.ndarray

    def _step(self, below: np.ndarray, gram: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Probabilities one level deeper, for retained states (places in ``states``)."""
        if not len(self.grams):
            return self.left[state] * below
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return np.where(self.grams[at] == gram, self.probability[at], self.left[state] * below)

    def log10(self, column: pa.Array) -> np.ndarray:
        """log10 of every word's spelling probability."""
        symbols, place, word = _symbols(column)
        p, open_ = np.full(len(symbols), 1 / 256), np.ones(len(symbols), bool)
        for _, at, context in _contexts(symbols, place):
            going = open_[at]
            at, context = at[going], context[going]
            state = np.minimum(np.searchsorted(self.states, context), len(self.states) - 1)
            known = self.states[state] == context
            open_[at[~known]] = False
            at, context, state = at[known], context[known], state[known]
            p[at] = self._step(p[at], context << U64(8) | symbols[at], state)
        return np.bincount(word, weights=np.log10(p), minlength=len(column))

    def end(self) -> float:
        """Probability that a text ends where a word could begin."""
        p = np.full(1, 1 / 256)
        for context in (0, 1 << 48 | SPACE):
            state = np.searchsorted(self.states, U64(context))
            if state < len(self.states) and self.states[state] == context:
                p = self._step(p, np.array([context << 8 | END], U64), np.array([state]))
        return float(p[0])


def grow(grams: np.ndarray, n: np.ndarray, divergence: float = DIVERGENCE) -> Tree:
    """The tree from n-gram counts (with ``TOTAL`` rows); contexts without a total are not frequent enough."""
    following = grams & U64(0xFF)
    total = following == TOTAL
    totals = dict(zip((grams[total] >> U64(8)).tolist(), n[total].tolist(), strict=True))
    by_context: dict[int, dict[int, int]] = {}
    for context, symbol, count in zip((grams[~total] >> U64(8)).tolist(), following[~total].tolist(), n[~total].tolist(), strict=True):
        if context in totals:
            by_context.setdefault(context, {})[symbol] = count

    def suffix(context: int) -> int:
        d = context >> 48
        return (d - 1) << 48 | context & ((1 << 8 * (d - 1)) - 1)

    smoothed: dict[int, tuple[float, dict[int, float]]] = {}

    def probability(context: int | None, symbol: int) -> float:
        if context is None:
            return 1 / 256
        left, own = smoothed[context]
        return own[symbol] if symbol in own else left * probability(suffix(context) if context >> 48 else None, symbol)

    keep = set()
    for context in sorted(totals, key=lambda c: (c >> 48, c)):
        below = suffix(context) if context >> 48 else None
        if below is not None and below not in smoothed:
            continue
        own, all_ = by_context.get(context, {}), totals[context]
        weight = all_ - sum(own.values()) + GAMMA
        before = {s: probability(below, s) for s in own}
        smoothed[context] = weight / (all_ + GAMMA), {s: (c + weight * before[s]) / (all_ + GAMMA) for s, c in own.items()}
        gain = sum(c * np.log(c / all_ / before[s]) for s, c in own.items())
        if below is None or gain > divergence:
            while context is not None and context not in keep:
                keep.add(context)
                context = suffix(context) if context >> 48 else None
    # A dropped context predicts like its suffix: smooth the retained ones anew, by length, from retained ones only.
    smoothed = {}
    for context in sorted(keep, key=lambda c: (c >> 48, c)):
        own, all_, below = by_context.get(context, {}), totals[context], suffix(context) if context >> 48 else None
        weight = all_ - sum(own.values()) + GAMMA
        smoothed[context] = weight / (all_ + GAMMA), {s: (c + weight * probability(below, s)) / (all_ + GAMMA) for s, c in own.items()}
    states = np.array(sorted(smoothed), U64)
    pairs = sorted((c << 8 | s, p) for c, (_, own) in smoothed.items() for s, p in own.items())
    return Tree(states, np.array([smoothed[c][0] for c in states.tolist()]), np.array([k for k, _ in pairs], U64), np.array([p for _, p in pairs]))


def grown(counts: DataFrame, divergence: float = DIVERGENCE) -> Tree:
    """The tree of ``grow``, grown by Spark from the complete n-gram counts (gram, n); only retained contexts are collected."""
    rows = counts.select(F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(0xFF).alias("symbol"), "n")
    rows = cut_lineage(rows)
    totals = rows.filter(F.col("symbol") == TOTAL).select("context", F.col("n").alias("total"))
    rows = rows.filter(F.col("symbol") != TOTAL)
    levels = []
    for d in range(DEPTH + 1):
        at_depth = F.shiftright("context", 48) == d
        own = rows.filter(at_depth).join(totals.filter(at_depth), "context")
        if d:
            suffix = F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1).bitwiseOR((d - 1) << 48)
            below = levels[-1].select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("before"))
            own = own.withColumn("suffix", suffix).join(below, ["suffix", "symbol"])
        else:
            own = own.withColumn("suffix", F.lit(None).cast("long")).withColumn("before", F.lit(1 / 256))
        p = (F.col("n") + GAMMA * F.col("before")) / (F.col("total") + GAMMA)
        levels.append(cut_lineage(own.select("context", "suffix", "symbol", "n", "total", "before", p.alias("p"))))
    keep, kept = None, []
    for d in range(DEPTH, -1, -1):
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("before")))
        tested = levels[d].groupBy("context").agg(gain.alias("gain"), F.first("suffix").alias("suffix"))
        chosen = tested.filter((F.col("gain") > divergence) | F.lit(d == 0)).select("context", "suffix")
        if keep is not None:
            chosen = chosen.union(tested.join(keep, "context", "left_semi").select("context", "suffix")).distinct()
        chosen = cut_lineage(chosen)
        keep = chosen.select(F.col("suffix").alias("context")).distinct()
        kept.append(levels[d].join(chosen.select("context"), "context", "left_semi").select("context", "symbol", "total", "p").toArrow())
    context, symbol, total, p = (np.concatenate([t[c].to_numpy() for t in kept]) for c in ("context", "symbol", "total", "p"))
    states, first = np.unique(context.astype(np.int64).view(U64), return_index=True)
    grams = context.astype(np.int64).view(U64) << U64(8) | symbol.astype(U64)
    order = np.argsort(grams)
    return Tree(states, GAMMA / (total[first].astype(float) + GAMMA), grams[order], p[order].astype(float))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``stored``; the files of the shuffles behind it go at once and not when the driver's heap is next swept."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(_CLEANUP, before)


def _sequences(w: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Hashes of every text's words and end, the texts they are of, and for every length d of a state, from 1: the places that have
    one, its key, the key of the last d symbols, and that of both together."""
    h = np.insert(w.hash, w.first[1:], ENDING)
    size = np.diff(w.first) + 1
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    key, levels = h, []
    for d in range(1, WORDS + 1):
        at = np.flatnonzero(place >= d)
        levels.append((at, key[at - 1], key[at], _joint(key[at - 1], key[at], d)))
        key = np.zeros(len(h), U64)
        key[at] = levels[-1][3]
    return h, np.repeat(np.arange(len(size)), size), levels


def _joint(context: np.ndarray, suffix: np.ndarray, d: int) -> np.ndarray:
    return mix(context + U64(d)) + suffix


def _filter(keys: DataFrame, also: np.ndarray) -> np.ndarray:
    """``FILTER`` bits, those of the keys set (one column): of a fixed size, so that it may pass others too."""

    def run(batches):
        found = np.zeros(FILTER, bool)
        for batch in batches:
            found[batch.column(0).to_numpy().view(U64) % U64(FILTER)] = True
        for at, part in enumerate(np.packbits(found).reshape(64, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "bits"])

    def add(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
        return pa.table({"at": table["at"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    bits = np.zeros((64, FILTER // 512), np.uint8)
    for row in keys.mapInArrow(run, "at int, bits binary").groupBy("at").applyInArrow(add, "at int, bits binary").collect():
        bits[row["at"]] = np.frombuffer(row["bits"], np.uint8)
    bits = bits.ravel()
    np.bitwise_or.at(bits, (also % U64(FILTER) >> U64(3)).astype(np.int64), (U64(128) >> (also & U64(7))).astype(np.uint8))
    return bits


def _passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[(keys % U64(FILTER) >> U64(3)).astype(np.int64)] << (keys & U64(7)).astype(np.uint8) & 128) > 0


def sequence_counts(docs: DataFrame, d: int, thrice: np.ndarray, twice: np.ndarray) -> DataFrame:
    """(key, context, suffix, n): sequences of d + 1 symbols that occur n >= 2 times, after states that occur three times (others
    are never retained); docs: text. The filters pass all sequences of d symbols that occur three times or twice."""
    shared = docs.sparkSession.sparkContext.broadcast((thrice, twice))

    def combined(held):
        context, suffix, key = (np.concatenate(part) for part in zip(*held, strict=True))
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(context[first].view(np.int64)), pa.array(suffix[first].view(np.int64)), pa.array(n)], ["context", "suffix", "n"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for _, _, w in blocks(batch.column("text")):
                _, context, suffix, key = _sequences(w)[2][d - 1]
                some = _passing(shared.value[0], context) & _passing(shared.value[1], suffix)
                held.append((context[some], suffix[some], key[some]))
                rows += len(held[-1][0])
                if rows >= GRAMS:
                    yield combined(held)
                    held, rows = [], 0
        if held:
            yield combined(held)

    def named(batches):
        for batch in batches:
            context, suffix = (batch.column(c).to_numpy().view(U64) for c in ("context", "suffix"))
            yield pa.RecordBatch.from_arrays([pa.array(_joint(context, suffix, d).view(np.int64)), *batch.columns], ["key", "context", "suffix", "n"])

    found = docs.select("text").mapInArrow(run, "context long, suffix long, n long").groupBy("context", "suffix").agg(F.sum("n").alias("n"))
    return found.filter("n > 1").mapInArrow(named, "key long, context long, suffix long, n long")


def states(docs: DataFrame, words: DataFrame, divergence: float = DIVERGENCE) -> tuple[DataFrame, DataFrame]:
    """(context, left) of retained one-word states, and (key, n, value) of longer sequences.

    docs: text, to learn from; words: (key, n, p) with training occurrences and log10 probability of every word seen twice, the end of
    a text among them. left and value are log10 factors: what every symbol after a state is multiplied by, and what a
    sequence adds by its last symbol, and, itself a state, to the next one.
    """
    before, singles, parts = words, None, []
    for d in range(1, WORDS + 1):
        thrice = _filter(before.filter("n > 2").select("key"), np.zeros(0, U64))
        twice = _filter(before.select("key"), np.array([ENDING], U64))
        grams = _kept(sequence_counts(docs, d, thrice, twice), "grams")
        # Sequences that occur twice or once can only lower a state's gain.
        sums = grams.groupBy("context").agg(F.sum(F.col("n") - 1).alias("twice"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("most")).filter("most > 2")
        totals = before.select(F.col("key").alias("context"), F.col("n").alias("t"))
        sums = _kept(sums.join(totals, "context").select("context", "t", (F.col("t") - F.col("twice")).alias("k"), "rows"), "sums")
        spread = before.select(F.col("key").alias("suffix"), "p", F.col("n").alias("weight"))
        known = attach_by_key(attach_by_key(grams, sums, "context", "t"), spread, "suffix", "weight")
        dealt = F.col("k") * F.pow(F.lit(10.0), "p")
        without = F.log10((F.col("n") - 2 + dealt) / (F.col("t") - 1))
        # Of symbols that followed once, n and k fall by the occurrence left out.
        once = F.first("k") - F.first("rows")
        others = F.when(once > 0, once * F.log10((F.first("k") - 1) / (F.first("t") - 1))).otherwise(0.0)
        gain = (F.sum(F.col("n") * (without - F.col("p"))) + others) * F.log(F.lit(10.0))
        retained = known.groupBy("context").agg(gain.alias("gain"), F.first("t").alias("t"), F.first("k").alias("k")).filter(F.col("gain") > divergence)
        retained = _kept(retained.select("context", "t", "k"), "states")
        kept = retained.select("context", F.log10(F.col("k") / F.col("t")).alias("left"))
        inside = attach_by_key(attach_by_key(grams, retained, "context", "t"), spread, "suffix", "weight")
        inside = inside.withColumn("own", F.log10((F.col("n") - 1 + dealt) / F.col("t")))
        inside = _kept(inside.select("key", "n", F.col("own").alias("p"), (F.col("own") - F.col("p") - F.log10(F.col("k") / F.col("t"))).alias("value")), "inside")
        if d < WORDS:
            rest = attach_by_key(grams, spread, "suffix", "weight").join(retained, "context", "left_anti")
            before = _kept(inside.select("key", "n", "p").unionByName(rest.select("key", "n", "p")), "sequences")
        if d == 1:
            singles = kept
        else:
            # A state's own key, whether or not its last symbol adds something.
            parts.append(heads.join(kept.select(F.col("context").alias("key"), F.col("left").alias("value")), "key"))
        parts.append(inside.select("key", "n", "value"))
        if d < WORDS:
            heads = before.select("key", "n")
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    return singles, _kept(values.groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value")), "values")


class _Hot(NamedTuple):
    h: np.ndarray
    known: np.ndarray
    base: np.ndarray
    score: np.ndarray


def scores(docs: DataFrame, learn: Column, divergence: float = DIVERGENCE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Rows where ``learn`` holds (null counts as false) are learned from. A text is its words and one end, counted as a
    token; a null or empty text is its end alone. n_known counts tokens seen in training, train_tokens is N.
    base_score is the sum of log10((c + 1) / (N + V + 1)), score that of the model. Repeated rows are
    scored each; with nothing to learn from all words are new. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = _kept(word_counts(rows), "words")
    ends = rows.filter("learn").count()
    n, kinds, everything = (x or 0 for x in words.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long")), F.sum("n")).collect()[0])
    n, kinds = n + ends, kinds + (ends > 0)
    counts = ngram_counts(words)
    # The end of a text follows the space after a word (or nothing).
    extra = [(c << 8 | s, ends) for c in (0, 1 << 48 | SPACE) for s in (END, TOTAL)] if ends else []
    counts = counts.union(spark.createDataFrame(extra, "gram long, n long")).groupBy("gram").agg(F.sum("n").alias("n"))
    tree = grown(counts, divergence) if n else grow(np.array([TOTAL], U64), np.array([0]), divergence)
    whole = n + kinds + 1

    def model(c, log10_q):
        return np.log10((np.maximum(c - DISCOUNT, 0) + DISCOUNT * (EVEN + (1 - EVEN) * kinds * 10.0**log10_q)) / (n + 1))

    def spell(batches):
        for batch in batches:
            c = batch.column("c").to_numpy()
            score = model(c, tree.log10(batch.column("word")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("n"), pa.array((c > 0).astype(np.int64)), pa.array(np.log10((c + 1) / whole)), pa.array(score)],
                ["h", "n", "known", "base", "score"],
            )

    path = scratch_path(spark, "word-scores")
    words.mapInArrow(spell, "h long, n long, known long, base double, score double").write.parquet(path)
    spelled = spark.read.parquet(path)
    ending = (int(ends > 0), float(np.log10((ends + 1) / whole)), float(model(ends, np.log10(tree.end()))))
    bits = np.zeros(FILTER // 8, np.uint8)
    if n:
        end = spark.createDataFrame([(int(ENDING), ends, ending[2])], "key long, n long, p double")
        seen = words.filter("c > 1").select("h", "c").join(spelled.select("h", "score"), "h").select(F.col("h").alias("key"), F.col("c").alias("n"), F.col("score").alias("p"))
        singles, longer = states(rows.filter("learn"), _kept(seen.unionByName(end), "words-seen"), divergence)
        bits = _filter(longer.select("key"), np.zeros(0, U64))
        after = singles.select(F.col("context").alias("h"), "left")
        spelled = spelled.join(after, "h", "left").withColumn("score", F.col("score") + F.coalesce("left", F.lit(0.0))).drop("left")
        longer = longer.select(F.col("key").alias("h"), "n", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("value").alias("score"))
        spelled = _kept(spelled.unionByName(longer), "values")
    shared = spark.sparkContext.broadcast(bits)
    # Fewer than ``hot`` words, or sequences of one length, can hold more than 1 / hot of all tokens.
    often = F.col("n") * F.lit(hot) > F.lit(everything)
    table = spelled.filter(often).select("h", "known", "base", "score").toArrow().sort_by("h")
    table = _Hot(*(table[c].to_numpy() for c in ("h", "known", "base", "score")))

    def by_text(batches):
        row, start = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, w in blocks(batch.column("text")):
                _, of, levels = _sequences(w)
                text = np.concatenate([w.row(), *(of[found] for found, *_ in levels)])
                h = np.concatenate([w.hash, *(key for *_, key in levels)]).view(np.int64)
                rare = np.ones(len(h), bool)
                rare[len(w.hash) :] = _passing(shared.value, h[len(w.hash) :].view(U64))
                text, h = text[rare], h[rare]
                place = np.searchsorted(table.h, h)
                found = place < len(table.h)
                found[found] = table.h[place[found]] == h[found]
                place, own = place[found], text[found]
                sums = [np.bincount(own, weights=v[place], minlength=to - at) for v in (table.known, table.base, table.score)]
                names = start + row + np.arange(to - at)
                tokens = np.diff(w.first) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names), ids.slice(at, to - at), pa.array(mix(names.astype(U64)).view(np.int64)), pa.array(np.zeros(to - at, bool)),
                        pa.array(tokens), pa.array(sums[0].astype(np.int64) + ending[0]), pa.array(sums[1] + ending[1]), pa.array(sums[2] + ending[2]),
                    ],
                    columns,
                )
                text, h = text[~found], h[~found]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(h)))
                k = len(begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[text[begin]]), pa.nulls(k, ids.type), pa.array(h[begin]), pa.array(np.ones(k, bool)),
                        pa.array(times), pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k)), pa.array(np.zeros(k)),
                    ],
                    columns,
                )
                row += to - at

    columns = ["row", "doc_id", "h", "is_word", "times", "n_known", "base_sum", "score_sum"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = rows.select("doc_id", "text").mapInArrow(by_text, f"row long, doc_id {kind}, h long, is_word boolean, times long, n_known long, base_sum double, score_sum double")
    rare = spelled.filter(~often).withColumn("of_word", F.lit(True)).drop("n")
    joined = parts.join(rare.withColumnRenamed("h", "own"), (F.col("h") == F.col("own")) & F.col("is_word"), "left")
    times = F.col("times")
    tokens = F.max(F.when(~F.col("is_word"), times))
    return (
        joined.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), tokens.alias("n_tokens"),
            F.sum(F.when(F.col("is_word"), times * F.col("known")).otherwise(F.col("n_known"))).alias("n_known"),
            F.sum(F.when(F.col("is_word"), times * F.col("base")).otherwise(F.col("base_sum"))).alias("base_score"),
            F.sum(F.when(F.col("is_word"), times * F.col("score")).otherwise(F.col("score_sum"))).alias("score"),
        ).select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )
