"""Word joining: learn frequent neighbouring pairs, then write them as one word.

Stands in for a dictionary-based word segmenter. The score is the one of Mikolov
et al. (2013), times the number of words so that a threshold keeps its meaning
as the corpus grows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import text as tx
from reviewlens.operators import segment as runs
from reviewlens.operators.counting import pair_counts
from reviewlens.operators.lookup import attach_by_key
from reviewlens.session import freed_shuffles, stored

# Up to this many phrases travel as literals; more go to every task as arrays.
LITERAL_LIMIT = 20_000
# More than so many are joined.
PHRASE_LIMIT = 1_000_000


def learn_phrases(
    df: DataFrame, text: str = "cmt", discount: int = 5, threshold: float = 100.0, written: bool = False
) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, score) for pairs with score of at least ``threshold``. A ``written`` table is read as it is, twice."""
    # Words (no second member) and pairs are counted together; pairs that cannot reach the threshold are left out by their hashes.
    least = int(discount) + 1 if threshold > 0 else 1
    rows = df.select(F.col(text).alias("text"))
    rows = rows if written or least <= 1 else stored(rows, "texts")
    counts = pair_counts(rows, F.col("text"), [1], ordered=True, empty=False, least=least).withColumnRenamed("n", "n_ab")
    if threshold > 0:
        # A pair at or below the discount scores 0 or less and cannot reach the threshold.
        counts = counts.filter(F.col("b").isNull() | (F.col("n_ab") > discount))
    with freed_shuffles(df.sparkSession):
        counts = stored(counts, "counts")
    single = counts.filter(F.col("b").isNull()).select(F.col("a").alias("word"), F.col("n_ab").alias("n"))
    pairs = counts.filter(F.col("b").isNotNull())
    total = single.select(F.sum("n").cast("double")).scalar()
    # A word starts or ends no more distinct pairs than it has occurrences.
    firsts = single.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    seconds = single.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    both = attach_by_key(attach_by_key(pairs, firsts, "a", "n_a"), seconds, "b", "n_b")
    score = (F.col("n_ab") - discount) * total / (F.col("n_a").cast("double") * F.col("n_b"))
    return both.select("a", "b", "n_ab", "n_a", "n_b", score.alias("score")).filter(
        F.col("score") >= threshold
    )


def _known_flags(words: str, known: Sequence[Row]) -> Column:
    """One '0' or '1' per neighbouring pair. As SQL text, since building thousands of literals one
    by one takes longer than reading them from one string."""
    def quoted(word: str) -> str:
        return word.replace("\\", "\\\\").replace("'", "\\'")

    pairs = ", ".join(f"'{quoted(r['a'])} {quoted(r['b'])}'" for r in known)
    count = f"greatest(size({words}) - 1, 0)"
    return F.expr(
        f"array_join(zip_with(slice({words}, 1, {count}), slice({words}, 2, {count}), "
        f"(a, b) -> if(concat_ws(' ', a, b) in ({pairs}), '1', '0')), '')"
    )


def _glued(found: runs._Syllables, hits: np.ndarray) -> pa.Array:
    """The texts with ``_`` between the words of every hit, numbered by its first word; of overlapping ones the left one wins."""
    n = len(found.flat)
    hit = np.zeros(n + 1, bool)
    hit[hits] = True
    # Within a stretch of hits every other one counts, from its first.
    first = hit & ~np.concatenate([[False], hit[:-1]])
    since = np.arange(n + 1) - np.maximum.accumulate(np.where(first, np.arange(n + 1), 0))
    glue = np.where(hit & (since % 2 == 0), 1, 0)[:n]
    glue[found.offsets[1:][np.diff(found.offsets) > 0] - 1] = 2
    pieces = pc.binary_join_element_wise(found.flat, pa.array([" ", runs.JOINT, ""]).take(pa.array(glue)), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(found.offsets, pa.int32()), pieces), "")


def _neighbours(found: runs._Syllables) -> np.ndarray:
    """The places of words that another word of the same text follows."""
    last = np.zeros(len(found.flat), bool)
    last[found.offsets[1:][np.diff(found.offsets) > 0] - 1] = True
    return np.flatnonzero(~last)


def _by_slices(column: pa.Array, glued) -> pa.Array:
    """``glued(found, first)`` of some texts at a time, ``first`` being the place of the first; null texts stay null."""
    done = []
    for begin in range(0, len(column), runs._SLICE):
        part = column.slice(begin, runs._SLICE)
        done.append(pc.if_else(pc.is_null(part), pa.scalar(None, pa.string()), glued(runs._syllables(part), begin)))
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def _apply_shared(df: DataFrame, known: pa.Table, text: str) -> DataFrame:
    """With the phrases (a, b) in every task, as the distinct words and sorted pairs of their numbers."""
    words = pa.chunked_array([*known["a"].chunks, *known["b"].chunks], pa.string()).unique()
    a, b = (pc.index_in(known[c], value_set=words).to_numpy().astype(np.int64) for c in ("a", "b"))
    shared = df.sparkSession.sparkContext.broadcast((words, np.unique(a * len(words) + b)))

    @F.arrow_udf(T.StringType())
    def joined(column: pa.Array) -> pa.Array:
        words, pairs = shared.value

        def glued(found: runs._Syllables, _: int) -> pa.Array:
            own = pc.fill_null(pc.index_in(found.distinct, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code, at = own[found.codes], _neighbours(found)
            at = at[(code[at] >= 0) & (code[at + 1] >= 0)]
            key = code[at] * len(words) + code[at + 1]
            return _glued(found, at[pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key])

        return _by_slices(column, glued)

    return df.withColumn(text, joined(text))


def _apply_joined(df: DataFrame, phrases: DataFrame, text: str) -> DataFrame:
    """By a join of the pairs that a filter of fixed size lets through, by a row number made here over a written input."""
    spark, columns, key = df.sparkSession, df.columns, "_row"
    pairs = phrases.select(F.concat_ws(" ", "a", "b").alias("pair"), "n_ab")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, factor_a), (b, factor_b) = (runs._codes(batch.column(c)) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(runs._mixed(a * factor_b + b).view(np.int64))], ["h"])

    bits = spark.sparkContext.broadcast(runs._filter_of(spark, phrases.select("a", "b").mapInArrow(hashes, "h long")))
    rows = stored(df.withColumn(key, F.monotonically_increasing_id()), "rows")

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, runs._SLICE):
                part = batch.slice(begin, runs._SLICE)
                found, at = runs._syllables(part.column(1)), None
                at = _neighbours(found)
                value, factor = (x[found.codes] for x in runs._codes(found.distinct))
                at = at[runs._in_filter(value[at] * factor[at + 1] + value[at + 1], bits.value)]
                own = np.searchsorted(found.offsets, at, "right") - 1
                pair = pc.binary_join_element_wise(found.flat.take(pa.array(at)), found.flat.take(pa.array(at + 1)), " ")
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array((at - found.offsets[own]).astype(np.int32)), pair], [key, "at", "pair"])

    found = attach_by_key(rows.select(key, text).mapInArrow(spots, f"{key} long, at int, pair string"), pairs, "pair", "n_ab")
    hits = found.groupBy(key).agg(F.collect_set("at").alias("_at"))

    @F.arrow_udf(T.StringType())
    def joined(column: pa.Array, places: pa.Array) -> pa.Array:
        def glued(found: runs._Syllables, begin: int) -> pa.Array:
            part = places.slice(begin, runs._SLICE)
            size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            return _glued(found, np.repeat(found.offsets[:-1], size) + part.flatten().to_numpy(zero_copy_only=False).astype(np.int64))

        return _by_slices(column, glued)

    return rows.join(hits, key, "left").withColumn(text, joined(text, "_at")).select(*columns)


def apply_phrases(
    df: DataFrame,
    phrases: DataFrame,
    text: str = "cmt",
    literal_limit: int = LITERAL_LIMIT,
    limit: int = PHRASE_LIMIT,
) -> DataFrame:
    """Rewrite ``text`` with the pairs (a, b, n_ab) of ``phrases``.

    The phrase list is measured first: a short one becomes a literal set, one of up to ``limit`` goes to every task, and neither
    needs a shuffle; a longer one is joined. All give the same text.
    """
    known = phrases.select("a", "b").limit(max(literal_limit, limit) + 1).toArrow()
    if not known.num_rows:
        return df.withColumn(text, tx.join_phrases(text, []))
    if known.num_rows <= literal_limit:
        flagged = df.withColumn("_words", tx.tokens(text)).withColumn("_flags", _known_flags("_words", [Row(**r) for r in known.to_pylist()]))
        return flagged.withColumn(text, tx.join_words(F.col("_words"), F.col("_flags"))).select(*df.columns)
    return _apply_shared(df, known, text) if known.num_rows <= limit else _apply_joined(df, phrases, text)
