"""Spelling variants: frequent words, the words one edit away, and the form each variant goes back to.

Words one inserted, deleted or replaced code point apart are found by dense tiles: words stand as rows of padded
code-point matrices, once aligned left and once right, blocks of rows are compared with each other, and a pair is near if its common
prefix and common suffix together reach the longer length minus one.

Which blocks meet is bounded by group. A group is (shorter length, known prefix, known suffix): of the region between
them, either the first or the last half (rounded down) is common to both words of a near pair, so a group too large for
tiles becomes two kinds of smaller groups, with a longer prefix or a longer suffix. A pair whose prefix and suffix
would both do is reported by prefix only, so every pair comes out once and nothing is made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import scratch_path

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_LENGTH, LEAST_COUNT = 6, 5
TIMES = 5  # a form occurs so many times as often
GROUP = 2048  # words that tiles compare at once; larger groups are split
TILE = 256
WIDE = 1 << 20  # cells of a block's matrix
HOT = 10_000  # groups with more than this share of all rows are split without a shuffle

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# --- words -----------------------------------------------------------------------------------


def with_noise(doc_id: Column, run: Column, every: int) -> Column:
    """The run, less one code point in about one of ``every`` pairs of document and run, fixed by their checksum."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % every == 0, short).otherwise(run)


def words(docs: DataFrame, noise: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of whole texts: maximal runs of Latin letters, A-Z lower-cased, long and frequent enough.

    ``noise`` drops letters by ``with_noise`` first. Counts are combined in every task, so a word of all rows is one row a task.
    """
    lowered = F.translate("text", _UPPER, _UPPER.lower())
    # A run that is too short stays so; the whole of a longer one is matched.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("word"))
    if noise is not None:
        runs = runs.select(with_noise(F.col("doc_id"), F.col("word"), noise).alias("word")).filter(F.char_length("word") >= least_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# --- tiles -----------------------------------------------------------------------------------


def _matrices(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left, aligned right (from the end) and lengths; ``pad`` fills the rest."""
    texts = column.to_pylist()
    length = np.array([len(t) for t in texts], np.int64)
    width = int(length.max(initial=1))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(texts)), length)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    left = np.full((len(texts), width), pad, np.uint32)
    right = left.copy()
    left[row, at] = flat
    right[row, length[row] - 1 - at] = flat
    return left, right, length


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first columns each row of ``a`` shares with each row of ``b``."""
    total = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones((len(a), len(b)), bool)
    for k in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        total += alive
    return total


# Pads differ, so that two pads are never a common code point.
_PADS = 0x110000, 0x110001


def near_in_tile(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are one edit apart, and the common prefix of every pair. No word occurs on both sides but as itself."""
    a, b = _matrices(left, _PADS[0]), _matrices(right, _PADS[1])
    prefix = _common(a[0], b[0])
    longer = np.maximum(a[2][:, None], b[2][None, :])
    shorter = np.minimum(a[2][:, None], b[2][None, :])
    near = (prefix + _common(a[1], b[1]) >= longer - 1) & (longer - shorter <= 1) & ~((prefix == longer) & (longer == shorter))
    return near, prefix


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways round, of rows sorted by group. Of earlier rows only those whose group goes on are kept."""
    open_blocks: list[pa.Table] = []
    waiting: pa.Table | None = None

    def pairs(x: pa.Table, y: pa.Table, same: bool) -> pa.RecordBatch:
        near, prefix = near_in_tile(x["word"], y["word"])
        if same:
            near &= np.triu(np.ones(near.shape, bool), 1)
        at, to = np.nonzero(near)
        group = x["group"].to_numpy()[at] == y["group"].to_numpy()[to]
        short = np.minimum(x["length"].to_numpy()[at], y["length"].to_numpy()[to]) == x["m"].to_numpy()[at]
        keep = group & short & (prefix[at, to] < x["below"].to_numpy()[at])
        i, j = pa.array(at[keep]), pa.array(to[keep])
        one = [x["word"].take(i), x["n"].take(i)], [y["word"].take(j), y["n"].take(j)]
        columns = [pa.concat_arrays([c.combine_chunks(), d.combine_chunks()]) for c, d in zip(one[0] + one[1], one[1] + one[0], strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        first, last = table["group"][0].as_py(), table["group"][-1].as_py()
        open_blocks[:] = [b for b in open_blocks if b["group"][-1].as_py() == first]
        for earlier in open_blocks:
            yield pairs(earlier, table, False)
        yield pairs(table, table, True)
        if open_blocks and open_blocks[-1]["group"][-1].as_py() != last:
            open_blocks.clear()
        open_blocks.append(table)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        while waiting.num_rows:
            longest = pc.max(waiting["length"]).as_py()
            rows = max(1, min(tile, WIDE // longest))
            if waiting.num_rows <= rows:
                break
            yield from block(waiting.slice(0, rows).combine_chunks())
            waiting = waiting.slice(rows)
    if waiting is not None and waiting.num_rows:
        yield from block(waiting.combine_chunks())


def _group(m: Column, prefix: Column, suffix: Column, below: Column, word: Column) -> Column:
    return F.xxhash64(m, prefix, suffix, below, F.substring(word, F.lit(1), prefix), F.right(word, suffix))


def near_pairs(table: DataFrame, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """(word, n, near, near_n), both ways round, of all words of ``table`` (word, n) one edit apart; each pair once each way.

    Words are distinct and not null. A group of more than ``group`` words is split until no region is left to halve; what then is
    together differs in one or two given places only, so it is no larger than the alphabet allows.
    """
    spark = table.sparkSession
    length = F.char_length("word")
    # A word is the shorter of a pair, or the longer by one.
    role = F.explode(F.array(length, length - 1)).alias("m")
    words_ = table.filter(length > 0).select("word", "n", role).filter(F.col("m") >= 1)
    no_bound = F.lit((1 << 31) - 1)
    rows = _split(words_.select("m", F.lit(0).alias("prefix"), F.lit(0).alias("suffix"), no_bound.alias("below"), "word", "n"))
    found = None
    while True:
        key = _group(*(F.col(c) for c in ("m", "prefix", "suffix", "below", "word")))
        path = scratch_path(spark, "spelling")
        rows.withColumn("group", key).write.parquet(path)
        rows = spark.read.parquet(path)
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("m") - F.col("prefix") - F.col("suffix")).alias("region"))
        sizes = sizes.filter(F.col("size") > 1).withColumn("large", (F.col("size") > group) & (F.col("region") > 1))
        total = rows.count()
        # Fewer than HOT groups hold more than that share of the rows; theirs never meet in a task.
        hot = sizes.filter(F.col("large") & (F.col("size") * HOT > total)).select("group")
        rest = rows.join(F.broadcast(hot), "group", "left_anti").join(sizes.select("group", "large"), "group")
        dense = rest.filter(~F.col("large")).select("group", "m", "below", length.cast("long").alias("length"), "word", "n")
        placed = dense.repartition("group").sortWithinPartitions("m", "group", "word")
        tiles = placed.mapInArrow(lambda batches: _tiles(batches, tile), "word string, n long, near string, near_n long")
        found = tiles if found is None else found.unionByName(tiles)
        if not sizes.filter("large").limit(1).count():
            return found
        large = rows.join(F.broadcast(hot), "group", "left_semi").unionByName(rest.filter("large").drop("large"))
        rows = _split(large.drop("group"))


def _split(rows: DataFrame) -> DataFrame:
    """Every group as two: with a prefix, or else a suffix, longer by half of the region."""
    half = F.expr("(m - prefix - suffix) div 2").cast("int")
    ends = F.array(
        F.struct((F.col("prefix") + half).alias("prefix"), F.col("suffix").alias("suffix"), F.col("below").alias("below")),
        F.struct(
            F.col("prefix").alias("prefix"), (F.col("suffix") + half).alias("suffix"),
            F.least("below", F.col("prefix") + half).alias("below"),
        ),
    )
    split = rows.select("m", "word", "n", F.explode(ends).alias("end")).select("m", "end.*", "word", "n")
    # Pairs of a group all share the prefix, so none is left below it.
    return split.filter(F.col("prefix") < F.col("below")).select("m", "prefix", "suffix", "below", "word", "n")


# --- forms -----------------------------------------------------------------------------------


def variants(table: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """Every word of ``table`` (word, n) with form, root, n_near and form_n.

    form is the near word with the largest n (of equals the first in code-point order), if that is at least ``times`` the word's;
    root is where forms lead to, the word itself without one. n grows by ``times`` with every step, so 64-bit counts
    allow 27 steps for ``times`` = 5 and a few doublings reach the end of all chains. An empty table gives an empty one.
    """
    spark = table.sparkSession
    path = scratch_path(spark, "words")
    table.select("word", "n").write.parquet(path)
    table = spark.read.parquet(path)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word")))
    near = near_pairs(table, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = table.join(near, "word", "left")
    enough = -F.col("best.less") >= times * F.col("n")
    path = scratch_path(spark, "forms")
    joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    ).write.parquet(path)
    forms = spark.read.parquet(path)
    # Pointers double: word -> root over 1, 2, 4 ... steps. Only words with a form take part.
    step = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        after = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        path = scratch_path(spark, "roots")
        step.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).write.parquet(path)
        moved = spark.read.parquet(path)
        step = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            break
    return forms.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
