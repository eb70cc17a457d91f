"""N-gram Jaccard join with signature trees.

A text is the set of its distinct word shingles. Two texts link when
``100 * intersection >= percent * union``. The join is exact (up to collisions of 64-bit hashes):

1. Texts with equal sets form a class, and one text of the class goes on.
2. A set's hash range is cut into K parts, K by the size of the set; each non-empty part gives one
   key, the hash of the shingles in it. Linked sets of sizes a and b differ in at most
   ``s = (a + b)(100 - p) / (100 + p)`` shingles, so at most s of their keys differ. A set with too
   few keys that occur elsewhere has no partner and is out. Of the others, the keys found nowhere
   else come first in a common order, then the shared ones by value: linked sets have one of their
   first s + 1 keys in common. Such keys join the sets into trees.
3. Each tree is sorted by size and first shingle; nodes of eight hold the OR of their token bitmaps,
   their size range and the largest number of shingles that share a bit. Two nodes hold no linked
   pair if their sizes exclude it, or if the common bits plus that number stay below the least
   overlap their sizes ask for. The tree is traversed against itself; pairs of sets that survive are
   counted exactly, unless both are known to be connected.

A tree above ``BLOCK`` sets is cut into blocks by size band; blocks are traversed alone, then against
one neighbour, then, as far as they are not yet one component, pair by pair, so a large group of
near copies costs a linear number of tasks and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.graph import components
from reviewlens.llm.words import U64, blocks, mix, shingle_sets
from reviewlens.session import cut_lineage, scratch_path

PERCENT, WORDS = 80, 5
BLOCK = 512
LEAF = 8
BITMAP_BITS = 4096
# Sets up to this size use every shingle as a key.
SMALL = 16


def most_different(size: int, percent: int) -> int:
    """Most shingles by which a set of ``size`` and a linked one can differ."""
    return (size + 100 * size // percent) * (100 - percent) // (100 + percent)


def parts(size: int, percent: int) -> int:
    """Bits of the hash that name a set's parts; 64: every shingle is one."""
    if size <= SMALL:
        return 64
    return max(6, int(np.ceil(np.log2(1.15 * (most_different(size, percent) + 1)))))


def keys_of(shingles: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(level, keys a partner's set must share, keys) on the level of the set and of larger partners."""
    size = len(shingles)
    slack = most_different(size, percent)
    if not slack:
        return
    for level in {parts(size, percent), parts(100 * size // percent, percent)}:
        if level == 64:
            keys = mix(shingles + U64(64))
        else:
            part = shingles >> U64(64 - level)
            starts = np.flatnonzero(np.diff(part, prepend=part[0] ^ U64(1)))
            keys = mix(np.add.reduceat(mix(shingles), starts) + part[starts] * U64(0x9E3779B97F4A7C15) + U64(level))
        yield level, len(keys) - slack, keys


def set_hash(shingles: np.ndarray) -> int:
    return int(mix(mix(shingles).sum(keepdims=True, dtype=U64) + U64(len(shingles)))[0].astype(np.int64)) if len(shingles) else 0


def _signed(values) -> pa.Array:
    return pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, sig) per row; sets with equal sig are equal."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for _, _, w in blocks(batch.column("text")):
                rows += [(len(s), set_hash(s)) for s in shingle_sets(w, words)]
            n, sig = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["doc_id", "n_shingles", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, sig long")


def _shared_in_batch(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, sig, tag, shared): a row for each set and key. Keys that several sets of a batch have are
    marked as shared; of those, one set per batch stays unmarked as well, to be met by other batches."""

    def run(batches):
        for batch in batches:
            keys, sigs, tags = [], [], []
            for _, _, w in blocks(batch.column("text")):
                for s in shingle_sets(w, words):
                    sig = set_hash(s)
                    for level, need, k in keys_of(s, percent):
                        keys.append(k)
                        sigs.append(np.full(len(k), sig, np.int64))
                        tags.append(np.full(len(k), level << 32 | max(0, need), np.int64))
            if not keys:
                continue
            key, sig, tag = np.concatenate(keys).view(np.int64), np.concatenate(sigs), np.concatenate(tags)
            order = np.lexsort((sig, key))
            key, sig, tag = key[order], sig[order], tag[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= sig[1:] != sig[:-1]
            key, sig, tag, new_key = key[new], sig[new], tag[new], new_key[new]
            group = np.cumsum(new_key) - 1
            many = np.bincount(group)[group] > 1
            for at, shared in ((new_key, False), (many, True)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at]), pa.array(sig[at]), pa.array(tag[at]), pa.array(np.full(at.sum(), shared))],
                    ["key", "sig", "tag", "shared"],
                )

    return docs.select("text").mapInArrow(run, "key long, sig long, tag long, shared boolean")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """(sig, tag, key) of keys that at least two different sets have, from sorted partitions."""

    def run(batches):
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sig, tag, shared = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sig", "tag", "shared"))
            if held:
                key, sig, tag, shared = (np.concatenate([[h], x]) for h, x in zip(held, (key, sig, tag, shared), strict=True))
            same_as_next = np.zeros(len(key), bool)
            same_as_next[:-1] = (key[1:] == key[:-1]) & (sig[1:] != sig[:-1])
            out = shared | same_as_next
            out[1:] |= same_as_next[:-1]
            # The last row meets the next batch; given out twice does no harm.
            held = (key[-1], sig[-1], tag[-1], shared[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (sig, tag, key)], ["sig", "tag", "key"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "sig")
    return ordered.mapInArrow(run, "sig long, tag long, key long")


def candidate_trees(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, tree): sets that share one of their first keys, directly or through others."""
    shared = _shared_keys(_shared_in_batch(docs, words, percent))
    need = F.col("tag").bitwiseAND(0xFFFFFFFF)
    kept = shared.groupBy("sig", "tag").agg(F.sort_array(F.collect_set("key")).alias("keys")).filter(F.size("keys") >= need)
    first = F.slice("keys", F.lit(1), F.greatest(F.lit(1), F.size("keys") - need + 1).cast("int"))
    by_key = kept.select("sig", first.alias("keys")).select("sig", F.explode("keys").alias("key"))
    path = scratch_path(docs.sparkSession, "jaccard-keys")
    by_key.write.parquet(path)
    by_key = docs.sparkSession.read.parquet(path)
    roots = by_key.groupBy("key").agg(F.min("sig").alias("root"), F.max("sig").alias("last")).filter("root < last")
    edges = by_key.join(roots, "key").select(F.col("sig").alias("a"), F.col("root").alias("b"))
    return components(edges).select(F.col("node").alias("sig"), F.col("component").alias("tree"))


# --- one tree --------------------------------------------------------------------------------


class _Known:
    """Components found so far."""

    def __init__(self, labels: np.ndarray) -> None:
        _, first, where = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[where].tolist()

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)


class SignatureTree:
    """Bitmaps, size ranges and collision counts of sets in order, leaves first."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        bits = np.zeros((len(sets), BITMAP_BITS // 64), U64)
        for row, s in zip(bits, sets, strict=True):
            np.bitwise_or.at(row, (s >> U64(58)).astype(np.int64) % (BITMAP_BITS // 64), U64(1) << ((s >> U64(46)) & U64(63)))
        size = np.array([len(s) for s in sets])
        hidden = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, hidden)]
        while len(bits) > 1:
            at = np.arange(0, len(bits), LEAF)
            bits = np.bitwise_or.reduceat(bits, at)
            _, low, high, hidden = self.levels[-1]
            self.levels.append((bits, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))


def _survivors(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs can hold a linked pair: sizes fit and the largest possible overlap reaches the least needed."""
    bits_a, low_a, high_a, hidden_a = (v[x] for v in a)
    bits_b, low_b, high_b, hidden_b = (v[y] for v in b)
    fits = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    overlap = np.bitwise_count(bits_a & bits_b).sum(1, dtype=np.int64) + np.minimum(hidden_a, hidden_b)
    return fits & ((100 + percent) * overlap >= percent * (low_a + low_b))


def _pairs(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets left by the traversal, in pieces; of a tree with itself, each pair once."""
    top = max(len(a.levels), len(b.levels)) - 1
    for tree in (a, b):
        while len(tree.levels) <= top:
            tree.levels.append(tree.levels[-1])
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, x, y = stack.pop()
        if len(x) > 16_384:
            half = len(x) // 2
            stack += [(level, x[half:], y[half:]), (level, x[:half], y[:half])]
            continue
        ok = _survivors(a.levels[level], b.levels[level], x, y, percent)
        x, y = x[ok], y[ok]
        if not level:
            if len(x):
                yield x, y
            continue
        children = []
        for tree, nodes in ((a, x), (b, y)):
            below = len(tree.levels[level - 1][0])
            if below == len(tree.levels[level][0]):  # padding above a lower tree
                children.append((nodes[:, None], np.ones((len(nodes), 1), bool)))
            else:
                kids = nodes[:, None] * LEAF + np.arange(LEAF)
                children.append((kids, kids < below))
        (cx, okx), (cy, oky) = children
        pair = okx[:, :, None] & oky[:, None, :]
        cx, cy = np.broadcast_to(cx[:, :, None], pair.shape)[pair], np.broadcast_to(cy[:, None, :], pair.shape)[pair]
        if a is b:
            cx, cy = cx[(keep := (cx < cy) if level == 1 else (cx <= cy))], cy[keep]
        stack.append((level - 1, cx, cy))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def connect(sets: list[np.ndarray], side: np.ndarray, labels: np.ndarray, percent: int) -> list[int]:
    """For every set the first set known to be connected with it: by equal labels, by links within the sets if
    all have side 0, else by links between the sides."""
    order = sorted(range(len(sets)), key=lambda i: (side[i], len(sets[i]), int(sets[i][0])))
    known = _Known(labels)
    groups = [[i for i in order if side[i] == k] for k in (0, 1)]
    left, right = (0, 1) if side.any() else (0, 0)
    if groups[left] and groups[right]:
        trees = [SignatureTree([sets[i] for i in g]) if g else None for g in groups]
        for xs, ys in _pairs(trees[left], trees[right], percent):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                i, j = groups[left][x], groups[right][y]
                p, q = known.top(i), known.top(j)
                if p != q and linked(sets[i], sets[j], percent):
                    known.join(p, q)
    return [known.top(i) for i in range(len(sets))]


# --- the join --------------------------------------------------------------------------------


def _connected(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, label, root) of the sets of every pair of blocks (tree, i, j); rows: tree, i, j, side, sig, label,
    text. Sets with equal root are connected."""

    def run(table: pa.Table) -> pa.Table:
        sets = [s for _, _, w in blocks(table.column("text")) for s in shingle_sets(w, words)]
        sig, side, label = (table.column(c).to_numpy() for c in ("sig", "side", "label"))
        # Where an id repeats, its other texts came along.
        own = {(x, k): i for i, (x, k) in enumerate(zip(sig.tolist(), side.tolist(), strict=True)) if set_hash(sets[i]) == x}
        at = np.array(sorted(own.values()), np.int64)
        sig, label = sig[at], label[at]
        root = label[np.array(connect([sets[i] for i in at], side[at], label, percent), np.int64)]
        return pa.table({"sig": pa.array(sig), "label": pa.array(label), "root": pa.array(root)})

    columns = ["tree", "i", "j", "side", "sig", "label", "text"]
    return rows.select(columns).groupBy("tree", "i", "j").applyInArrow(run, "sig long, label long, root long")


def _across_blocks(labels: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """``labels`` (sig, label) after the blocks of large trees met: first each with the first one of its size band
    and of the band below, then all that are not yet one component. members: tree, band, block, sig, text."""
    for step in ("neighbour", "rest"):
        labelled = cut_lineage(members.join(labels, "sig"))
        state = labelled.groupBy("tree", "band", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        state = cut_lineage(state)
        if step == "neighbour":
            first = state.groupBy("tree", "band").agg(F.min("block").alias("j"))
            near = first.withColumn("band", F.col("band") + 1).union(first)
        else:
            near = state.select("tree", "band", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
            near = near.union(near.withColumn("band", F.col("band") + 1))
        pairs = state.withColumnRenamed("block", "i").join(near, ["tree", "band"]).filter("i <> j")
        if step == "rest":
            pairs = pairs.filter(~((F.col("low") == F.col("high")) & (F.col("low_j") == F.col("high_j")) & (F.col("low") == F.col("low_j"))))
        pairs = cut_lineage(pairs.select("tree", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())
        if pairs.isEmpty():
            continue
        sides = pairs.select("tree", "i", "j", F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))).alias("s"))
        rows = sides.select("tree", "i", "j", "s.*").join(labelled, ["tree", "block"])
        edges = _connected(rows, words, percent).filter("label <> root").select(F.col("label").alias("a"), F.col("root").alias("b"))
        found = components(edges.distinct()).select(F.col("node").alias("label"), "component")
        labels = labels.join(found, "label", "left").select("sig", F.coalesce("component", "label").alias("label"))
    return labels


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable by links, the row's own included. A text that is
    null, empty or without words has no shingles and is linked with nothing. Rows with equal sets are
    linked, so repeated rows and copies share a component; a null doc_id counts last. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    signed = cut_lineage(signatures(docs, words))
    sets = cut_lineage(
        signed.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    )
    # Of each class, the text of its smallest doc_id stands for all (where ids repeat, the set decides).
    trees = candidate_trees(docs, words, percent).join(sets, "sig")
    band = F.floor(F.log("n") / np.log(100 / percent)).cast("int")
    trees = cut_lineage(trees.withColumn("band", band))
    total = trees.groupBy("tree").agg(F.count("*").alias("total"))
    counts = trees.groupBy("tree", "band").agg(F.count("*").alias("held"))
    split = F.ceil(F.col("held") / block).cast("int")
    placed = (
        trees.join(total, "tree").join(counts, ["tree", "band"])
        .withColumn("large", F.col("total") > block)
        .select(
            "tree", "sig", "doc_id", "large", F.when(F.col("large"), F.col("band")).otherwise(0).alias("band"),
            F.when(F.col("large"), F.pmod(F.xxhash64("sig"), split)).otherwise(0).cast("int").alias("part"),
        )
    )
    path = scratch_path(spark, "jaccard-members")
    (
        placed.join(docs.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
        .select("tree", "sig", "large", "band", F.concat_ws(".", "band", "part").alias("block"), "text")
        .write.parquet(path)
    )
    members = spark.read.parquet(path)
    alone = members.withColumns({"i": F.col("block"), "j": F.col("block"), "side": F.lit(0), "label": F.col("sig")})
    labels = cut_lineage(_connected(alone, words, percent).select("sig", F.col("root").alias("label")))
    large = members.filter("large")
    if not large.isEmpty():
        labels = cut_lineage(_across_blocks(labels, large, words, percent))
    found = labels.withColumnRenamed("label", "component")
    of_set = sets.select("sig", "doc_id").join(found, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    lowest = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of_set.join(lowest, "component").select("sig", "component_id")
    own = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.union(signed.filter("n_shingles > 0").join(named, "sig").select("doc_id", "n_shingles", "component_id"))
