"""Word vectors from co-occurrence counts and a randomised decomposition.

Counts of words near each other become positive pointwise mutual information, a sparse symmetric matrix kept as rows
(a, b, value). Its leading subspace is found by repeated multiplication with a narrow matrix: every product is a join
and a sum, and only products of two narrow matrices, of a size fixed by the vectors' length, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.counting import pair_counts
from reviewlens.operators.lookup import BROADCAST_BYTES, attach_by_key
from reviewlens.operators.terms import spaced
from reviewlens.session import cut_lineage, stored

WINDOW = 5
MORE = 8  # columns beyond the wanted ones
ROUNDS = 4


def cooccurrences(df: DataFrame, text: str = "cmt", window: int = WINDOW, least: int = 5) -> DataFrame:
    """(a, b, n, n_a, n_b): how often b stands within ``window`` words of a, for words seen ``least`` times, both ways round.

    Words and pairs are counted in one aggregate, combined in every task.
    """
    counts = stored(pair_counts(df, spaced(text), range(1, window + 1), ordered=False, empty=True), "pairs")
    single = counts.filter(F.col("b").isNull() & (F.col("n") >= least)).select(F.col("a").alias("w"), F.col("n").alias("seen"))
    once = counts.filter(F.col("b").isNotNull())
    # Two equal words are one another's neighbours twice.
    both = once.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))).unionByName(
        once.filter(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    )
    left = attach_by_key(both, single.select(F.col("w").alias("a"), F.col("seen").alias("n_a")), "a", "n_a")
    full = attach_by_key(left, single.select(F.col("w").alias("b"), F.col("seen").alias("n_b")), "b", "n_b")
    return full.select("a", "b", "n", "n_a", "n_b")


def information(counts: DataFrame) -> DataFrame:
    """(a, b, value): ln(n_ab N / (n_a n_b)) where positive, n_a and n_b being row sums of n and N their sum."""
    counts = counts.select("a", "b", "n")
    sums = cut_lineage(counts.groupBy("a").agg(F.sum("n").alias("n_a")))
    total = sums.agg(F.sum("n_a").cast("double").alias("n")).collect()[0]["n"] or 1.0
    left = attach_by_key(counts, sums, "a", "n_a")
    full = attach_by_key(left, sums.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b", "n_b")
    value = F.log(F.col("n") * total / (F.col("n_a").cast("double") * F.col("n_b")))
    return full.select("a", "b", value.alias("value")).filter(F.col("value") > 0)


def _product(entries: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """(term, weight, vector): the matrix times a narrow one, checkpointed."""
    right = narrow.select(F.col("term").alias("b"), "weight", "vector")
    joined = attach_by_key(entries, right, "b", "weight", BROADCAST_BYTES // (1 + width // 8))
    sums = joined.groupBy("a").agg(*[F.sum(F.col("value") * F.get("vector", F.lit(r))).alias(f"c{r}") for r in range(width)])
    own = sums.select(F.col("a").alias("term"), F.array(*[F.col(f"c{r}") for r in range(width)]).alias("vector"))
    return cut_lineage(own.join(narrow.select("term", "weight"), "term"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _inner(left: DataFrame, width: int, other: str = "vector") -> np.ndarray:
    """The sum over rows of vector' other, ``width`` by ``width``; each task adds up its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            total += _matrix(batch.column("vector"), width).T @ _matrix(batch.column(other), width)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["r", "row"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"r": table["r"].slice(0, 1), "row": pa.array([_matrix(table["row"], width).sum(0)], pa.list_(pa.float64()))})

    rows = left.mapInArrow(run, "r int, row array<double>").groupBy("r").applyInArrow(add, "r int, row array<double>").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["r"])])


def _times(narrow: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every row's vector times a small matrix."""

    @F.arrow_udf("array<double>")
    def turned(column: pa.Array) -> pa.Array:
        return pa.array(list(_matrix(column, matrix.shape[0]) @ matrix), pa.list_(pa.float64()))

    return narrow.withColumn("vector", turned("vector"))


def _orthonormal(narrow: DataFrame, width: int) -> DataFrame:
    """The same columns' span with orthonormal columns, dropping directions that vanish."""
    for _ in range(2):  # once more for what rounding leaves
        values, turn = np.linalg.eigh(_inner(narrow, width))
        scale = np.where(values > max(values.max(), 0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        narrow = cut_lineage(_times(narrow, turn * scale))
    return narrow


def leading(entries: DataFrame, size: int, seed: int = 42, rounds: int = ROUNDS, more: int = MORE) -> tuple[DataFrame, np.ndarray]:
    """((term, weight, vector), values): orthonormal leading eigenvectors, by absolute value, of a symmetric matrix (a, b, value).

    weight is the number of a term's entries. A matrix with fewer than ``size`` terms gives zero columns. The sign of
    every column makes its sum positive.
    """
    width = size + more
    entries = stored(entries, "entries")
    sign = F.array(*[F.lit(2.0) * F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "a"), F.lit(2)) - 1 for r in range(width)])
    narrow = entries.groupBy("a").agg(F.count(F.lit(1)).alias("weight")).select(F.col("a").alias("term"), "weight", sign.alias("vector"))
    narrow = cut_lineage(narrow)
    for _ in range(rounds):
        narrow = _orthonormal(_product(entries, narrow, width), width)
    image = _product(entries, narrow, width).select("term", F.col("vector").alias("image"))
    small = _inner(narrow.join(image, "term"), width, "image")
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:size]
    best = cut_lineage(_times(narrow, turn[:, order]))
    sums = best.agg(*[F.sum(F.get("vector", F.lit(r))).alias(f"s{r}") for r in range(size)]).collect()[0]
    signs = np.array([1.0 if (x or 0.0) >= 0 else -1.0 for x in sums])
    return _times(best, np.diag(signs)), values[order]


def word_vectors(df: DataFrame, size: int, text: str = "cmt", window: int = WINDOW, least: int = 5, seed: int = 42) -> DataFrame:
    """(term, n, vector) of words seen ``least`` times that have a neighbour; eigenvectors times the root of their value.

    n is the word's occurrences with neighbours, for joins that frequent words must not stall.
    """
    counts = stored(cooccurrences(df, text, window, least), "cooccurrences")
    found, values = leading(information(counts), size, seed)
    seen = counts.groupBy("a").agg(F.max("n_a").alias("n"))
    scaled = _times(found, np.diag(np.sqrt(np.abs(values))))
    return scaled.join(seen.withColumnRenamed("a", "term"), "term").select("term", "n", "vector")
