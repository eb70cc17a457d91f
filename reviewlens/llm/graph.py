"""Connected components of an edge table with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reviewlens.session import cut_lineage


def _minima(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of every node, the node itself included."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _joined_to_minimum(pairs: DataFrame, keep) -> DataFrame:
    """For every (a, b) with ``keep``: (b, smallest neighbour of a). A hot ``a`` is one row of the
    minima; the pairs' side of that join can be split by adaptive execution."""
    minima = _minima(pairs)
    return pairs.filter(keep).join(minima, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: comparable ids); component is the smallest id.

    Alternating large-star and small-star steps: each round hangs every node under the smallest
    node it knows, so long chains shrink by a constant factor and a star is final. Rows per
    round never exceed edges and nodes. Each round is one reliable checkpoint. Null ends and loops
    are ignored; an empty table gives an empty one.
    """
    pairs = cut_lineage(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _joined_to_minimum(both, F.col("b") > F.col("a")).filter(F.col("a") != F.col("b"))
        # Small star: each node's smaller neighbours, and the node itself, move under the smallest of them.
        low = _minima(large)
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct()
        )
        state = Observation()
        pairs = cut_lineage(small.observe(state, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
        now = state.get
        if now == seen or not now["n"]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
