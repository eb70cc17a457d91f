"""Row-level operators: cleaning a table, row index, split, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.functions import labels as lb
from reviewlens.functions import text as tx
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS, SENTIMENTS
from reviewlens.session import cut_lineage


def clean_reviews(
    df: DataFrame,
    mode: str = "advanced",
    label_mode: str = "numeric",
    acronyms: Sequence[tuple[str, str]] = (),
    phrases: Sequence[tuple[str, str]] | None = None,
    missing_text: str = "",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Clean ``cmt``, parse the seven label columns and build ``label``."""
    return df.select(
        *keep,
        tx.clean_text("cmt", mode, acronyms, phrases, missing_text).alias("cmt"),
        *[lb.parse_label(a, label_mode).alias(a) for a in ASPECTS],
    ).withColumn("label", lb.label_array())


def clean_sentences(
    df: DataFrame,
    mode: str = "advanced",
    acronyms: Sequence[tuple[str, str]] = (),
    phrases: Sequence[tuple[str, str]] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    return df.select(*keep, tx.clean_text("cmt", mode, acronyms, phrases).alias("cmt"))


def with_row_index(
    df: DataFrame, order_by: Sequence[str] = (), name: str = "ColumnIndex", stable: bool = False
) -> DataFrame:
    """Consecutive index from 0, in input order or in the order of ``order_by``.

    Rows get their place in the partition, plus the number of rows in earlier partitions. Only
    the per-partition counts are windowed, one row per partition; the data is never put into one
    task. Two passes must see the same partitions, so the input is checkpointed first; a plain
    file scan may skip that with ``stable=True``.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    if order_by or not stable:
        df = cut_lineage(df)
    spot = F.monotonically_increasing_id()
    placed = df.withColumn("_spot", spot).withColumn("_part", F.shiftright("_spot", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # One row per input partition, so the broadcast is bounded by the number of tasks.
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_before") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))).alias(name),
    )


def hash_bucket(key: str, seed: int, buckets: int) -> Column:
    """Bucket of a key by md5, the same on every layout, engine and run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def split_reviews(
    df: DataFrame,
    train_ratio: float = 0.8,
    seed: int = 50,
    key: str | None = "doc_id",
    method: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows.

    ``hash`` looks only at ``key``: both sides are plain filters, need no shuffle, and stay
    disjoint however often the input is recomputed. ``random`` is Spark's sampler, whose result
    depends on the partitioning. ``exact`` gives the training side exactly round(train_ratio * rows) rows, the same
    ones on any partitioning, see ``exact_split``.
    """
    if method == "exact":
        return exact_split(df, train_ratio, seed)
    if method == "random":
        train, test = df.randomSplit([train_ratio, 1 - train_ratio], seed)
        return train, test
    if method != "hash" or key is None:
        raise ValueError("method must be 'hash' (with a key), 'random' or 'exact'")
    inside = hash_bucket(key, seed, 1000) < round(train_ratio * 1000)
    return df.filter(inside), df.filter(~inside)


def exact_split(df: DataFrame, train_ratio: float = 0.8, seed: int = 50, bits: int = 12) -> tuple[DataFrame, DataFrame]:
    """Two sides, the first of exactly round(train_ratio * rows) rows, chosen by a hash of the whole row.

    The hash below which just that many rows lie is found by histograms: each pass counts the rows in 2**bits equal ranges
    of the hashes still in question, and goes on within the one where the wanted number falls. So a few counts reach the
    driver and rows are never sorted. Of equal rows at that hash as many as are wanted are taken; which of them does not matter.
    """
    hashed = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), *df.columns), F.lit(1))
    marked = cut_lineage(df.select(F.struct(*df.columns).alias("row"), hashed.alias("h")))
    wanted, low, width = round(train_ratio * marked.count()), 0, 63
    while width > 0 and wanted > 0:
        step = min(bits, width)
        width -= step
        inside = marked.filter((F.col("h") >= low) & (F.col("h") <= low + (1 << (width + step)) - 1))
        counts = dict(inside.groupBy(F.shiftright(F.col("h") - low, width)).count().collect())
        for k in sorted(counts):
            if wanted <= counts[k]:
                low += k << width
                break
            wanted -= counts[k]
    ties = with_row_index(marked.filter(F.col("h") == low), name="tie", stable=True)
    first = marked.filter(F.col("h") < low).unionByName(ties.filter(F.col("tie") < wanted).drop("tie"))
    second = marked.filter(F.col("h") > low).unionByName(ties.filter(F.col("tie") >= wanted).drop("tie"))
    return first.select("row.*"), second.select("row.*")


def prediction_columns(
    df: DataFrame, c: str = "prediction", names: Sequence[str] = ASPECTS, keep: Sequence[str] = ()
) -> DataFrame:
    """One column per aspect from the prediction array."""
    return df.select(*keep, *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate(names)])


def sentence_result(df: DataFrame, c: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    """Snapped predictions as text columns, absent aspects blank."""
    snapped = df.withColumn(c, lb.snap_predictions(c))
    wide = prediction_columns(snapped, c, keep=keep)
    return wide.select(*keep, *[lb.blank_absent(a).alias(a) for a in ASPECTS])


def mentioned_aspects(
    df: DataFrame, ids: Sequence[str], aspects: Sequence[str] = ANNOTATION_ASPECTS
) -> DataFrame:
    """(id, aspect, sentiment) for every code that is not 0."""
    return (
        df.unpivot(list(ids), list(aspects), "aspect", "code")
        .filter(F.col("code") != 0)
        .select(*ids, "aspect", lb.code_to_sentiment("code").alias("sentiment"))
    )


def with_dne(df: DataFrame, aspects: Sequence[str] = ANNOTATION_ASPECTS) -> DataFrame:
    return df.fillna(SENTIMENTS[0], list(aspects))
