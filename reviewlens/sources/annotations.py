"""Annotation files: CSV tables and the four-line text format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.functions.labels import LABEL_PAIR, decode_label_text, encode_label_text
from reviewlens.operators.rows import with_row_index
from reviewlens.schema import ANNOTATION_ASPECTS
from reviewlens.sources.reviews import read_csv


def read_annotations_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``id, review`` and seven aspect columns; a two-column file gets empty ones.

    An index column written by ``write_annotations_csv`` is dropped.
    """
    df = read_csv(spark, path, multi_line)
    names = [c for c in df.columns if c and not c.startswith("_c")]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    if len(names) == 2:
        return df.toDF("id", "review").select(
            "id", "review", *[F.lit(None).cast("string").alias(a) for a in ANNOTATION_ASPECTS]
        )
    if len(names) != 2 + len(ANNOTATION_ASPECTS):
        raise ValueError(f"expected 2 or {2 + len(ANNOTATION_ASPECTS)} columns, found {names}")
    return df.toDF("id", "review", *ANNOTATION_ASPECTS)


def write_annotations_csv(
    df: DataFrame, path: str, order_by: Sequence[str] = ("id",), bom: bool = True
) -> None:
    """CSV with a leading row index and, as some spreadsheet programs want, a byte order mark.

    The header cell of the index column is empty but for the mark, so every part file starts
    with it.
    """
    indexed = with_row_index(df, order_by=order_by, name="_index")
    out = indexed.select(F.col("_index").alias("﻿" if bom else "_index"), *df.columns)
    (
        out.write.option("header", True).option("escape", '"').option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with lines counted from 0 over a file, or over a folder's files by name.

    Files are read in splits. A line's number is its place in the split plus the lines in earlier
    splits; only the counts are windowed, one row per split, and no line is moved for it.
    """
    # Only \n ends a line, so that a \r stays part of the text.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # Spark numbers part files with at least five digits, so past 99,999 names do not sort.
    part = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    earlier = W.orderBy(part, "file", "split").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    # One row per split: the broadcast is bounded by the number of tasks, and no line is shuffled for it.
    return lines.join(F.broadcast(offsets), ["file", "split"]).select(
        (F.col("at") + F.col("shift")).alias("line"), "value"
    )


def read_annotations_txt(
    spark: SparkSession, paths: Mapping[str, str], offset: int = 2, unknown: str = "raise"
) -> DataFrame:
    """(annotator, rec, review, labels, seven aspect columns) from files of four-line blocks.

    ``paths`` maps annotator to a file, or to a folder whose files are one text in name order.
    ``offset`` is the line of the first review: 2 for a file
    with a header line, 1 for one without. The label line is the one after the review. An aspect that is
    not known raises; with ``unknown="skip"`` it is left out, and ``labels.unknown_label_names`` lists it.
    """
    if unknown not in ("raise", "skip"):
        raise ValueError("unknown must be 'raise' or 'skip'")
    def blocks(annotator: str, path: str) -> DataFrame:
        shifted = F.col("line") - offset
        picked = numbered_lines(spark, path).filter((shifted >= 0) & (F.pmod(shifted, F.lit(4)) < 2))
        rec = F.shiftright(shifted, 2)
        # At most two lines share a window; one shuffle and one sort bring them together.
        pair = W.partitionBy("rec").orderBy("line")
        return (
            picked.withColumn("rec", rec).withColumn("labels", F.lead("value").over(pair))
            .filter(F.pmod(shifted, F.lit(4)) == 0)
            .select(
                F.lit(annotator).alias("annotator"), "rec", F.col("value").alias("review"),
                F.coalesce("labels", F.lit("")).alias("labels"),
            )
        )

    tables = reduce(DataFrame.unionByName, [blocks(a, p) for a, p in paths.items()])
    if unknown == "raise":
        found = F.array_except(
            F.regexp_extract_all("labels", F.lit(LABEL_PAIR), F.lit(1)), F.array(*map(F.lit, ANNOTATION_ASPECTS))
        )
        refused = F.raise_error(F.concat(F.lit("not an aspect: "), F.array_join(found, ", ")))
        tables = tables.withColumn("labels", F.when(F.size(found) > 0, refused).otherwise(F.col("labels")))
    return decode_label_text(tables, "labels", ["annotator", "rec", "review", "labels"])


def _one_line(c: str) -> Column:
    return F.regexp_replace(c, r"[\r\n]+", " ")


def write_annotations_txt(
    df: DataFrame,
    path: str,
    order_by: Sequence[str] = ("id",),
    aspects: Sequence[str] = ANNOTATION_ASPECTS,
    rec: str | None = None,
) -> None:
    """Four-line blocks numbered from 1, in order over the part files.

    ``rec`` names an existing column of consecutive numbers from 0, which saves counting. The
    blank line goes before every block but the first, so the parts read one after the other are
    one file. A line break inside a review becomes a space: it would end the review.
    """
    if rec is None:
        # Numbering leaves the rows in order, partition after partition.
        rec = "_rec"
        ordered = with_row_index(df, order_by=order_by, name=rec)
    else:
        ordered = df.repartitionByRange(rec).sortWithinPartitions(rec)
    block = F.concat_ws(
        "\n",
        F.concat(F.when(F.col(rec) > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("#"), (F.col(rec) + 1).cast("string")),
        F.coalesce(_one_line("review"), F.lit("")),
        encode_label_text(aspects),
    )
    ordered.select(block.alias("value")).write.option("lineSep", "\n").text(path)
