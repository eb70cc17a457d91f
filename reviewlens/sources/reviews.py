"""Review tables, sentences and the acronym dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.schema import ASPECTS
from reviewlens.session import spread_out
from reviewlens.sources.csv_records import read_split_csv

# Cell texts a CSV reader takes as missing.
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, multi_line: bool | str = True) -> DataFrame:
    """Every column as text, missing cells null.

    Quoted line breaks need ``multi_line``, which reads each file in one task, or ``multi_line="split"``, which reads large files
    in many (``sources.csv_records``); files without such breaks can be split by turning it off.
    """
    df = read_split_csv(spark, path) if multi_line == "split" else (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    # A byte order mark belongs to the file, not to the first column's name.
    names = [c.lstrip("﻿") for c in df.columns]
    return df.toDF(*names).select(
        *[F.when(~F.col(f"`{c}`").isin(MISSING_CELLS), F.col(f"`{c}`")).alias(c) for c in names]
    )


def read_reviews(
    spark: SparkSession, paths: str | Sequence[str], keep: Sequence[str] = (), multi_line: bool | str = True
) -> DataFrame:
    """``cmt`` and the seven label columns as text, by name, rows of all paths together.

    Few large files are dealt out over all cores after reading.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    tables = [read_csv(spark, p, multi_line).select(*keep, "cmt", *ASPECTS) for p in paths]
    return spread_out(reduce(DataFrame.unionByName, tables))


def sentences_df(spark: SparkSession, sentences: str | Sequence[str]) -> DataFrame:
    """A table ``cmt`` from inline text, which may hold any characters."""
    rows = [sentences] if isinstance(sentences, str) else sentences
    return spark.createDataFrame([(s,) for s in rows], "cmt string")


def acronym_rules(df: DataFrame, columns: Sequence[str], pos: str, min_len: int = 3) -> DataFrame:
    """(pos, src, dst) from dictionary rows, in order of ``pos``.

    A row counts if exactly two of its cells have ``min_len`` characters or more: short form, then
    expansion. A repeated expansion keeps its first place and takes the last short form.
    """
    cells = F.filter(F.array(*[F.col(c) for c in columns]), lambda v: F.length(v) >= min_len)
    pairs = df.select(pos, cells.alias("c")).filter(F.size("c") == 2).select(
        F.col(pos).alias("pos"), F.col("c")[0].alias("src"), F.col("c")[1].alias("dst")
    )
    return pairs.groupBy("dst").agg(
        F.min("pos").alias("pos"), F.max_by("src", "pos").alias("src")
    ).select("pos", "src", "dst")


def collect_rules(rules: DataFrame, limit: int = 100_000) -> list[tuple[str, str]]:
    """The dictionary as an ordered list for ``clean_text``; it becomes part of the plan.

    A dictionary is written by people; one past ``limit`` is refused, not cut.
    """
    rows = rules.select("pos", "src", "dst").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} acronym rules")
    return [(r["src"], r["dst"]) for r in sorted(rows, key=lambda r: r["pos"])]
