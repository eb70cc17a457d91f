"""Quoted CSV in many tasks a file, line breaks inside quotes included.

Whether a line break ends a record depends on the quotes before it. So every split of a file first counts its quotes; sums over
the splits before tell each split whether it begins inside quotes, and in which split the record then open
began. With that known every split cuts its own lines into records, and only a record that goes over a split's end is
put together from its pieces, at most two of each split.

A quote inside quotes is written twice, which leaves the count's parity as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_UNIT = "file string, start long, quotes long, closes boolean"
_PIECE = "file string, opened long, start long, record string, first boolean"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, start, lines) for each run of lines from one split."""
    if not batch.num_rows:
        return
    starts = batch.column("start").to_numpy()
    files = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
    cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(files) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.column("file")[a].as_py(), int(starts[a]), batch.slice(a, b - a)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every split's number of quotes, and whether a record open at its begin ends in it."""
    now, quotes, closes = None, 0, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "quotes": pa.array([quotes], pa.int64()), "closes": [closes]})

    for batch in batches:
        for file, start, lines in _runs(batch):
            if now is not None and now != (file, start):
                yield row()
                quotes, closes = 0, False
            now = (file, start)
            sums = quotes + np.cumsum(pc.count_substring(lines.column("value"), '"').to_numpy())
            closes |= bool((sums % 2 == 1).any())
            quotes = int(sums[-1])
    if now is not None:
        yield row()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (``opened`` null) and pieces of those that go over a split's end."""
    now, parity, open_lines, opened, first, first_open = None, 0, [], None, False, False

    def rows(records: list[str], where: int | None, is_first: list[bool]) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]] * n, pa.string()), pa.array([where] * n, pa.int64()), pa.array([now[1]] * n, pa.int64()),
             pa.array(records, pa.string()), pa.array(is_first, pa.bool_())],
            ["file", "opened", "start", "record", "first"],
        )

    for batch in batches:
        for file, start, lines in _runs(batch):
            if now != (file, start):
                if now is not None and open_lines:
                    yield rows(["\n".join(open_lines)], opened, [first_open])
                now, open_lines = (file, start), []
                inside = lines.column("inside")[0].as_py()
                parity, opened = int(inside), lines.column("opener")[0].as_py()
                first, first_open = start == 0, False
            values = lines.column("value")
            after = (parity + np.cumsum(pc.count_substring(values, '"').to_numpy())) % 2
            before = np.append(parity, after[:-1])
            parity = int(after[-1])
            alone = (before == 0) & (after == 0)
            if first and alone.any() and alone[0]:
                yield rows([values[0].as_py()], None, [True])
                first, alone[0], skip = False, False, True
            else:
                skip = False
            whole = values.filter(pa.array(alone)).to_pylist()
            if whole:
                yield rows(whole, None, [False] * len(whole))
            for k in np.flatnonzero((before == 1) | (after == 1)).tolist():
                if skip and k == 0:
                    continue
                if before[k] == 0:
                    open_lines, opened, first_open, first = [], now[1], first, False
                open_lines.append(values[k].as_py())
                if after[k] == 0:
                    # One that began here is whole; of one that began in an earlier split this is the last piece.
                    yield rows(["\n".join(open_lines)], None if opened == now[1] else opened, [first_open])
                    open_lines = []
    if now is not None and open_lines:
        yield rows(["\n".join(open_lines)], opened, [first_open])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): the text of every record of the files at ``path``; first marks those that open a file.

    Files are split like any text. A record whose quotes never close ends with its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    units = lines.mapInArrow(_units, _UNIT)
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    marked = units.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    # A split inside quotes from end to end passes the open record on.
    begins = F.when(~F.col("inside") | F.col("closes"), F.col("start"))
    states = marked.select("file", "start", "inside", F.last(begins, ignorenulls=True).over(earlier).alias("opener"))
    # One row per split.
    found = lines.join(F.broadcast(states), ["file", "start"]).mapInArrow(_records, _PIECE)
    pieces = found.filter(F.col("opened").isNotNull()).groupBy("file", "opened").agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"), F.bool_or("first").alias("first")
    )
    stitched = pieces.select(F.array_join(F.col("parts.record"), "\n").alias("record"), "first")
    return found.filter(F.col("opened").isNull()).select("record", "first").unionByName(stitched)


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header, every column as text; a file is as many tasks' work as it has splits."""
    head = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    schema = ", ".join(f"c{i} string" for i in range(len(head.columns)))
    body = records(spark, path).filter(~F.col("first")).select(F.rtrim("record", F.lit("\r")).alias("record"))
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    # The same without a blank record, which a CSV reader skips.
    cells = body.filter(F.col("record") != "").select(F.from_csv("record", schema, options).alias("cells"))
    return cells.select("cells.*").toDF(*head.columns)
