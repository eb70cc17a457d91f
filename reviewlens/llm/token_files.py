"""Token ids of a table of texts as binary files, and back.

Ids are numbered anew by frequency, so the ids that occur most are the smallest numbers. Each number takes one
to four whole bytes; its length, less one, is two bits of a separate control byte, four numbers a byte. A reader looks
each control byte up in a table of four lengths and so decodes a block in a few numpy passes.

A written folder holds

* ``files/``: the ids in ascending order of doc_id, a header and then blocks (``_BLOCK_HEAD``) of doc ids, null marks,
  counts, control bytes and data bytes;
* ``vocabulary``: Parquet, (rank, id, n);
* ``manifest``: Parquet, one row per file in order. Files that lost or repeated tasks left are not in it and are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reviewlens.llm.tokenizer import Ids
from reviewlens.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FILE_IDS = 4 << 20  # ids of a file, about
BLOCK_IDS = 1 << 18  # ids of a block; a document with more is a block of its own

_MAGIC = b"RANKIDS1"
_BLOCK_HEAD = "<QQQ"  # documents, ids, data bytes
# The four lengths that each control byte stands for.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


# --- the coding ------------------------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(values, "<u4")
    more = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    fours = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    fours[: len(v)] = more
    fours = fours.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    return control, v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` numbers of control and data bytes."""
    length = _LENGTHS[control].ravel()[:n]
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(length > k)
        if not len(longer):
            break
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def ranks(counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every id, id of every rank), the most frequent id first and the smaller id among equals.

    Ids that do not occur come last, so any id below ``size`` can be written.
    """
    n = np.zeros(size, np.int64)
    for i, k in counts.items():
        n[i] = k
    by_rank = np.argsort(-n, kind="stable").astype(np.uint32)
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    return rank, by_rank


# --- files -----------------------------------------------------------------------------------


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its name there. Any of Arrow's (local, HDFS, S3, GCS) that all executors reach."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _write_block(out, keys: list[int | None], ids: list[np.ndarray], rank: np.ndarray) -> None:
    flat = np.concatenate(ids)
    control, data = encode(rank[flat])
    out.write(struct.pack(_BLOCK_HEAD, len(keys), len(flat), len(data)))
    out.write(np.array([k or 0 for k in keys], "<i8").tobytes())
    out.write(np.array([k is None for k in keys], np.uint8).tobytes())
    out.write(np.array([len(x) for x in ids], "<u8").tobytes())
    out.write(control.tobytes())
    out.write(data.tobytes())


def _blocks(source, by_rank: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, all ids) of every block of an open file."""
    if source.read(len(_MAGIC)) != _MAGIC:
        raise ValueError("not a token file")
    while head := source.read(struct.calcsize(_BLOCK_HEAD)):
        docs, n, size = struct.unpack(_BLOCK_HEAD, head)
        keys = np.frombuffer(source.read(8 * docs), "<i8")
        null = np.frombuffer(source.read(docs), np.uint8)
        counts = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)
        control = np.frombuffer(source.read(-(-n // 4)), np.uint8)
        ids = by_rank[decode(control, np.frombuffer(source.read(size), np.uint8), n)]
        yield [None if x else k for k, x in zip(keys.tolist(), null.tolist(), strict=True)], counts, ids


# --- Spark -----------------------------------------------------------------------------------


def _width(vocabulary: str, end_id: int) -> str:
    """The bytes of an id on the way to the files: two where the vocabulary allows it."""
    return "<u2" if max(len(Ids(vocabulary).bytes_of), end_id) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, crc, ids): every text's ids and the end id, as little-endian bytes of two or four. A null text is empty.

    crc is that of the ids as four bytes each.
    """
    width = _width(vocabulary, end_id)

    def run(batches):
        encoder = Ids(vocabulary)
        for batch in batches:
            all_ids = [np.append(own, np.uint32(end_id)).astype("<u4") for own in encoder.texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(map(len, all_ids), pa.int64()),
                    pa.array([zlib.crc32(x) for x in all_ids], pa.int64()), pa.array([x.astype(width).tobytes() for x in all_ids], pa.binary()),
                ],
                ["doc_id", "n", "crc", "ids"],
            )

    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be a whole number")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, crc long, ids binary")


def id_counts(table: DataFrame, width: str) -> DataFrame:
    """(id, n) over an ``ids`` column of numbers of that ``width``; counted in every task first."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column("ids"):
                own = np.bincount(np.frombuffer(cell.as_buffer(), width), minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return table.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, file_ids: int = FILE_IDS
) -> None:
    """Write the ids of ``docs`` (doc_id, text and any others, which are ignored) below ``path``.

    Documents lie in ascending order of doc_id, null ones first; rows of one doc_id by length and checksum, so
    repeated rows are written as often as they occur and a doc_id held by very many rows spreads over files. A null or
    empty text is its end id alone. An empty table gives no files. Texts are encoded once, whole; a text is at most one block.
    """
    spark = docs.sparkSession
    kept, width = scratch_path(spark, "ids"), _width(vocabulary, end_id)
    # A running number tells equal rows apart; written, it stays the same however often tasks are repeated.
    encoded(docs, vocabulary, end_id).withColumn("lane", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(kept)
    table = spark.read.parquet(kept)
    # One row per id of the vocabulary at most, whatever the corpus.
    counts = {r["id"]: r["n"] for r in id_counts(table, width).collect()}
    size = max([len(Ids(vocabulary).bytes_of) + 1, *(i + 1 for i in counts)])
    rank, by_rank = ranks(counts, size)
    listed = [(r, int(i), counts.get(int(i), 0)) for r, i in enumerate(by_rank)]
    spark.createDataFrame(listed, "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/vocabulary")
    shared = spark.sparkContext.broadcast(rank)
    files = max(1, -(-sum(counts.values()) // file_ids))

    def run(batches):
        system, top = _open(f"{path}/files")
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        out, keys, ids, waiting = None, [], [], 0
        for batch in batches:
            for key, cell in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(cell.as_buffer(), width)
                if out is None:
                    system.create_dir(top, recursive=True)
                    out = system.open_output_stream(f"{top}/{name}")
                    out.write(_MAGIC)
                if keys and waiting + len(own) > BLOCK_IDS:
                    _write_block(out, keys, ids, shared.value)
                    keys, ids, waiting = [], [], 0
                keys.append(key)
                ids.append(own)
                waiting += len(own)
                n_docs, n_ids = n_docs + 1, n_ids + len(own)
        if out is not None:
            _write_block(out, keys, ids, shared.value)
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids], "bytes": [size],
            })

    order = ["doc_id", "n", "crc", "lane"]
    placed = table.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    placed.mapInArrow(run, "part int, file string, n_docs long, n_ids long, bytes long").write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The documents of a written folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids.

    ids_crc32 is that of the ids as unsigned little-endian 32-bit numbers. Without ``ids`` that column is left out.
    Each file is one task's work; a block at a time is in memory.
    """
    # As many rows as the vocabulary has ids.
    listed = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").select("id").collect()
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in listed], "<u4"))
    manifest = spark.read.parquet(f"{path}/manifest")
    # One row per file passes through this window.
    before = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches):
        system, top = _open(f"{path}/files")
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with system.open_input_stream(f"{top}/{name}") as source:
                    for keys, counts, flat in _blocks(source, shared.value):
                        ends = np.cumsum(counts)
                        begins = ends - counts
                        raw = memoryview(flat.astype("<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                        columns = [pa.array(keys, pa.int64()), pa.array(start + begins), pa.array(counts), pa.array(crc, pa.int64())]
                        if ids:
                            offsets = pa.array(np.append(begins, ends[-1]), pa.int32())
                            columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
                        start += len(flat)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    tasks = max(1, manifest.count())
    return files.repartition(tasks).mapInArrow(run, schema)
