"""Vector bin packing of training examples.

An example has three demands: tokens, one segment and loss-bearing tokens. Sequences limit all three
at once. The packer fills one sequence after the other: of the examples that still fit in every
dimension it takes the one whose demands have the largest dot product with what is left, each
dimension weighted by how scarce it is in the shard. Shards hold a bounded number of examples, so
packing is one grouped step whose width grows with the table, and each shard leaves about one
sequence partly empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.tokenizer import Ids
from reviewlens.session import scratch_path

TOKENS, SEGMENTS = 2048, 256
SHARD = 40_000
END_ID = 1


def place(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """A sequence number for each row of ``demands`` (rows in order of preference among equals).

    Every sequence holds at most ``limits`` in each column. A row above a limit raises ValueError.
    """
    if (demands > limits).any():
        raise ValueError("an example exceeds the limits of a sequence")
    if not len(demands):
        return np.zeros(0, np.int64)
    kinds, where = np.unique(demands, axis=0, return_inverse=True)
    rows = np.argsort(where.ravel(), kind="stable")
    left = np.bincount(where.ravel())
    nxt = np.concatenate([[0], np.cumsum(left)[:-1]])
    share = kinds / limits
    weighted = share * (demands.sum(0) / limits)
    sequence, number, waiting = np.full(len(demands), -1, np.int64), 0, len(demands)
    room = limits.astype(np.int64)
    while waiting:
        fits = np.flatnonzero((kinds <= room).all(1) & (left > 0))
        if not len(fits):
            number, room = number + 1, limits.astype(np.int64)
            continue
        k = fits[np.argmax(weighted[fits] @ (room / limits))]
        sequence[rows[nxt[k]]] = number
        nxt[k] += 1
        left[k] -= 1
        waiting -= 1
        room = room - kinds[k]
        if not left[k]:  # drop finished kinds now and then
            if (left > 0).sum() * 2 < len(left):
                keep = left > 0
                kinds, left, nxt, weighted = kinds[keep], left[keep], nxt[keep], weighted[keep]
        if not room.all():
            number, room = number + bool(waiting), limits.astype(np.int64)
    return sequence


def pack(examples: DataFrame, order: list[str], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, shard: int = SHARD) -> DataFrame:
    """``examples`` (length, loss_tokens, lane and any others) with sequence_id and offset, which replace carried
    columns of these names.

    Offsets are gapless from 0 in each sequence. ``order`` names columns that, with length, make the
    result repeatable; ``lane`` spreads equal rows over shards. No row is dropped; an example
    above a limit raises. A null loss_tokens counts as 0. An empty table gives an empty one.
    """
    n = examples.count()
    shards = max(1, -(-n // shard))
    limits = np.array([tokens, segments, tokens if loss is None else loss], np.int64)
    columns = [c for c in examples.columns if c.lower() not in ("lane", "sequence_id", "offset")]
    group = "shard"
    while group in map(str.lower, examples.columns):
        group += "_"

    def run(table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), *((c, "ascending") for c in order)]
        table = table.take(pc.sort_indices(table, sort_keys=keys))
        length, loss = table["length"].to_numpy(), pc.fill_null(table["loss_tokens"], 0).to_numpy()
        number = place(np.stack([length, np.ones(len(length), np.int64), loss], axis=1), limits)
        at = np.argsort(number, kind="stable")
        table, number = table.take(pa.array(at)), number[at]
        ends = length[at].cumsum()
        begins = ends - length[at]
        sequence = (table[group].to_numpy().astype(np.int64) << 32) + number
        offset = begins - begins[np.searchsorted(number, number)]
        return table.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.select(*columns).schema)
    placed = examples.select(*columns, F.pmod(F.xxhash64("lane", *order), F.lit(shards)).cast("int").alias(group))
    return placed.groupBy(group).applyInArrow(run, f"{kinds}, sequence_id long, offset long")


def pieces(docs: DataFrame, tokens: int = TOKENS, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Each text's ids and an end id, cut after every ``tokens`` ids:
    doc_id, start, length, ids_crc32, doc_tokens, loss_tokens (all of them) and lane, a running number."""

    def run(batches):
        ids, lane = Ids(vocabulary), 0
        for batch in batches:
            rows, names = [], []
            for row, own in enumerate(ids.texts(batch.column("text"))):
                own = np.append(own, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(own), tokens):
                    piece = own[start : start + tokens]
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(own), len(piece), lane))
                    names.append(row)
                lane += 1
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(names, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "lane"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, lane long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS) -> DataFrame:
    """Whole documents in sequences of at most ``tokens`` ids, one row per piece.

    A null or empty text is its end id alone. Repeated rows and null ids are packed like any other.
    """
    path = scratch_path(docs.sparkSession, "pieces")
    pieces(docs, tokens).write.parquet(path)
    return pack(docs.sparkSession.read.parquet(path), ["doc_id", "start"], tokens, segments)
