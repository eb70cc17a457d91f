"""Synchronous descent: every step uses the gradient of one whole batch, however large, summed over tasks.

Rows are numbered in an order that only their content fixes. A batch is a range of numbers, a part a
fixed number of its rows, so the parts depend on the number of rows and not on cores or files. Each part gives
its gradient in double precision, parts are added by a tree in the order of their numbers, and one step is
taken: other hardware, or another layout of the input, gives the same weights to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import kernels as kn
from reviewlens.operators.rows import with_row_index
from reviewlens.session import stored

PART = 4096  # rows of a part
BLOCK = 256  # rows of one dense product
FAN_IN = 32  # parts that one group adds
CHUNK = 16_384  # values per row on the way
RUN = 1 << 17  # rows stored together
_PIECE = "name string, chunk int, part long, g binary"


def numbered(df: DataFrame, features: str, label: str, seed: int) -> DataFrame:
    """Checkpointed (at, f, y): rows numbered from 0 in an order that the seed and their content fix.

    Equal rows are interchangeable, so their order does not matter.
    """
    rows = df.select(F.unwrap_udt(features).alias("f"), F.col(label).cast("array<float>").alias("y"))
    spread = F.xxhash64(F.lit(seed), "f.indices", "f.values", "y")
    order = ["h", "indices", "values", "y"]
    keyed = rows.select(spread.alias("h"), F.col("f.indices").alias("indices"), F.col("f.values").alias("values"), "y", "f")
    return with_row_index(keyed, order_by=order, name="at").select("at", kn.plain_vector("f"), "y")


def _add(table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table, [("part", "ascending")]))
    total = np.frombuffer(table["g"][0].as_buffer(), np.float64).copy()
    for k in range(1, table.num_rows):
        total += np.frombuffer(table["g"][k].as_buffer(), np.float64)
    return pa.table({
        "name": table["name"].slice(0, 1), "chunk": table["chunk"].slice(0, 1),
        "part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), "g": pa.array([total.tobytes()], pa.binary()),
    })


def _part_sum(arch: str, w: kn.Weights, table: pa.Table, n_out: int, cells: float, drop: float, seed: tuple[int, ...]) -> kn.Weights:
    """Loss and gradient of a part's rows, as their shares of a mean over ``cells`` values."""
    total = {k: np.zeros(v.shape, np.float64) for k, v in w.items()} | {"loss": np.zeros(1)}
    x = kn.Rows(table["f"])
    y = table["y"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(x), -1)
    rng = np.random.default_rng(seed)
    for start in range(0, len(x), BLOCK):
        pick = np.arange(start, min(start + BLOCK, len(x)))
        mask = None
        if drop > 0:
            mask = (rng.random((len(pick), w["wo"].shape[0])) >= drop) / (1 - drop)
        columns, block = x.batch(pick)
        loss, grad = kn.gradients(arch, w, columns, block.astype(np.float64), y[pick], mask)
        # That is the mean over the block; the batch's is wanted.
        share = len(pick) * n_out / cells
        total["loss"] += loss * share
        for name, g in grad.items():
            if name == "w0":
                total[name][columns] += g * share
            else:
                total[name] += g * share
    return total


def _pieces(arrays: kn.Weights, number: int) -> pa.Table:
    names, chunks, values = [], [], []
    for name, array in arrays.items():
        flat = array.ravel()
        for at, start in enumerate(range(0, len(flat), CHUNK)):
            names.append(name)
            chunks.append(at)
            values.append(flat[start : start + CHUNK].tobytes())
    return pa.table({
        "name": pa.array(names, pa.string()), "chunk": pa.array(chunks, pa.int32()),
        "part": pa.array([number] * len(names), pa.int64()), "g": pa.array(values, pa.binary()),
    })


def gradient(
    rows: DataFrame, arch: str, weights: kn.Weights, first: int, last: int, drop: float = 0.0, seed: tuple[int, ...] = ()
) -> tuple[float, kn.Weights]:
    """Mean squared error over rows ``first`` to ``last - 1`` of a numbered table, and its gradient.

    ``drop`` is the share of hidden values left out, chosen by ``seed`` and the part. Only the sum, as large as the weights,
    reaches the driver.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast({k: v.astype(np.float64) for k, v in weights.items()})
    n_out = weights["bo"].shape[0]
    cells = float((last - first) * n_out)

    def part(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("at", "ascending")]))
        number = table["part"][0].as_py()
        return _pieces(_part_sum(arch, shared.value, table, n_out, cells, drop, (*seed, number)), number)

    batch = rows.filter((F.col("at") >= first) & (F.col("at") < last)).withColumn("part", F.expr(f"(at - {first}L) div {PART}"))
    sums, left = batch.groupBy("part").applyInArrow(part, _PIECE), -(-(last - first) // PART)
    while left > 1:
        sums, left = sums.groupBy("name", "chunk", F.expr(f"part div {FAN_IN}")).applyInArrow(_add, _PIECE), -(-left // FAN_IN)
    whole = _assemble(sums)
    shared.destroy()
    loss = float(whole["loss"][0])
    return loss, {name: whole[name].reshape(w.shape) for name, w in weights.items()}


def _assemble(pieces: DataFrame) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {}
    for r in pieces.select("name", "chunk", "g").collect():
        parts.setdefault(r["name"], []).append((r["chunk"], np.frombuffer(r["g"], np.float64)))
    return {name: np.concatenate([v for _, v in sorted(found, key=lambda p: p[0])]) for name, found in parts.items()}


def _step(w: kn.Weights, grad: kn.Weights, rate: float, clip: float) -> kn.Weights:
    norm = np.sqrt(sum(float(np.sum(grad[k] * grad[k])) for k in w))
    scale = rate * min(1.0, clip / norm) if clip > 0 and norm > 0 else rate
    return {k: v - scale * grad[k] for k, v in w.items()}


def _walk(
    run: DataFrame, n: int, arch: str, w: kn.Weights, total: float, first: int, batch: int, rate: float, clip: float, drop: float,
    seed: tuple[int, ...],
) -> tuple[float, kn.Weights]:
    """(``total`` with the losses, weights) after the steps over the rows of one run, each of at most one part.

    Such steps have nothing to share out: every one waits for the weights of the one before. The task that reads a run takes them one after the
    other, a batch in memory at a time, so that no step costs a job.
    """
    sc = run.sparkSession.sparkContext
    shared = sc.broadcast((w, total))
    n_out = w["bo"].shape[0]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = shared.value
        for step, table in enumerate(kn.rechunk(batches, batch), first // batch):
            size = min(batch, n - step * batch)
            found = _part_sum(arch, w, table, n_out, float(size * n_out), drop, (*seed, step, 0))
            total += float(found["loss"][0]) * size
            w = _step(w, found, rate, clip)
        yield from _pieces(w | {"loss": np.array([total])}, 0).to_batches()

    whole = _assemble(run.select("at", "f", "y").coalesce(1).sortWithinPartitions("at").mapInArrow(walk, _PIECE))
    shared.destroy()
    return float(whole["loss"][0]), {name: whole[name].reshape(v.shape) for name, v in w.items()}


def fit(
    rows: DataFrame, n: int, arch: str, weights: kn.Weights, batch: int, epochs: int, rate: float, clip: float, drop: float, seed: int
) -> Iterator[tuple[float, kn.Weights]]:
    """(loss, weights) after every pass over the ``n`` numbered rows, in steps of ``batch`` rows.

    Rows are stored in runs of whole steps, one folder each, so that a step reads its run and not the table.
    """
    w = {k: v.astype(np.float64) for k, v in weights.items()}
    span = max(1, RUN // batch) * batch
    runs = stored(rows.withColumn("run", F.expr(f"cast(at div {span}L as int)")), "runs", "run")
    for epoch in range(epochs):
        total = 0.0
        for k, begin in enumerate(range(0, n, span)):
            run, end = runs.filter(F.col("run") == k), min(begin + span, n)
            if batch <= PART:
                total, w = _walk(run, n, arch, w, total, begin, batch, rate, clip, drop, (seed, epoch))
                continue
            for first in range(begin, end, batch):
                last = min(first + batch, end)
                loss, grad = gradient(run, arch, w, first, last, drop, (seed, epoch, first // batch))
                total += loss * (last - first)
                w = _step(w, grad, rate, clip)
        yield total / n, w
