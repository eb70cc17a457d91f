"""Batch maths of the four aspect networks, used inside Spark tasks.

Every network sees a review as a sequence of length one from a zero state. The
recurrent weights never receive input, so a cell is a gate formula over one
sparse linear layer:

    mlp   relu(relu(a) W1 + b1)        a = x W0 + b0
    rnn   tanh(a)
    gru   (1 - sig(z)) tanh(n)         a = [z, n]
    lstm  sig(o) tanh(sig(i) tanh(g))  a = [i, g, o]

followed by dropout (cells only) and a linear output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

GATES = {"mlp": 1, "rnn": 1, "gru": 2, "lstm": 3}
Weights = dict[str, np.ndarray]


def shapes(arch: str, n_in: int, hidden: tuple[int, ...], n_out: int) -> dict[str, tuple[int, ...]]:
    wide = GATES[arch] * hidden[0]
    out = {"w0": (n_in, wide), "b0": (wide,)}
    last = hidden[0]
    if arch == "mlp":
        out |= {"w1": (hidden[0], hidden[1]), "b1": (hidden[1],)}
        last = hidden[1]
    return out | {"wo": (last, n_out), "bo": (n_out,)}


def initial(arch: str, n_in: int, hidden: tuple[int, ...], n_out: int, seed: int) -> Weights:
    """Uniform in +-1/sqrt(inputs of the layer)."""
    rng = np.random.default_rng(seed)
    sizes = shapes(arch, n_in, hidden, n_out)
    reach = {name[1]: 1.0 / np.sqrt(shape[0]) for name, shape in sizes.items() if name[0] == "w"}
    return {
        name: rng.uniform(-reach[name[1]], reach[name[1]], shape).astype(np.float32)
        for name, shape in sizes.items()
    }


def vectors(indices: pa.Array, values: pa.Array) -> pa.Array:
    """The column that ``Rows`` reads, from its two parts."""
    return pa.StructArray.from_arrays([indices, values], ["indices", "values"])


def positions(f: Column) -> Column:
    """Positions of an unwrapped vector, none for a dense one: Arrow's writer goes back over all rows before it for every null list."""
    return F.coalesce(f["indices"], F.array().cast("array<int>"))


def plain_vector(f: str) -> Column:
    """The unwrapped vector ``f`` with ``positions``."""
    c = F.col(f)
    return F.struct(c["size"].alias("size"), positions(c).alias("indices"), c["values"].alias("values")).alias(f)


class Rows:
    """Feature vectors of one Arrow column as row lengths, positions and values."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        values, indices = pc.struct_field(column, "values"), pc.struct_field(column, "indices")
        self.lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        self.values = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        # A dense vector has no indices: its positions count up from zero.
        sparse = np.repeat(pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False) > 0, self.lengths)
        self.at = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1], self.lengths)
        self.at[sparse] = indices.flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.lengths)

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns in use, dense block over them) for some rows."""
        n = self.lengths[rows]
        row = np.repeat(np.arange(len(rows)), n)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[rows], n)
        columns, slot = np.unique(self.at[spot], return_inverse=True)
        block = np.zeros((len(rows), len(columns)), np.float32)
        block[row, slot] = self.values[spot]
        return columns, block


def _sig(a: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(a, -60, 60)))


def forward(arch: str, w: Weights, columns: np.ndarray, x: np.ndarray, mask=None):
    """Outputs and what the backward pass needs."""
    a = x @ w["w0"][columns] + w["b0"]
    if arch == "mlp":
        first = np.maximum(a, 0)
        h = np.maximum(first @ w["w1"] + w["b1"], 0)
        memo = (first,)
    elif arch == "rnn":
        h, memo = np.tanh(a), ()
    elif arch == "gru":
        z, n = np.split(a, 2, axis=1)
        z, n = _sig(z), np.tanh(n)
        h, memo = (1 - z) * n, (z, n)
    else:
        i, g, o = np.split(a, 3, axis=1)
        i, g, o = _sig(i), np.tanh(g), _sig(o)
        c = np.tanh(i * g)
        h, memo = o * c, (i, g, o, c)
    dropped = h if mask is None else h * mask
    return dropped @ w["wo"] + w["bo"], (h, dropped, memo)


def gradients(arch: str, w: Weights, columns: np.ndarray, x: np.ndarray, y: np.ndarray, mask=None):
    """Mean squared error and its gradient; ``w0`` only for the columns in use."""
    out, (h, dropped, memo) = forward(arch, w, columns, x, mask)
    diff = out - y
    loss = float(np.mean(diff * diff))
    d_out = 2.0 * diff / diff.size
    grad = {"wo": dropped.T @ d_out, "bo": d_out.sum(0)}
    d_h = d_out @ w["wo"].T
    if mask is not None:
        d_h = d_h * mask
    if arch == "mlp":
        d_second = d_h * (h > 0)
        grad |= {"w1": memo[0].T @ d_second, "b1": d_second.sum(0)}
        d_a = (d_second @ w["w1"].T) * (memo[0] > 0)
    elif arch == "rnn":
        d_a = d_h * (1 - h * h)
    elif arch == "gru":
        z, n = memo
        d_a = np.concatenate([-d_h * n * z * (1 - z), d_h * (1 - z) * (1 - n * n)], axis=1)
    else:
        i, g, o, c = memo
        d_cell = d_h * o * (1 - c * c)
        d_a = np.concatenate(
            [d_cell * g * i * (1 - i), d_cell * i * (1 - g * g), d_h * c * o * (1 - o)], axis=1
        )
    return loss, grad | {"w0": x.T @ d_a, "b0": d_a.sum(0)}


def descend(w: Weights, grad: Weights, columns: np.ndarray, rate: float, clip: float) -> None:
    """One plain gradient step in place; ``clip`` > 0 bounds the gradient's norm."""
    if clip > 0:
        norm = np.sqrt(sum(float(np.sum(g * g)) for g in grad.values()))
        rate = rate * min(1.0, clip / norm) if norm > 0 else rate
    for name, g in grad.items():
        if name == "w0":
            w[name][columns] -= np.float32(rate) * g
        else:
            w[name] -= np.float32(rate) * g


def rechunk(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of exactly ``rows`` rows (the last may be shorter), whatever the incoming sizes."""
    waiting: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        waiting.append(batch)
        have += batch.num_rows
        while have >= rows:
            table = pa.Table.from_batches(waiting)
            yield table.slice(0, rows)
            waiting = table.slice(rows).to_batches()
            have -= rows
    if have:
        yield pa.Table.from_batches(waiting)
