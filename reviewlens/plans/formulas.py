"""Small fixed networks and their closed formulas as SQL text, to hold predictions against."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from reviewlens.operators import kernels as kn
from reviewlens.schema import ASPECTS

INPUTS = ("CAST(l_quantity AS DOUBLE) / 50", "CAST(l_discount AS DOUBLE) * 10", "CAST(l_tax AS DOUBLE) * 10")
OUTPUTS = 2
HIDDEN = {"mlp": (3, 2), "rnn": (2,), "gru": (2,), "lstm": (2,)}


def weights(arch: str, inputs: int = len(INPUTS), outputs: int = OUTPUTS) -> kn.Weights:
    """Quarters between -3/4 and 3/4, so that single and double precision hold the same values."""
    out = {}
    for k, (name, shape) in enumerate(sorted(kn.shapes(arch, inputs, HIDDEN[arch], outputs).items())):
        out[name] = ((np.arange(np.prod(shape)) * 5 + 3 * k + 1) % 7 - 3).reshape(shape).astype(np.float32) / 4
    return out


def _layer(inputs: list[str], w: np.ndarray, b: np.ndarray) -> list[str]:
    return ["(" + " + ".join([f"({x}) * ({float(w[i, j])!r})" for i, x in enumerate(inputs)] + [f"({float(b[j])!r})"]) + ")" for j in range(len(b))]


def _sig(a: str) -> str:
    return f"(1.0 / (1.0 + exp(-{a})))"


def outputs(arch: str, w: kn.Weights | None = None, inputs: Sequence[str] = INPUTS) -> list[str]:
    """The network's outputs (by default over lineitem), in SQL that Spark and DuckDB both read."""
    w = weights(arch) if w is None else w
    a = _layer(list(inputs), w["w0"], w["b0"])
    if arch == "mlp":
        h = [f"greatest({x}, 0.0)" for x in _layer([f"greatest({x}, 0.0)" for x in a], w["w1"], w["b1"])]
    elif arch == "rnn":
        h = [f"tanh({x})" for x in a]
    elif arch == "gru":
        h = [f"((1.0 - {_sig(z)}) * tanh({n}))" for z, n in zip(a[:2], a[2:], strict=True)]
    else:
        h = [f"({_sig(o)} * tanh({_sig(i)} * tanh({g})))" for i, g, o in zip(a[:2], a[2:4], a[4:], strict=True)]
    return _layer(h, w["wo"], w["bo"])


# For gradients: off the places where a rectifier's input is zero, so that rounding decides no branch.
SHIFTED = tuple(f"{x} + {by}" for x, by in zip(INPUTS, (0.0123, 0.0371, 0.0517), strict=True))
TARGETS = ("CAST(l_extendedprice AS DOUBLE) / 100000", "CAST(l_linenumber AS DOUBLE) / 4")


def _plain(w: np.ndarray, i: int, j: int) -> str:
    return f"({float(w[i, j])!r})"


def gradient_sql(arch: str) -> str:
    """(name, at, value): the gradient of the mean squared error over all of lineitem, written out for ``mlp`` and ``rnn``."""
    w = weights(arch)
    steps = [", ".join([*(f"CAST(CAST({x} AS FLOAT) AS DOUBLE) AS x{i}" for i, x in enumerate(SHIFTED)), *(f"CAST({y} AS FLOAT) AS y{j}" for j, y in enumerate(TARGETS))])]
    wide = w["w0"].shape[1]

    def layer(values: list[str], name: str) -> list[str]:
        return _layer(values, w[f"w{name}"], w[f"b{name}"])

    steps.append(", ".join(f"{a} AS a{j}" for j, a in enumerate(layer([f"x{i}" for i in range(len(INPUTS))], "0"))))
    if arch == "mlp":
        steps.append(", ".join(f"greatest(a{j}, 0.0) AS f{j}" for j in range(wide)))
        steps.append(", ".join(f"greatest({s}, 0.0) AS h{j}" for j, s in enumerate(layer([f"f{j}" for j in range(wide)], "1"))))
    else:
        steps.append(", ".join(f"tanh(a{j}) AS h{j}" for j in range(wide)))
    top = w["wo"].shape[0]
    steps.append(", ".join(f"2.0 * ({o} - y{j}) / {OUTPUTS} AS d{j}" for j, o in enumerate(layer([f"h{i}" for i in range(top)], "o"))))
    back = [" + ".join(f"d{j} * {_plain(w['wo'], i, j)}" for j in range(OUTPUTS)) for i in range(top)]
    values = {("wo", i * OUTPUTS + j): f"h{i} * d{j}" for i in range(top) for j in range(OUTPUTS)} | {("bo", j): f"d{j}" for j in range(OUTPUTS)}
    if arch == "mlp":
        steps.append(", ".join(f"CASE WHEN h{i} > 0 THEN {b} ELSE 0.0 END AS s{i}" for i, b in enumerate(back)))
        values |= {("w1", i * top + j): f"f{i} * s{j}" for i in range(wide) for j in range(top)} | {("b1", j): f"s{j}" for j in range(top)}
        down = [" + ".join(f"s{j} * {_plain(w['w1'], i, j)}" for j in range(top)) for i in range(wide)]
        steps.append(", ".join(f"CASE WHEN f{i} > 0 THEN {b} ELSE 0.0 END AS e{i}" for i, b in enumerate(down)))
    else:
        steps.append(", ".join(f"({b}) * (1.0 - h{i} * h{i}) AS e{i}" for i, b in enumerate(back)))
    values |= {("w0", i * wide + j): f"x{i} * e{j}" for i in range(len(INPUTS)) for j in range(wide)} | {("b0", j): f"e{j}" for j in range(wide)}
    table = "lineitem"
    for columns in steps:
        table = f"(SELECT *, {columns} FROM {table})"
    means = ", ".join(f"avg({v}) AS {name}_{at}" for (name, at), v in values.items())
    rows = " UNION ALL ".join(f"SELECT '{name}' AS name, {at} AS at, round({name}_{at}, 7) + 0.0 AS value FROM means" for name, at in values)
    return f"WITH means AS (SELECT {means} FROM {table}) {rows}"


# Jobs over fixed models: counts of these words, seven outputs.
VOCABULARY = ("that", "is", "with", "by", "ngon", "quá", "đắt", "price", "hastag", "hashtag")
SENTENCES = ("Quán ngon quá, giá 50k", "with that price it is đắt", "it's \"ngon\"; is that by; đắt", "")
PHRASES = [("of", "the"), ("in", "the"), ("the", "same"), ("to", "the"), ("ngon", "quá")]


def model_weights(arch: str) -> kn.Weights:
    """A network over the words of ``VOCABULARY``. The sixteenth in the last bias keeps saturated outputs, which are
    multiples of a quarter, off the places where sentiments change."""
    w = weights(arch, len(VOCABULARY), len(ASPECTS))
    return {**w, "bo": w["bo"] + np.float32(0.0625)}


_WORD = 1 << 32


def _turned(x: str, by: int) -> str:
    return f"(({x}) * {1 << by} % {_WORD} + ({x}) // {1 << (32 - by)})"


def bucket_sql(term: str, width: int) -> str:
    """The bucket of a term among ``width``: the published 32-bit murmur hash of its bytes with seed 42, as a signed number."""

    def mixed(k: str) -> str:
        return f"list_transform(list_transform({k}, lambda k: k * 3432918353 % {_WORD}), lambda k: {_turned('k', 15)} * 461845907 % {_WORD})"

    data = f"hex(encode({term}))"
    number = "CAST('0x' || {} AS UBIGINT)"
    block = number.format(" || ".join(f"substr(b, 8 * i + {at}, 2)" for at in (7, 5, 3, 1)))
    blocks = f"list_transform(range(len(b) // 8), lambda i: {block})"
    rest = number.format(" || ".join(f"substr(b, len(b) // 8 * 8 + {at}, 2)" for at in (5, 3, 1)))
    tail = f"CASE WHEN len(b) % 8 = 0 THEN CAST(0 AS UBIGINT) ELSE {rest} END"
    body = f"list_reduce(list_prepend(CAST(42 AS UBIGINT), {mixed(blocks)}), lambda h, k: ({_turned('xor(h, k)', 13)} * 5 + 3864292196) % {_WORD})"
    h = f"xor(xor({body}, {mixed(f'[{tail}]')}[1]), CAST(len(b) // 2 AS UBIGINT))"
    steps = f"list_transform([{h}], lambda h: xor(h, h // 65536) * 2246822507 % {_WORD})"
    steps = f"list_transform({steps}, lambda h: xor(h, h // 8192) * 3266489909 % {_WORD})"
    steps = f"list_transform({steps}, lambda h: xor(h, h // 65536))"
    signed = f"list_transform({steps}, lambda h: CAST(h AS BIGINT) - CASE WHEN h >= {_WORD // 2} THEN {_WORD} ELSE 0 END)"
    return f"list_transform(list_transform([{data}], lambda b: {signed}[1]), lambda s: (s % {width} + {width}) % {width})[1]"
