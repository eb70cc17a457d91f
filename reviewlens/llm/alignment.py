"""Two tokenizers' tokens of the same texts, aligned by byte ranges.

A space and the text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B). Byte places where tokens
of both end cut the tokens into groups; tokens whose byte ranges overlap are linked.

Any stretch of the two token streams is a ``Fragment``: an open prefix (tokens up to the first common end), closed
groups, and an open suffix (tokens after the last common end). Fragments of neighbouring stretches compose, in any
bracketing, to that of the whole: the left suffix and the right prefix meet, are searched for common ends once more and
close the groups between. So very long texts are cut into byte ranges, each a task's work, and their
fragments are put together by a tree of groupings; a short text is one stretch.

Each vocabulary is cut where none of its own tokens can span, so the two streams of a stretch need not cover the same bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from pathlib import Path
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from reviewlens.llm.tokenizer import _LEAD, _MAYBE_SPACE, Ids
from reviewlens.llm.words import utf8
from reviewlens.session import scratch_path

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BLOCK = 1 << 18  # bytes of short texts aligned at once
LONG = 1 << 16  # a text of more bytes is cut into stretches of about so many
ROWS = 512  # short texts copied at once
PART = 1 << 14  # bytes that one call of the piece library encodes
FAN = 8  # fragments that one group composes
HOT = 100_000  # fewer id pairs than this are sent to every task, whatever the corpus
MARK = "▁"  # stands for a space in pieces, so a text that holds it is not given back


# --- vocabularies ----------------------------------------------------------------------------


class _Bytes:
    """The bytes of every token, end to end."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        place = np.cumsum(length) - length
        return self.pool[np.repeat(self.start[ids] - place, length) + np.arange(length.sum())]


class ByteIds(Ids):
    """Byte-level ids; the spelling of a special token is plain text."""

    def __init__(self, name: str = BYTE_VOCABULARY) -> None:
        super().__init__(name)
        self.tokens = _Bytes([self.ranks.decode_single_token_bytes(i) for i in range(len(self.bytes_of))])

    @property
    def whole(self) -> Tokenizer:
        plain = super().whole
        plain.encode_special_tokens = True
        return plain

    @staticmethod
    def cuts(raw: np.ndarray) -> np.ndarray:
        """Places that no token spans: a space or line break between two characters that are no white space."""
        n = len(raw)
        if n < 3:
            return np.zeros(0, np.int64)
        blank, lead, maybe = (raw == 0x20) | (raw == 0x0A), _LEAD[raw], _MAYBE_SPACE[raw]
        before = maybe.copy()
        before[1:] |= lead[:-1]
        before[2:] |= lead[:-2]
        return 1 + np.flatnonzero(blank[1:-1] & ~before[:-2] & ~maybe[2:])


class PieceIds(Ids):
    """Piece ids of texts that already begin with the space the vocabulary would add."""

    def __init__(self, name: str = PIECE_VOCABULARY) -> None:
        settings = sentencepiece_model_pb2.ModelProto.FromString(Path(public_tokenizers.path(name)).read_bytes())
        settings.normalizer_spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=settings.SerializeToString())
        self.tokens = _Bytes([self._bytes(i) for i in range(self.model.get_piece_size())])
        self.bytes_of = self.tokens.length
        self._forget()

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.replace(MARK, " ").encode()

    def _encode(self, text: bytes) -> np.ndarray:
        """In parts, since the library's memory for one call is hundreds of times its text."""
        raw = np.frombuffer(text, np.uint8)
        cuts = np.append(self.cuts(raw), len(raw))
        ends = np.unique(cuts[np.searchsorted(cuts, np.append(np.arange(PART, len(raw), PART), len(raw)))]).tolist()
        parts = [text[i:j].decode("utf-8", "replace") for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return np.array([i for part in parts for i in self.model.encode(part)], np.uint32)

    @property
    def whole(self) -> SimpleNamespace:
        """Texts that spell a special token of the other vocabulary are encoded like any other."""
        return SimpleNamespace(encode=lambda text, add_special_tokens: SimpleNamespace(ids=self._encode(text.encode())))

    @staticmethod
    def cuts(raw: np.ndarray) -> np.ndarray:
        """Places that no piece spans: a space after something else (a piece has spaces only in front)."""
        return 1 + np.flatnonzero((raw[1:] == 0x20) & (raw[:-1] != 0x20))


@cache
def _vocabularies(a: str, b: str) -> tuple[ByteIds, PieceIds]:
    return ByteIds(a), PieceIds(b)


class Pair(NamedTuple):
    """Names of both vocabularies, a bound of all ids and one of B's. Only tasks that encode load the files."""

    a: str
    b: str
    size: int
    width: int

    @classmethod
    def of(cls, a: str, b: str) -> Pair:
        ids = _vocabularies(a, b)
        return cls(a, b, max(len(x.bytes_of) for x in ids), len(ids[1].bytes_of))


# --- alignment -------------------------------------------------------------------------------


class Tokens(NamedTuple):
    """A stretch of both streams: ids and the byte places where they end."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def upto(self, place: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, place, "right"), np.searchsorted(self.b_end, place, "right")
        return Tokens(self.a[:i], self.a_end[:i], self.b[:j], self.b_end[:j])

    def after(self, place: int) -> Tokens:
        i, j = np.searchsorted(self.a_end, place, "right"), np.searchsorted(self.b_end, place, "right")
        return Tokens(self.a[i:], self.a_end[i:], self.b[j:], self.b_end[j:])

    def __add__(self, right: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self, right, strict=True)))


NOTHING = Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


class Groups(NamedTuple):
    """Closed groups: their text (each ended by ``;``), number, distinct links as a * width + b, and how often each occurs."""

    text: bytes
    n: int
    pairs: np.ndarray
    times: np.ndarray

    def __add__(self, right: Groups) -> Groups:
        pairs, where = np.unique(np.concatenate([self.pairs, right.pairs]), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, where, np.concatenate([self.times, right.times]))
        return Groups(self.text + right.text, self.n + right.n, pairs, times)


NO_GROUPS = Groups(b"", 0, np.zeros(0, np.int64), np.zeros(0, np.int64))


class Fragment(NamedTuple):
    """``closed`` is None where the stretch has no common end; all its tokens are the prefix then."""

    prefix: Tokens
    closed: Groups | None
    suffix: Tokens


@cache
def _cells(size: int) -> list[bytes]:
    return [b"%d%c" % (i, mark) for i in range(size) for mark in b",|;"]


class Aligned(NamedTuple):
    """All groups and links of streams that cover the same bytes."""

    common: np.ndarray  # where groups end
    cells: np.ndarray  # the text's parts, as numbers of ``_cells``
    ends: np.ndarray  # where links end
    pairs: np.ndarray


def align(t: Tokens, width: int) -> Aligned:
    """Groups and links of two streams that end at one place. Between two ends of either stream just one
    token of each lies, and every overlapping pair shares just one such stretch."""
    common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
    of_a, of_b = np.searchsorted(common, t.a_end), np.searchsorted(common, t.b_end)
    cells = np.empty(len(t.a) + len(t.b), np.int64)
    cells[np.arange(len(t.a)) + np.searchsorted(of_b, of_a)] = t.a * 3 + (t.a_end == common[of_a])
    cells[np.arange(len(t.b)) + np.searchsorted(of_a, of_b, "right")] = t.b * 3 + 2 * (t.b_end == common[of_b])
    ends = np.union1d(t.a_end, t.b_end)
    pairs = t.a[np.searchsorted(t.a_end, ends)] * width + t.b[np.searchsorted(t.b_end, ends)]
    return Aligned(common, cells, ends, pairs)


def _groups(t: Tokens, size: int, width: int) -> Groups:
    found = align(t, width)
    names = _cells(size)
    pairs, times = np.unique(found.pairs, return_counts=True)
    return Groups(b"".join(names[c] for c in found.cells.tolist()), len(found.common), pairs, times)


def fragment(t: Tokens, size: int, width: int) -> Fragment:
    """The fragment of one stretch. ``size`` bounds all ids, ``width`` those of B."""
    common = np.intersect1d(t.a_end, t.b_end, assume_unique=True)
    if not len(common):
        return Fragment(t, None, NOTHING)
    rest = t.after(common[0])
    inner = rest.upto(common[-1])
    return Fragment(t.upto(common[0]), _groups(inner, size, width) if len(inner.a) else NO_GROUPS, rest.after(common[-1]))


def compose(x: Fragment, y: Fragment, size: int, width: int) -> Fragment:
    """The fragment of two neighbouring stretches; associative."""
    if x.closed is None:
        head = fragment(x.prefix + y.prefix, size, width)
        if y.closed is None:
            return head
        # The right prefix ends at a common end, so nothing of the head stays open behind.
        return Fragment(head.prefix, head.closed + y.closed, y.suffix)
    middle = x.suffix + y.prefix
    if y.closed is not None:
        return Fragment(x.prefix, x.closed + (_groups(middle, size, width) if len(middle.a) else NO_GROUPS) + y.closed, y.suffix)
    tail = fragment(middle, size, width)
    if tail.closed is None:
        return Fragment(x.prefix, x.closed, middle)
    return Fragment(x.prefix, x.closed + _groups(tail.prefix, size, width) + tail.closed, tail.suffix)


def whole(x: Fragment, size: int, width: int) -> Groups:
    """The groups of a text from its fragment: at its begin and end both streams meet."""
    return (_groups(x.prefix, size, width) if len(x.prefix.a) else NO_GROUPS) + (x.closed or NO_GROUPS)


# --- short texts -----------------------------------------------------------------------------

_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def _rows(n_a, n_b, n_groups, n_links, groups, pairs, times) -> list[pa.Array]:
    counts = [pa.array(np.asarray(x, np.int64)) for x in (n_a, n_b, n_groups, n_links)]
    return [*counts, pa.array(groups, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]


def _exact(raw: np.ndarray, places: np.ndarray, vocabulary: Ids) -> tuple[list[np.ndarray], np.ndarray]:
    """Every text's ids, and whether their bytes are the text's."""
    data = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw))
    ids = list(vocabulary.texts(data))
    return ids, np.array([
        np.array_equal(vocabulary.tokens.joined(x), raw[i:j]) for x, i, j in zip(ids, places[:-1], places[1:], strict=True)
    ], bool)


def _with_space(texts: pa.Array) -> pa.Array:
    """A space and the text; nothing for texts that have no tokens."""
    texts = texts.cast(pa.large_string())
    none = pc.fill_null(pc.or_(pc.equal(texts, ""), pc.match_substring(texts, MARK)), True)
    blank, empty = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.if_else(none, empty, pc.binary_join_element_wise(blank, texts, empty))


def _short(batches: Iterator[pa.RecordBatch], names: Pair) -> Iterator[pa.RecordBatch]:
    a_ids, b_ids = _vocabularies(names.a, names.b)
    size, width = names.size, names.width
    cell_names = _cells(size)
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        raw, places = utf8(_with_space(batch.column("text")))
        at, n = 0, len(places) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(places, places[at] + BLOCK, side="right")) - 1)
            own, own_places = raw[places[at] : places[to]], places[at : to + 1] - places[at]
            (a, a_same), (b, b_same) = _exact(own, own_places, a_ids), _exact(own, own_places, b_ids)
            same = a_same & b_same
            a, b = ([x if s else x[:0] for x, s in zip(y, same, strict=True)] for y in (a, b))
            n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            # The texts lie end to end, so that of every text is a common end.
            flat = [np.concatenate(x).astype(np.int64) for x in (a, b)]
            t = Tokens(flat[0], np.cumsum(a_ids.bytes_of[flat[0]]), flat[1], np.cumsum(b_ids.bytes_of[flat[1]]))
            stops = np.cumsum(np.where(same, np.diff(own_places), 0))
            found = align(t, width)
            n_groups = np.diff(np.searchsorted(found.common, stops, "right"), prepend=0)
            row = np.searchsorted(stops, found.ends)
            keys, times = np.unique(row * (size * width) + found.pairs, return_counts=True)
            bounds = np.append(0, np.cumsum(n_a + n_b))
            cells = found.cells.tolist()
            spots = np.searchsorted(keys, np.arange(to - at + 1) * (size * width))
            parts = list(zip(spots[:-1].tolist(), spots[1:].tolist(), strict=True))
            pairs, times = (keys % (size * width)).astype("<i8"), times.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(at, to - at), batch.column("doc_id").slice(at, to - at),
                    *_rows(
                        n_a, n_b, n_groups, np.bincount(row, minlength=to - at),
                        [b"".join(map(cell_names.__getitem__, cells[i:j]))[:-1].decode() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)],
                        [pairs[i:j].tobytes() for i, j in parts], [times[i:j].tobytes() for i, j in parts],
                    ),
                ],
                ["row", "doc_id", *_names()],
            )
            at = to


def _names() -> list[str]:
    return [x.split()[0] for x in _RESULT.split(", ")]


# --- long texts ------------------------------------------------------------------------------

_STRETCH = "chunk int, a_start long, a_text string, b_start long, b_text string"
_OPEN = [f"{side}_{x}" for side in ("prefix", "suffix") for x in ("a", "a_end", "b", "b_end")]
_FRAGMENT = ", ".join([
    "chunk int, same boolean, n_a long, n_b long, cut boolean, text binary, n_groups long, pairs binary, times binary",
    *(f"{x} binary" for x in _OPEN),
])


def _cut(batches: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """Stretches of about ``long`` bytes; a vocabulary's part begins at its first cut from there on."""
    for batch in batches:
        for row, doc_id, text in zip(batch.column("row"), batch.column("doc_id"), _with_space(batch.column("text")), strict=True):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            wanted = np.arange(long, len(raw), long)
            ends = []
            for vocabulary in (ByteIds, PieceIds):
                cuts = np.append(vocabulary.cuts(raw), len(raw))
                ends.append(np.append(cuts[np.searchsorted(cuts, wanted)], len(raw)))
            starts = [np.append(0, x[:-1]) for x in ends]
            for chunk in range(len(ends[0])):
                (i, k), (j, m) = ((int(s[chunk]), int(e[chunk])) for s, e in zip(starts, ends, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.as_py()]), pa.array([doc_id.as_py()], doc_id.type), pa.array([chunk], pa.int32()),
                        pa.array([i]), pa.array([raw[i:k].tobytes().decode("utf-8", "replace")]),
                        pa.array([j]), pa.array([raw[j:m].tobytes().decode("utf-8", "replace")]),
                    ],
                    ["row", "doc_id", "chunk", "a_start", "a_text", "b_start", "b_text"],
                )


def _fragment_row(row, doc_id, chunk: int, same: bool, n_a: int, n_b: int, x: Fragment) -> pa.RecordBatch:
    closed = x.closed or NO_GROUPS
    opened = [pa.array([y.astype("<i8").tobytes()], pa.binary()) for y in (*x.prefix, *x.suffix)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row]), doc_id, pa.array([chunk], pa.int32()), pa.array([same]), pa.array([n_a]), pa.array([n_b]),
            pa.array([x.closed is not None]), pa.array([closed.text], pa.binary()), pa.array([closed.n]),
            pa.array([closed.pairs.astype("<i8").tobytes()]), pa.array([closed.times.astype("<i8").tobytes()]), *opened,
        ],
        ["row", "doc_id", *(x.split()[0] for x in _FRAGMENT.split(", "))],
    )


def _fragments(batches: Iterator[pa.RecordBatch], names: Pair) -> Iterator[pa.RecordBatch]:
    a_ids, b_ids = _vocabularies(names.a, names.b)
    for batch in batches:
        for k in range(batch.num_rows):
            streams, same = [], True
            for name, vocabulary in (("a", a_ids), ("b", b_ids)):
                raw, places = utf8(batch.column(f"{name}_text").slice(k, 1))
                (own,), exact = _exact(raw, places, vocabulary)
                same &= bool(exact[0])
                own = own.astype(np.int64)
                streams += [own, batch.column(f"{name}_start")[k].as_py() + np.cumsum(vocabulary.bytes_of[own])]
            t = Tokens(*streams)
            yield _fragment_row(
                batch.column("row")[k].as_py(), batch.column("doc_id").slice(k, 1), batch.column("chunk")[k].as_py(),
                same, len(t.a), len(t.b), fragment(t, names.size, names.width),
            )


def _numbers(table: pa.Table, name: str, k: int) -> np.ndarray:
    return np.frombuffer(table[name][k].as_buffer(), "<i8")


def _composed(table: pa.Table, names: Pair) -> tuple[Fragment, pa.Table]:
    """The fragment of all rows, in order of their chunks."""
    table = table.take(pc.sort_indices(table, [("chunk", "ascending")]))
    done = None
    for k in range(table.num_rows):
        closed = Groups(table["text"][k].as_py(), table["n_groups"][k].as_py(), _numbers(table, "pairs", k), _numbers(table, "times", k))
        opened = [_numbers(table, x, k) for x in _OPEN]
        own = Fragment(Tokens(*opened[:4]), closed if table["cut"][k].as_py() else None, Tokens(*opened[4:]))
        done = own if done is None else compose(done, own, names.size, names.width)
    return done, table


def _long(docs: DataFrame, names: Pair, long: int) -> DataFrame:
    """The result of texts above ``long`` bytes: stretches spread over tasks, fragments composed by a tree."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    head = f"row long, doc_id {kind}"
    stretches = docs.mapInArrow(lambda batches: _cut(batches, long), f"{head}, {_STRETCH}")
    # Stretches of one text go to different tasks.
    tasks = spark.sparkContext.defaultParallelism * 2
    path = scratch_path(spark, "fragments")
    spread = stretches.repartition(tasks, "row", "chunk")
    spread.mapInArrow(lambda batches: _fragments(batches, names), f"{head}, {_FRAGMENT}").write.parquet(path)
    fragments = spark.read.parquet(path)
    last = fragments.agg(F.max("chunk").alias("last")).collect()[0]["last"] or 0

    def one(table: pa.Table) -> pa.Table:
        x, table = _composed(table, names)
        n_a, n_b = (pc.sum(table[c]).as_py() for c in ("n_a", "n_b"))
        same = pc.all(table["same"]).as_py()
        doc_id = table["doc_id"].slice(0, 1).combine_chunks()
        return pa.Table.from_batches([_fragment_row(table["row"][0].as_py(), doc_id, table["chunk"][0].as_py() // FAN, same, n_a, n_b, x)])

    # The last composition gives the result itself, so a task has one Python worker.
    while last >= FAN:
        fragments = fragments.groupBy("row", F.expr(f"chunk div {FAN}")).applyInArrow(one, f"{head}, {_FRAGMENT}")
        last //= FAN

    def end(table: pa.Table) -> pa.Table:
        x, table = _composed(table, names)
        same = pc.all(table["same"]).as_py()
        done = whole(x, names.size, names.width) if same else NO_GROUPS
        counts = [pc.sum(table[c]).as_py() if same else 0 for c in ("n_a", "n_b")]
        columns = _rows(
            *([c] for c in counts), [done.n], [int(done.times.sum())], [done.text[:-1].decode()],
            [done.pairs.astype("<i8").tobytes()], [done.times.astype("<u4").tobytes()],
        )
        return pa.Table.from_arrays([table["row"].slice(0, 1), table["doc_id"].slice(0, 1), *columns], ["row", "doc_id", *_names()])

    return fragments.groupBy("row").applyInArrow(end, f"{head}, {_RESULT}")


# --- tables ----------------------------------------------------------------------------------


def aligned(docs: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY, long: int = LONG) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any others, which are ignored) with its tokens' groups and links:

    row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, ids in order), pairs
    (distinct links as a * ids of B + b, 64-bit) and times (how often each occurs, 32-bit).

    A text that is null, empty or not given back by either vocabulary has no tokens. Repeated rows and null ids are rows like
    any other. A text above ``long`` bytes is cut where neither vocabulary has a token across; one without such places is
    encoded in one piece. An empty table gives an empty one.
    """
    names = Pair.of(a, b)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = rows.filter(size <= long).mapInArrow(lambda batches: _short(batches, names), f"row long, doc_id {kind}, {_RESULT}")
    return short.unionByName(_long(rows.filter(size > long), names, long))


def link_counts(table: DataFrame, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY) -> DataFrame:
    """(pair, n, best) from ``aligned`` rows: how many rows hold the pair linked, and whether no pair of its A id has more."""
    width = Pair.of(a, b).width

    def run(batches):
        waiting, have = [], 0
        for batch in batches:
            for cell in batch.column("pairs"):
                waiting.append(np.frombuffer(cell.as_buffer(), "<i8"))
                have += len(waiting[-1])
                if have > 4 << 20:
                    yield count(waiting)
                    waiting, have = [], 0
        if waiting:
            yield count(waiting)

    def count(parts: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = table.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    path = scratch_path(table.sparkSession, "links")
    counts.withColumn("a", F.expr(f"pair div {width}")).write.parquet(path)
    counts = table.sparkSession.read.parquet(path)
    # One row per id of A at most.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(table: DataFrame, links: DataFrame, hot: int = HOT) -> DataFrame:
    """``aligned`` rows with n_best (links that are their A id's best) and count_sum (of the links' counts).

    Pairs in more than 1/``hot`` of all (row, pair) entries, fewer than ``hot`` by that, are sent to every task. The other
    entries are joined, and no key of theirs holds more than that share.
    """
    spark = table.sparkSession
    total = links.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    frequent = F.col("n") * hot > total
    found = sorted((r["pair"], r["n"], r["best"]) for r in links.filter(frequent).collect())
    columns = [np.array([r[k] for r in found], t) for k, t in enumerate((np.int64, np.int64, bool))]
    shared = spark.sparkContext.broadcast(columns)
    kept = [c for c in table.columns if c not in ("pairs", "times")]

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            sums, bests, rare, rare_times = [], [], [], []
            for cell, often in zip(batch.column("pairs"), batch.column("times"), strict=True):
                own, times = np.frombuffer(cell.as_buffer(), "<i8"), np.frombuffer(often.as_buffer(), "<u4").astype(np.int64)
                at = np.searchsorted(pair, own)
                known = at < len(pair)
                known[known] = pair[at[known]] == own[known]
                spot, t = at[known], times[known]
                sums.append(int((n[spot] * t).sum()))
                bests.append(int(t[best[spot]].sum()))
                rare.append(own[~known])
                rare_times.append(times[~known])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(rare_times, pa.list_(pa.int64()))],
                [*kept, "n_best", "count_sum", "pair", "t"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in kept)
    path = scratch_path(spark, "counted")
    table.mapInArrow(run, f"{kinds}, n_best long, count_sum long, pair array<long>, t array<long>").write.parquet(path)
    rows = spark.read.parquet(path)
    entries = rows.select("row", F.inline(F.arrays_zip("pair", "t")))
    sums = entries.join(links.filter(~frequent), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("t")).alias("more_sum")
    )
    return rows.join(sums, "row", "left").select(
        *kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )
