"""Token ids of whole texts with a public byte-level BPE vocabulary.

Texts repeat words, so a block of texts is cut into chunks, each distinct chunk is encoded once and
its ids are copied to every place. A chunk begins at a space or line break between two characters
that are no white space; the vocabulary's pre-tokenizer always begins a new piece there, so the ids
equal those of the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from reviewlens.llm.words import _BYTE, U64, _powers, mix, utf8

BLOCK = 2 << 20
CACHE = 300_000  # distinct chunks remembered by a task; beyond, it starts anew
SPECIAL = "<|endoftext|>"

# First bytes of UTF-8 sequences that may be white space beyond ASCII, and all ASCII up to the space.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[: 0x21] = True
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Ids:
    """Encoder for the vocabulary file ``name`` of the public tokenizers (``.json``, with its ranks beside it)."""

    def __init__(self, name: str = "byte_bpe_50k.json") -> None:
        self.name = name
        lines = Path(public_tokenizers.path(name.replace(".json", ".tiktoken"))).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)
        self._forget()

    @cached_property
    def whole(self) -> Tokenizer:
        """The tokenizer itself, for texts that spell out a special token; few do, and it is large."""
        return Tokenizer.from_file(public_tokenizers.path(self.name))

    def _encode(self, text: bytes) -> np.ndarray:
        return self.ranks.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=())

    def _forget(self) -> None:
        self.known, self.pool = np.zeros(0, U64), np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray, alone: np.ndarray, text: bytes) -> None:
        """Encode the chunks ``begin:end`` of ``text`` and remember their ids by key."""
        parts = [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ids = self._encode(b"".join(p for p, a in zip(parts, alone.tolist(), strict=True) if not a))
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum((end - begin)[~alone])) + 1
        length = np.zeros(len(keys), np.int64)
        length[~alone] = np.diff(ends, prepend=0)
        singles = [self._encode(parts[k]) for k in np.flatnonzero(alone).tolist()]
        length[alone] = [len(x) for x in singles]
        start = np.zeros(len(keys), np.int64)
        start[~alone] = ends - length[~alone]
        start[alone] = len(ids) + np.cumsum(length[alone]) - length[alone]
        start += len(self.pool)
        self.pool = np.concatenate([self.pool, ids, *singles])
        order = np.argsort(known := np.concatenate([self.known, keys]), kind="stable")
        self.known = known[order]
        self.start, self.length = (np.concatenate(x)[order] for x in ((self.start, start), (self.length, length)))

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text; null is empty."""
        raw, places = utf8(column)
        n, at = len(places) - 1, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(places, places[at] + BLOCK, side="right")) - 1)
            yield from self._block(raw[places[at] : places[to]], places[at : to + 1] - places[at])
            at = to

    def _block(self, raw: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
        n = len(raw)
        blank = (raw == 0x20) | (raw == 0x0A)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            lead, maybe = _LEAD[raw], _MAYBE_SPACE[raw]
            before = maybe.copy()  # the character before may be white space
            before[1:] |= lead[:-1]
            before[2:] |= lead[:-2]
            cut[1 : n - 1] = blank[1:-1] & ~before[:-2] & ~maybe[2:]
        clean = cut.copy()
        cut[places] = True
        begin = np.flatnonzero(cut[:n])
        end = np.append(begin[1:], n) if len(begin) else begin
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin])
        # First and last chunks of texts are encoded alone, the rest in one run: joined, chunks keep their limits.
        alone = ~(clean[begin] & clean[end])
        hashes[alone] = mix(hashes[alone] + U64(1))
        keys, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        text = raw.tobytes()
        if len(self.known) > CACHE:
            self._forget()
        new = np.isin(keys, self.known, assume_unique=True, invert=True)
        self._learn(keys[new], begin[first[new]], end[first[new]], alone[first[new]], text)
        slot = np.searchsorted(self.known, keys)[where]
        starts, lengths = self.start[slot], self.length[slot]
        place = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(lengths, out=place[1:])
        flat = self.pool[np.repeat(starts - place[:-1], lengths) + np.arange(place[-1])]
        bounds = place[np.searchsorted(begin, places)]
        special = SPECIAL.encode() in text
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if special and SPECIAL.encode() in (own := text[places[i] : places[i + 1]]):
                yield np.array(self.whole.encode(own.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            else:
                yield flat[a:b]
