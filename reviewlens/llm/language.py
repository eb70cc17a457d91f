"""Language identification by nearest centroid.

A text is the TF-IDF vector of its letter n-grams (one to three), hashed to a fixed width and scaled to
length 1. Every language has several centroids, found by clustering labelled texts by cosine. The
nearest centroid names the language; a text farther from it than any labelled text of its length is rejected.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.words import utf8

WIDTH = 4096
CENTROIDS = 4
ROUNDS = 12
SAMPLE = 1500  # expected labelled texts per language that the clustering sees; document frequencies see all
LANGUAGES = 4096  # more are refused
MARGIN = 0.6  # share of the least similarity of labelled texts below which a text is rejected
UNKNOWN = "und"
ROWS, BYTES = 512, 1 << 20  # texts turned into vectors at once
PART_ROWS, PART = 64, 1 << 17  # of these, texts whose n-grams are listed at once: a list is many times its text

# Letters keep their byte, lower-cased, all other ASCII becomes a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams; runs of other characters count as one space."""
    data = _FOLD[raw]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    data[after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20  # À..Þ to à..þ
    row = np.repeat(np.arange(len(places) - 1), np.diff(places))
    keep = data != 0x20
    keep[:-1] |= (data[1:] != 0x20) & (row[1:] == row[:-1])  # the space before a letter
    data, row = data[keep].astype(np.uint32), row[keep]
    one = data * np.uint32(0xC2B2AE35) + np.uint32(0x165667B1)
    two = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA6B)
    three = two[: max(0, len(data) - 2)] + data[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    rows, buckets = [], []
    for gram, own, last in ((one, row, row), (two, row[:-1], row[1:]), (three, row[:-2], row[2:])):
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        same = own == last
        rows.append(own[same])
        buckets.append((gram[same] >> np.uint32(20)).astype(np.int64) % WIDTH)
    return np.concatenate(rows), np.concatenate(buckets)


def counts(column: pa.Array):
    """(from row, to row, counts of the buckets by row, number of ASCII letters by row) over a column."""
    raw, places = utf8(column)
    n, at = len(places) - 1, 0
    while at < n:
        to = max(at + 1, min(at + ROWS, int(np.searchsorted(places, places[at] + BYTES, side="right")) - 1))
        found, letters, a = np.zeros((to - at, WIDTH), np.int32), np.zeros(to - at, np.int64), at
        while a < to:
            b = max(a + 1, min(to, a + PART_ROWS, int(np.searchsorted(places, places[a] + PART, side="right")) - 1))
            own, limits = raw[places[a] : places[b]], places[a : b + 1] - places[a]
            letters[a - at : b - at] = np.diff(np.concatenate([[0], np.cumsum((_FOLD[own] > 0x20) & (own < 0x80))])[limits])
            row, bucket = _grams(own, limits)
            found[a - at : b - at] = np.bincount(row * WIDTH + bucket, minlength=(b - a) * WIDTH).reshape(b - a, WIDTH)
            a = b
        yield at, to, found, letters
        at = to


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = found.astype(np.float32)
    np.log1p(v, out=v)
    v *= idf
    length = np.sqrt((v * v).sum(1, keepdims=True))
    v /= np.where(length > 0, length, 1)
    return v


def _length(found: np.ndarray) -> np.ndarray:
    """Length class of texts: doublings of the number of n-grams."""
    return np.log2(found.sum(1) + 1).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class Model(NamedTuple):
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    least: np.ndarray  # similarity needed, by length class


def _cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starts; fewer centroids where texts agree."""
    centres = [v.mean(0)]
    near = v @ centres[0]
    while len(centres) < min(k, len(v)):
        centres.append(v[int(np.argmin(near))])
        near = np.maximum(near, v @ centres[-1])
    c = np.stack(centres)
    for _ in range(ROUNDS):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fit(docs: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, margin: float = MARGIN) -> Model:
    """Learn from ``docs`` (doc_id, text, lang). Rows without language, text or letters teach nothing.

    Document frequencies cover all rows, repeated ones each time. Each language is clustered in one task, over at most about
    ``sample`` of its distinct texts chosen by a hash of the text, however many rows it has. What reaches the driver is WIDTH
    numbers per centroid.
    """
    rows = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")

    def frequencies(batches):
        seen, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for at, to, found, _ in counts(batch.column("text")):
                seen += (found > 0).sum(0)
                n += to - at
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH), pa.int32()), pa.array(np.concatenate([[n], seen]))], ["bucket", "df"])

    df = rows.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    n, seen = 0, np.zeros(WIDTH)
    for bucket, value in df:
        if bucket < 0:
            n = value
        else:
            seen[bucket] = value
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)

    per_lang = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(per_lang) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not per_lang:
        return Model(idf, [], np.zeros((0, WIDTH), np.float32), np.zeros(64))
    of_lang = F.create_map(*(F.lit(x) for r in per_lang for x in (r["lang"], r["count"])))
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    chosen = rows.filter(share * of_lang[F.col("lang")] < sample).select("lang", "text").distinct()

    def cluster(table: pa.Table) -> pa.Table:
        v, length = map(np.concatenate, zip(*((vectors(f, idf), _length(f)) for _, _, f, _ in counts(table.column("text"))), strict=True))
        v, length = v[length > 0], length[length > 0]
        if not len(v):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float32())), "least": pa.array([], pa.list_(pa.float32()))})
        c = _cluster(v, centroids)
        near = (v @ c.T).max(1)
        least = [float(near[length == k].min()) if (length == k).any() else 2.0 for k in range(64)]
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c)), "centroid": pa.array(list(c), pa.list_(pa.float32())), "least": pa.array([least] * len(c), pa.list_(pa.float32()))})

    learned = chosen.groupBy("lang").applyInArrow(cluster, "lang string, centroid array<float>, least array<float>").collect()
    learned = sorted(learned, key=lambda r: (r.lang, r.centroid))
    least = np.min([r.least for r in learned], axis=0) if learned else np.full(64, 2.0)
    # A length no labelled text has needs as little as any shorter or longer one.
    least = np.where(least > 1, least.min(), least) * margin
    return Model(idf, [r.lang for r in learned], np.array([r.centroid for r in learned], np.float32).reshape(-1, WIDTH), np.where(least > 1, 0, least))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) per row of ``docs`` (doc_id, text).

    lang_pred is the language of the nearest centroid (of equals, the first in order) and score its
    cosine. A text that is null or has no letter, or any text if nothing was learned, is ``und`` with
    score 0. rejected holds for these and for texts too far from every centroid.
    """

    def run(batches):
        for batch in batches:
            column, lang, score, rejected = batch.column("text"), [], [], []
            for at, to, found, ascii_letters in counts(column):
                if not model.langs:
                    lang += [UNKNOWN] * (to - at)
                    score += [0.0] * (to - at)
                    rejected += [True] * (to - at)
                    continue
                near = vectors(found, model.idf) @ model.centroids.T
                best = np.argmax(near, axis=1)
                top = np.clip(near[np.arange(to - at), best].astype(float), 0, 1)
                far = top < model.least[_length(found)]
                for i, (b, s, r) in enumerate(zip(best.tolist(), top.tolist(), far.tolist(), strict=True)):
                    letters = ascii_letters[i] or has_letter(column[at + i].as_py())
                    lang.append(model.langs[b] if letters else UNKNOWN)
                    score.append(s if letters else 0.0)
                    rejected.append(r or not letters)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def training_rows(docs: DataFrame):
    """Condition of the rows that may be learned from; a null doc_id has no checksum and is not among them."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0
