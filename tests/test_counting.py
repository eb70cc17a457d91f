import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from reviewlens.operators import counting, phrases, terms


def corpus():
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "b", "Ñu", "quà", " ", "  ", "\t", "\x0b", "\n", " "]) + rng.choice(["", " "]) for _ in range(rng.randrange(20))) for _ in range(80)]
    return [*made, None, "", " ", " x", "x ", "x  x"]


def split(text):
    body = text.lower().rstrip(" \t\n\x0b\f\r")
    if body == "" and text != "":
        return []
    for blank in "\t\n\x0b\f\r":
        body = body.replace(blank, " ")
    return body.split(" ")


def test_words_and_pairs_equal_plain_counts_in_pieces_of_any_size(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "cmt string").repartition(2)
    lists = [split(t) for t in texts if t is not None]
    n, held = Counter(w for ws in lists for w in ws), Counter(w for ws in lists for w in set(ws))
    assert {r.term: (r.n, r.df) for r in terms.term_stats(docs).collect()} == {w: (n[w], held[w]) for w in n}
    monkeypatch.setattr(counting, "PIECE", 7)
    for ordered in (True, False):
        for empty in (True, False):
            kept = [[w for w in ws if w or empty] for ws in lists]
            want = Counter((w, None) for ws in kept for w in ws)
            for d in (1, 2):
                pairs = [p for ws in kept for p in zip(ws, ws[d:], strict=False)]
                want.update(pairs if ordered else [tuple(sorted(p, key=str.encode)) for p in pairs])
            got = counting.pair_counts(docs, terms.spaced("cmt"), [1, 2], ordered, empty).collect()
            assert {(r.a, r.b): r.n for r in got} == dict(want)


def test_no_row_is_made_of_every_word(spark):
    docs = spark.createDataFrame([("a b a b c",), ("a b",)], "cmt string")
    assert "Generate" not in terms.term_stats(docs)._jdf.queryExecution().executedPlan().toString()
    found = phrases.learn_phrases(docs, discount=0, threshold=0.0).select("a", "b", "n_ab", "n_a", "n_b").collect()
    assert {tuple(r) for r in found} == {("a", "b", 3, 3, 3), ("b", "a", 1, 3, 3), ("b", "c", 1, 3, 1)}


def test_pairs_come_in_small_batches_of_small_pieces(monkeypatch):
    """A task holds the pairs of one piece, the smaller the more distances, and hands over some rows of them at a time."""
    monkeypatch.setattr(counting, "PIECE", 5_000)
    monkeypatch.setattr(counting, "ROWS", 100)
    rng = random.Random(1)
    texts = pa.array([" ".join(f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(300)])
    for distances in ([1], range(1, 6)):
        found = list(counting._counted(texts, distances, False, True, None))
        pieces = [b for b in found if b.column("b").null_count]
        assert len(pieces) >= len(distances) * texts.nbytes // 6_000
        assert max(b.num_rows for b in found if not b.column("b").null_count) <= 100
        n = Counter()
        for b in found:
            for r in b.to_pylist():
                n[r["a"], r["b"]] += r["n"]
        want = Counter((w, None) for t in texts.to_pylist() for w in t.split(" "))
        for t in texts.to_pylist():
            for d in distances:
                want.update(tuple(sorted(p)) for p in zip(t.split(" "), t.split(" ")[d:], strict=False))
        assert n == want


def test_rare_pairs_are_not_shuffled_as_text(spark):
    rows = [(" ".join(f"w{i}x{k}" for k in range(20)) + "  a b\ta b",) for i in range(30)] + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "cmt string").repartition(3)
    found = {(r.a, r.b): r.n for r in counting.pair_counts(docs, F.col("cmt"), [1], True, False, least=6).collect()}
    assert {p: n for p, n in found.items() if p[1] is not None} == {("a", "b"): 60, ("b", "a"): 30}
    assert found["a", None] == 60 and found["w3x4", None] == 1 and ("", None) not in found


def test_terms_of_texts_equal_plain_counts(spark, monkeypatch):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, cmt string").repartition(2)
    want = Counter((i, len(split(t)), w) for i, t in enumerate(texts) if t is not None for w in split(t))
    for size in (counting.PIECE, 9):
        monkeypatch.setattr(counting, "PIECE", size)
        found = counting.text_terms(rows.select("row", terms.spaced("cmt").alias("text")))
        assert {(r.row, r.length, r.term): r.tf for r in found.collect()} == dict(want)
