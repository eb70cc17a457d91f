import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewlens.llm import suffix_tree as s


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed, n):
    rng = random.Random(seed)
    parts = ["ka", "ti", "mo", "re", "ñu", "É"]
    return [(k, " ".join("".join(rng.choices(parts, weights=[9, 5, 4, 3, 2, 1], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60)))) for k in range(n)]


def test_base_equals_plain_counts_and_model_beats_it(spark):
    rows = [*corpus(1, 150), (300, None), (301, ""), (302, " \n"), (303, "zz9 zz9 \x00x"), (303, "zz9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h").repartition(3)
    out = s.scores(docs, F.col("doc_id") % 3 != 0, hot=40).collect()
    count = Counter(w for i, t in rows if i % 3 for w in words_of(t))
    ends = sum(1 for i, _ in rows if i % 3)
    n, v = sum(count.values()) + ends, len(count) + 1
    want = {}
    for i, t in rows:
        c = [count[w] for w in words_of(t)] + [ends]
        want.setdefault(i, []).append((len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, r.train_tokens, r.base_score))
    assert {i: sorted((*x[:3], round(x[3], 7)) for x in v) for i, v in got.items()} == {i: sorted((*x[:3], round(x[3], 7)) for x in v) for i, v in want.items()}
    held = [r for r in out if r.doc_id % 3 == 0 and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    broadcast_all = {(r.doc_id, r.n_tokens): r for r in s.scores(docs, F.col("doc_id") % 3 != 0).collect()}
    assert all(abs(r.score - broadcast_all[r.doc_id, r.n_tokens].score) < 1e-7 for r in out)


def _brute_counts(words):
    found = Counter()
    for w, c in words.items():
        text = b" " + w.encode() + b" "
        for at in range(1, len(text)):
            for d in range(min(s.DEPTH, at) + 1):
                key = d << 48 | int.from_bytes(text[at - d : at], "big")
                found[key << 8 | text[at]] += c
                found[key << 8 | s.TOTAL] += c
    return found


def test_counts_tree_and_probabilities(spark):
    words = Counter(w for _, t in corpus(2, 200) for w in words_of(t))
    frame = spark.createDataFrame(list(words.items()), "word string, c long")
    got = {r.gram: r.n for r in s.ngram_counts(frame).collect()}
    want = _brute_counts(words)
    assert got == dict(want)
    tree = s.grow(np.array(list(want), np.uint64), np.array(list(want.values())))
    assert 1 < len(tree.states) < len({k >> 8 for k in want})
    # Longest suffix by hand, and every state's distribution adds up to one.
    p = dict(zip(tree.grams.tolist(), tree.probability.tolist(), strict=True))
    left = dict(zip(tree.states.tolist(), tree.left.tolist(), strict=True))

    def predict(context, symbol):
        d, value = 0, 1 / 256
        while d <= len(context):
            key = d << 48 | int.from_bytes(context[len(context) - d :], "big")
            if key not in left:
                break
            value = p.get(key << 8 | symbol, left[key] * value)
            d += 1
        return value

    for context in (b"", b" ", b" k", b"ka", b" kati", b"zz"):
        assert abs(sum(predict(context, x) for x in range(256)) - 1) < 1e-9
    probe = ["ka", "katimo", "zzz", "ñu", "a" * 300]
    for w, got_log in zip(probe, tree.log10(pa.array(probe)), strict=True):
        text = b" " + w.encode() + b" "
        want_log = sum(math.log10(predict(text[max(0, at - s.DEPTH) : at], text[at])) for at in range(1, len(text)))
        assert abs(got_log - want_log) < 1e-9


def test_divergence_prunes_contexts_that_say_nothing():
    rng = random.Random(5)
    words = Counter()
    for _ in range(4000):
        w = rng.choice("ab")
        while rng.random() < 0.8:
            w += rng.choice("ab")
        words[w] += 1
    want = _brute_counts(words)
    grams, n = np.array(list(want), np.uint64), np.array(list(want.values()))

    def inner(tree):
        return [c for c in tree.states.tolist() if c >> 48 >= 2 and s.SPACE not in (c & (1 << 48) - 1).to_bytes(6, "big")]

    assert inner(s.grow(grams, n, divergence=-1.0)) and not inner(s.grow(grams, n))


def test_empty_and_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "a")], "doc_id long, text string")
    out = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in s.scores(docs, F.lit(None).cast("boolean")).collect())
    assert out == [(2, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert s.scores(docs.limit(0), F.lit(True)).collect() == []


def test_tree_grown_by_spark_equals_the_one_from_all_counts(spark):
    words = Counter(w for _, t in corpus(2, 200) for w in words_of(t))
    want = _brute_counts(words)
    tree = s.grow(np.array(list(want), np.uint64), np.array(list(want.values())))
    got = s.grown(spark.createDataFrame([(int(k), n) for k, n in want.items()], "gram long, n long"))
    assert got.states.tolist() == tree.states.tolist() and got.grams.tolist() == tree.grams.tolist()
    assert np.allclose(got.left, tree.left) and np.allclose(got.probability, tree.probability)


def test_rare_contexts_are_learned_however_large_the_corpus(spark):
    rows = [(0, "aaaaaaaa " * 300_000), (1, "qxz qxzq xzqx"), (2, "qxzqx"), (3, "zxqxq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in s.scores(docs, F.col("doc_id") < 2).collect()}
    assert score[2] > score[3] + 1e-9


def _by_hand(texts, log10_of, divergence=s.DIVERGENCE):
    """log10 probability of a sequence of symbols under the tree over words, from plain counts."""
    grams = [Counter() for _ in range(s.WORDS + 1)]
    for t in texts:
        for at in range(len(t)):
            for d in range(min(at, s.WORDS) + 1):
                grams[d][tuple(t[at - d : at + 1])] += 1
    kept = {}

    def prob(context, symbol):
        if not context:
            return 10 ** log10_of(symbol)
        if context not in kept:
            return prob(context[1:], symbol)
        total, kinds = kept[context]
        return (max(grams[len(context)][*context, symbol] - 1, 0) + kinds * prob(context[1:], symbol)) / total

    for d in range(1, s.WORDS + 1):
        following = {}
        for g, n in grams[d].items():
            following.setdefault(g[:-1], {})[g[-1]] = n
        for context, nexts in following.items():
            before = {x: prob(context[1:], x) for x in nexts}
            total, kinds = sum(nexts.values()), len(nexts)
            if max(nexts.values()) > 1:
                other = {x: (max(n - 2, 0) + (kinds - (n == 1)) * before[x]) / (total - 1) for x, n in nexts.items()}
                if sum(n * math.log(other[x] / before[x]) for x, n in nexts.items()) > divergence:
                    kept[context] = total, kinds
    return kept, lambda t: sum(math.log10(prob(tuple(t[max(0, at - s.WORDS) : at]), t[at])) for at in range(len(t)))


def test_scores_follow_the_order_of_words(spark, monkeypatch):
    rng = random.Random(7)
    known = [f"w{i}" for i in range(30)]
    texts = [" ".join(x for _ in range(rng.randrange(1, 12)) for x in rng.choice([["red", "fox", "runs"], ["old", "fox", "sleeps"], [rng.choice(known)]])) for _ in range(150)]
    probe = ["red fox runs w3", "old fox runs w3", "runs fox red w3", "w1", "", "red fox new"]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(probe))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") < 1000
    got = {r.doc_id: r.score for r in s.scores(docs, learn).collect()}
    # Without states the score is the sum of single words' values, each of which a text of that word and the end give.
    alone = spark.createDataFrame([*enumerate(texts), *((1000 + i, w) for i, w in enumerate([*known, "red", "fox", "runs", "old", "sleeps", "new", ""]))], "doc_id long, text string")
    none = spark.createDataFrame([], "context long, left double"), spark.createDataFrame([], "key long, n long, value double")
    monkeypatch.setattr(s, "states", lambda *_: none)
    plain = {r.doc_id: r.score for r in s.scores(alone, learn).collect()}
    values = dict(zip([*known, "red", "fox", "runs", "old", "sleeps", "new", ""], (plain[1000 + i] for i in range(len(known) + 7)), strict=True))
    kept, want = _by_hand([(*words_of(t), "") for t in texts], lambda w: values[w] - (values[""] if w else 0))
    assert ("red", "fox") in kept and ("w1",) not in kept and got[1000] > got[1002]
    assert all(abs(got[1000 + i] - want((*words_of(t), ""))) < 1e-9 for i, t in enumerate(probe))
    assert all(abs(got[i] - want((*words_of(t), ""))) < 1e-9 for i, t in enumerate(texts))


def test_tables_reach_the_driver_as_columns(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(5, 60), "doc_id long, text string")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: 1 / 0)
    assert s.scores(docs, F.col("doc_id") % 3 != 0).count() == 60
