import random

import pytest

from reviewlens.llm import jaccard


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split() if t else []
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((top(i), top(j)))
                    up[b] = a
    return sorted((i, len(s), top(i)) for i, s in sets.items())


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([2, 5, 9, 14, 20, 40, 90, 200, 600]))
        for _ in range(rng.choice([1, 2, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], rng.choice(vocabulary)]])
            if rng.random() < 0.2:
                copy = passage + copy
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n"), (len(rows) + 3, "Ä B"), (len(rows) + 4, "Ä b")]


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 512), (5, 80, 512), (2, 80, 6)])
def test_components_equal_brute_force(spark, words, percent, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.classes(docs, words, percent, block).collect())
    assert got == brute(rows, words, percent)


def test_large_group_of_near_copies_in_blocks(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in jaccard.classes(docs, 4, 85, 10).collect())
    assert got == brute(rows, 4, 85)


def test_empty_table_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, sig string, tree int")
    assert jaccard.classes(empty).collect() == []
    text = " ".join(f"a{k}" for k in range(80))
    other = " ".join(f"b{k}" for k in range(80))
    rows = [(1, text, "x"), (1, text, "x"), (1, other, "y"), (None, other + " c", "z"), (None, None, None)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 0, None), (-1, 77, 1), (1, 76, 1), (1, 76, 1), (1, 76, 1)]


def test_traversal_keeps_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 7, 30, 300, 5000)]
    sets = []
    for b in base * 6:
        keep = rng.random(len(b)) > rng.choice([0, 0.02, 0.08])
        sets.append(np.unique(np.append(b[keep], rng.integers(0, 2**63, 1, dtype=np.uint64))))
    tree = jaccard.SignatureTree(sets)
    pairs = {tuple(sorted(p)) for xs, ys in jaccard._pairs(tree, tree, 80) for p in zip(xs.tolist(), ys.tolist(), strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard.linked(sets[i], sets[j], 80)}
    assert {tuple(sorted(p)) for p in want} <= pairs
