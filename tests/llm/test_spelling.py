import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlens.llm import spelling as sp


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@settings(deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12), st.sets(st.text("abcé😀", min_size=1, max_size=7), min_size=1, max_size=12))
def test_a_tile_finds_just_the_single_edits(left, right):
    left, right = sorted(left), sorted(right)
    near, _ = sp.near_in_tile(pa.array(left), pa.array(right))
    assert near.tolist() == [[one_edit(a, b) for b in right] for a in left]


def counted(rows, noise=199, length=6, least=5):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def expected(counts, times=5):
    out = set()
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def texts():
    rng = random.Random(17)
    base = ["".join(rng.choices("abcdeéßÀ", k=rng.randrange(5, 11))) for _ in range(60)] + ["banana", "Banane", "bananas", "ÀÉÎÕÜ×÷", "a" * 400, "a" * 401]
    spelled = list(base)
    for w in base:
        k = rng.randrange(len(w))
        spelled += [w[:k] + w[k + 1 :], w[:k] + rng.choice("xyz") + w[k:], w[:k] + "q" + w[k + 1 :]]
    weights = [rng.choice([1, 2, 30, 200]) for _ in spelled]
    return [(k, rng.choice(["", "1 "]) + rng.choice([" ", "-", "ı", "\n"]).join(rng.choices(spelled, weights, k=40))) for k in range(200)]


def check(spark, rows, group=sp.GROUP, noise=199):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = sp.variants(sp.words(docs, noise), group=group)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows_found = [tuple(r) for r in got.collect()]
    want = expected(counted(rows, noise))
    assert len(rows_found) == len(set(rows_found)) and set(rows_found) == want
    return want


def test_words_forms_and_roots_equal_plain_loops(spark):
    rows = [*texts(), (None, "Bananas " * 9), (None, None), (500, ""), (501, "12 ?"), (3, "banana " * 40), (3, "banana " * 40)]
    want = check(spark, rows, noise=7)
    assert any(form for _, form, *_ in want)


def test_roots_lie_at_the_end_of_long_chains(spark):
    counts = {"chains" + "abcdefghijk"[:k]: 5 ** (13 - k) for k in range(11)} | {"ties" + x: n for x, n in (("yy", 50), ("yz", 50), ("y", 10))}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = expected(counts)
    assert {tuple(r) for r in sp.variants(table).collect()} == want
    assert ("chainsabcdefghij", "chainsabcdefghi", "chains", 125, 1, 625) in want and ("tiesy", "tiesyy", "tiesyy", 10, 2, 50) in want


def test_groups_split_down_lose_and_repeat_no_pair(spark):
    check(spark, texts(), group=2, noise=7)


def test_words_that_share_all_but_one_letter(spark):
    """All near each other: one group that no split makes smaller than its last letter allows."""
    letters = "abcdefghijklmnopqrstuvwxyzéßà"
    rows = [(k, " ".join(f"prefixes{x}" for x in letters) + " prefixes " + " ".join(f"{x}prefixes" for x in letters)) for k in range(6)]
    check(spark, rows, group=4)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sp.variants(sp.words(empty, 199)).collect() == []


def test_whole_long_texts(spark):
    long = "word" * 3 + " " + "filler " * 50_000 + ("ending " * 5)
    check(spark, [(1, long), (2, "endings " * 5)])
