import random
import re
from collections import Counter

from reviewlens.llm import decontaminate as d


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(w, size):
    return [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]


def brute(docs, items):
    own = {i: words_of(t) for i, t in items if words_of(t)}
    size = {i: min(5, len(w)) for i, w in own.items()}
    held = Counter(g for i, w in own.items() for g in set(grams(w, size[i])))
    out = []
    for doc, text in docs:
        w = words_of(text)
        for i, item in own.items():
            best = None
            for start in range(max(0, len(w) - len(item)) + 1):
                a, b = Counter(grams(item, size[i])), Counter(grams(w[start : start + len(item)], size[i]))
                both = sum(n / held.get(g, 1) for g, n in (a & b).items())
                all_ = sum(n / held.get(g, 1) for g, n in (a | b).items())
                if both / all_ >= 0.8 - 1e-12 and (best is None or both / all_ > best[0] + 1e-9):
                    best = both / all_, start, min(len(item), len(w))
            if best:
                out.append((doc, i, round(best[0], 6), best[1], best[2]))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ñu"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 6, 20, 35, 60])))) for k in range(25)]
    items += [(25, items[5][1]), (26, None), (27, ""), (28, items[6][1] + " " + items[7][1])]
    docs = []
    for k in range(110):
        w = rng.choices(vocabulary, k=rng.choice([1, 3, 50, 300]))
        for _ in range(rng.choice([0, 1, 2])):
            part = (rng.choice(items)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(max(1, len(part)))
                part[at : at + 1] = rng.choice([[], ["new"], [*part[at : at + 1], "more"]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).upper() if k % 3 else " ".join(w)))
    return docs, items


def test_matches_equal_brute_force(spark):
    docs, items = corpus(4)
    docs += [(200, None), (201, ""), (203, "..."), (202, items[10][1]), (202, items[10][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as matches").repartition(3)
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 6), r.start, r.n_words) for r in d.matches(rows, benchmark).collect()), key=str)
    want = brute(docs, items)
    assert len(want) > 30
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == want
    kept = d.clean(rows, benchmark)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})


def test_items_in_several_passes(spark, monkeypatch):
    docs, items = corpus(9)
    monkeypatch.setattr(d, "ITEMS", 4)
    benchmark, rows = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    # Shingle weights are those of a pass; whole items are found in any.
    found = {(r.doc_id, r.item_id) for r in d.matches(rows, benchmark).collect()}
    exact = {(i, k) for i, t in docs for k, item in items if item and f" {' '.join(words_of(item))} " in f" {' '.join(words_of(t))} "}
    assert exact <= found


def test_every_fingerprint_in_the_radius_is_found():
    rng = random.Random(1)
    items = [(k, " ".join(f"v{rng.randrange(40)}" for _ in range(12))) for k in range(80)]
    index = d.Index(items, 5, 0.8)
    own = index.by_length[12][1]
    probe = own[:40] ^ d.np.random.default_rng(2).integers(0, 256, (40, 8), dtype=d.np.uint8) & d.np.random.default_rng(3).integers(0, 256, (40, 8), dtype=d.np.uint8)
    for p, found in zip(probe, index.near(12, probe), strict=True):
        assert set(found.tolist()) == set(d.np.flatnonzero(d.np.bitwise_count(own ^ p).sum(1) <= d.RADIUS).tolist())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.matches(docs, none).collect() == [] and d.clean(docs, none).count() == 1
    assert d.matches(docs.limit(0), none.union(docs)).collect() == []


def plain_matches(docs, items):
    out = set()
    for doc, text in docs:
        w = words_of(text)
        for i, item in items:
            item = words_of(item)
            a = Counter(grams(item, 5))
            for start in range(max(0, len(w) - len(item)) + 1):
                b = Counter(grams(w[start : start + len(item)], 5))
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    out.add((doc, i))
    return out


def repeated_items():
    rng = random.Random(12)
    once = [f"a{k}" for k in range(59)]
    shared = [f"b{k}" for k in range(54)]
    twice = [f"c{k}" for k in range(59)]
    items = [(k, " ".join(once)) for k in range(20)] + [(20 + k, " ".join([*shared, f"own{k}"])) for k in range(10)] + [(30 + k, " ".join(twice)) for k in range(2)]
    docs = []
    for k in range(60):
        part = list(rng.choice([once, [*shared, f"own{k % 10}"], twice]))
        part[rng.choice([-1, len(part) // 2])] = f"edit{k}"
        docs.append((k, " ".join([*(f"x{k}y{i}" for i in range(9)), *part, *(f"z{k}y{i}" for i in range(9))])))
    return docs, items


def test_edited_copies_of_repeated_items_are_found(spark):
    docs, items = repeated_items()
    rows, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches(docs, items)
    assert {i for i, _ in want} == set(range(60))
    assert want <= {(r.doc_id, r.item_id) for r in d.matches(rows, benchmark).collect()}
    assert d.clean(rows, benchmark).count() == 0


def test_fingerprints_lose_no_window_that_is_similar():
    rng = random.Random(3)
    lost = 0
    for trial in range(40):
        shared = [f"s{trial}w{rng.randrange(10**6)}" for _ in range(54)]
        index = d.Index([(k, " ".join(shared)) for k in range(10)], 5, 0.8)
        column = d.pa.array([" ".join([*shared[:-1], f"new{trial}"])])
        _, _, w = next(d.blocks(column, d.NON_ALNUM))
        grams_ = d._rolled(w.hash, 5)
        hits = {k: [p for p, g in enumerate(grams_.tolist()) if g in index.items[k][3]] for k in range(10)}
        found = {k for k, *_ in index.text(w.hash, hits)}
        lost += sum(d.np.max(index.similar(k, grams_)) >= 0.8 and k not in found for k in range(10))
    assert lost == 0


def test_number_of_passes_does_not_change_rows(spark, monkeypatch):
    for docs, items in (corpus(9), repeated_items()):
        benchmark, rows = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
        one = sorted(map(tuple, d.matches(rows, benchmark).collect()), key=str)
        kept = sorted(r.doc_id for r in d.clean(rows, benchmark).collect())
        with monkeypatch.context() as m:
            m.setattr(d, "ITEMS", -(-len(items) // 4))
            assert sorted(map(tuple, d.matches(rows, benchmark).collect()), key=str) == one
            assert sorted(r.doc_id for r in d.clean(rows, benchmark).collect()) == kept
