import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, Tokenizer

from reviewlens.operators import vectors as ve
from reviewlens.operators import wordtables as wt
from reviewlens.operators.features import feature_pipeline

WORDS = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(40)], k=rng.randrange(3, 30))), "x") for k in range(200)]
    rows += [(900, "", "x"), (901, None, "x"), (902, "unseen words only", "x"), (3, rows[3][1], "x")]
    return spark.createDataFrame(rows, "id long, cmt string, row string").repartition(3)


def test_counts_equal_the_ml_vectorizer(spark, table):
    full = table.filter("cmt IS NOT NULL")
    model = wt.TermCounts(vocabSize=25, minDF=5).fit(full)
    ranked = {r["term"]: r["rank"] for r in model.table.collect()}
    assert sorted(ranked.values()) == list(range(25))
    theirs = Pipeline(stages=[Tokenizer(inputCol="cmt", outputCol="words"), CountVectorizer(inputCol="words", outputCol="v", vocabSize=40, minDF=5)]).fit(full)
    names = theirs.stages[1].vocabulary
    for r in theirs.transform(model.transform(full)).collect():
        want = {ranked[names[i]]: x for i, x in zip(r["v"].indices, r["v"].values, strict=True) if names[i] in ranked}
        assert r["features_vec"].size == 25
        assert dict(zip(r["features_vec"].indices.tolist(), r["features_vec"].values.tolist(), strict=True)) == want
    assert model.transform(table).columns == ["id", "cmt", "row", "features_vec"]
    empty = {r["id"]: r["features_vec"] for r in model.transform(table).filter("id >= 900").collect()}
    assert all(v.size == 25 and not len(v.indices) for v in empty.values()) and len(empty) == 3
    assert model.transform(table).count() == 204


@pytest.mark.parametrize("kind", ["termcount", "wordvectors"])
def test_stored_pipelines_give_the_same_features(spark, table, kind, tmp_path):
    model = feature_pipeline(kind, 6).fit(table)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    one, two = ({r["id"]: r["features"].toArray().tolist() for r in m.transform(table).collect()} for m in (model, again))
    assert one == two and all(len(v) == 6 for v in one.values()) and any(any(v) for v in one.values())


def test_cooccurrences_by_plain_loops(table):
    seen, near = Counter(), Counter()
    for r in table.collect():
        words = (r["cmt"] or "").split()
        seen.update(words)
        for i, a in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    near[a, words[j]] += 1
    want = {(a, b): (n, seen[a], seen[b]) for (a, b), n in near.items() if seen[a] >= 9 and seen[b] >= 9}
    got = {(r["a"], r["b"]): (r["n"], r["n_a"], r["n_b"]) for r in ve.cooccurrences(table, window=2, least=9).collect()}
    assert got == want


def dense(entries):
    rows = entries.collect()
    names = sorted({r["a"] for r in rows})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names.index(r["a"]), names.index(r["b"])] = r["value"]
    return names, m


def test_subspace_and_values_equal_numpys(table):
    entries = ve.information(ve.cooccurrences(table, window=2, least=5))
    names, m = dense(entries)
    assert np.allclose(m, m.T)
    found, values = ve.leading(entries, 5, rounds=12, more=12)
    got = np.zeros((len(names), 5))
    for r in found.collect():
        got[names.index(r["term"])] = r["vector"]
    exact, turn = np.linalg.eigh(m)
    order = np.argsort(-np.abs(exact))[:5]
    assert np.allclose(np.abs(values), np.abs(exact[order]), atol=1e-3)
    # The same span: projections agree.
    assert np.linalg.norm(got @ got.T - turn[:, order] @ turn[:, order].T) < 0.05
    assert np.allclose(got.T @ got, np.eye(5), atol=1e-9)


def test_information_by_hand(spark):
    counts = spark.createDataFrame([("x", "y", 6), ("y", "x", 6), ("x", "x", 2), ("y", "z", 1), ("z", "y", 1)], "a string, b string, n long")
    got = {(r["a"], r["b"]): r["value"] for r in ve.information(counts).collect()}
    sums = {"x": 8, "y": 7, "z": 1}
    want = {p: math.log(n * 16 / (sums[p[0]] * sums[p[1]])) for p, n in {("x", "y"): 6, ("y", "x"): 6, ("x", "x"): 2, ("y", "z"): 1, ("z", "y"): 1}.items()}
    assert got == pytest.approx({p: v for p, v in want.items() if v > 0})


def test_fewer_words_than_columns(spark):
    df = spark.createDataFrame([("a b a b",), ("b a",)], "cmt string")
    rows = ve.word_vectors(df, 6, least=1).collect()
    assert all(len(r["vector"]) == 6 and np.isfinite(r["vector"]).all() for r in rows)


def test_large_tables_of_pairs_are_not_checkpointed(spark, monkeypatch):
    """Checkpoints are uncompressed; pairs, cooccurrences and matrix entries grow with the square of the window."""
    from reviewlens.operators import vectors

    seen = []
    plain = vectors.cut_lineage
    monkeypatch.setattr(vectors, "cut_lineage", lambda df: (seen.append(set(df.columns)), plain(df))[1])
    df = spark.createDataFrame([("a b c a b",), ("b c d a",)] * 5, "cmt string")
    assert vectors.word_vectors(df, 2, least=2).count() == 4
    assert seen and not any({"a", "b"} <= columns for columns in seen)
