import random
import tracemalloc

import numpy as np
import pyarrow as pa

from reviewlens.llm import language

SYLLABLES = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "eu", "ung"], "cc": ["ção", "ñe", "lh"]}


def texts(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        rows.append((k, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.createDataFrame(texts(1, 300), "doc_id long, text string, lang string").repartition(4)
    model = language.fit(docs.filter(language.training_rows(docs)))
    assert sorted(set(model.langs)) == ["aa", "bb", "cc"] and len(model.langs) > 3
    odd = [(900, None, None), (901, "", "aa"), (902, "123 … ☃", None), (None, "ka ti mo", None), (903, "Ж", None), (904, "KATIMO " * 30_000, None), (904, "KATIMO", None)]
    rows = spark.createDataFrame([*texts(2, 200), *odd], "doc_id long, text string, lang string").withColumnRenamed("lang", "score")
    got = {r.doc_id: r for r in language.predict(rows, model).collect()}
    want = texts(2, 200)
    assert sum(got[i].lang_pred == lang for i, _, lang in want) >= 196
    assert not any(got[i].rejected for i, *_ in want)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "aa" and got[904].lang_pred == "aa" and got[903].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert language.predict(empty, model).collect() == []
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.predict(one, language.fit(one)).collect()[0].lang_pred == "und"


def test_vectors_depend_on_the_text_alone():
    a = [f for _, _, f, _ in language.counts(pa.array(["abc  déf", None, "abc, DÉF!", "x"]))][0]
    assert (a[0] == a[2]).all() and not a[1].any() and a[0].sum() > 0
    alone = [f for _, _, f, _ in language.counts(pa.array(["abc déf"]))][0]
    assert (alone[0] == a[0]).all()
    assert np.allclose(np.linalg.norm(language.vectors(a, np.ones(language.WIDTH, np.float32)), axis=1), [1, 0, 1, 1])


def test_counting_holds_the_n_grams_of_few_texts_at_once():
    column = pa.array([f"ka ti mo {k} " * 70 for k in range(1000)])
    tracemalloc.start()
    found = [f.sum(1) for _, _, f, _ in language.counts(column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for at in (0, 63, 64, 511, 512, 999):
        alone = next(f for _, _, f, _ in language.counts(column.slice(at, 1)))
        assert np.concatenate(found)[at] == alone.sum()
