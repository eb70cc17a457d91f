import math
from collections import Counter

from pyspark.ml.feature import CountVectorizerModel, Tokenizer
from pyspark.sql import functions as F

from reviewlens.operators import phrases, terms
from reviewlens.operators.features import WIDTHS, build_features, feature_pipeline
from reviewlens.operators.lookup import attach_by_key

TEXTS = ["a b a  c ", "", "   ", " x", "B b\t", "a", "giá 50k  re"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k long, cmt string").repartition(3)


def ml_words(spark):
    return {r["k"]: r["w"] for r in Tokenizer(inputCol="cmt", outputCol="w").transform(docs(spark)).collect()}


def test_tokenize_equals_ml_tokenizer(spark):
    ours = {r["k"]: r["w"] for r in docs(spark).select("k", terms.tokenize("cmt").alias("w")).collect()}
    assert ours == ml_words(spark) and ours[6] == ["giá", "50k", "", "re"]


def test_term_counts(spark):
    words = ml_words(spark)
    got = {(r["k"], r["term"]): r["tf"] for r in terms.document_terms(docs(spark), "k").collect()}
    assert got == {(k, t): n for k, ws in words.items() for t, n in Counter(ws).items()}
    stats = {r["term"]: (r["n"], r["df"]) for r in terms.term_stats(docs(spark)).collect()}
    n, d = Counter(), Counter()
    for ws in words.values():
        n.update(ws)
        d.update(set(ws))
    assert stats == {t: (n[t], d[t]) for t in n}
    top = terms.vocabulary(docs(spark), 2, min_df=2).orderBy("rank").collect()
    assert [(r["rank"], r["term"]) for r in top] == [(0, ""), (1, "a")]
    for r in terms.term_tfidf(docs(spark), "k").collect():
        assert math.isclose(r["tfidf"], r["tf"] * math.log((len(TEXTS) + 1) / (d[r["term"]] + 1)))


def test_attach_by_key_equals_a_join_under_skew(spark):
    # A third of the rows share one key; nearly all other keys are rare.
    left = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    table = left.groupBy("key").agg(F.count(F.lit(1)).alias("w")).withColumn("v", F.col("key") * 2)
    want = left.join(table, "key")
    for limit in (1 << 20, 0):
        got = attach_by_key(left, table, "key", "w", limit)
        assert got.count() == 60_000
        assert got.exceptAll(want.select(got.columns)).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Union" in plan
    assert attach_by_key(left, table.limit(0), "key", "w").count() == 0


def test_learned_phrases_against_counts(spark):
    lines = ["bún bò huế ngon"] * 12 + ["bún chả"] * 3 + ["bò kho ngon"] * 4 + ["  ", "ngon"]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, cmt string").repartition(3)
    one, two = Counter(), Counter()
    for line in lines:
        ws = line.split()
        one.update(ws)
        two.update(zip(ws, ws[1:], strict=False))
    total = sum(one.values())
    want = {p: (n - 2) * total / (one[p[0]] * one[p[1]]) for p, n in two.items() if n > 2}
    want = {p: s for p, s in want.items() if s >= 1.5}
    got = {(r["a"], r["b"]): r["score"] for r in phrases.learn_phrases(df, discount=2, threshold=1.5).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in got)


def test_long_phrase_lists_are_joined_with_the_same_result(spark):
    lines = ["a b c a b", "a a a a", "x", "", "c  a b", "b c b c", "a b", "it's \\n it's \\n"]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, cmt string")
    found = spark.createDataFrame([("a", "b", 9), ("b", "c", 5), ("a", "a", 3), ("it's", "\\n", 2)], "a string, b string, n_ab long")
    short = phrases.apply_phrases(df, found).orderBy("k").collect()
    joined = phrases.apply_phrases(df, found, literal_limit=1).orderBy("k").collect()
    assert short == joined
    assert [r["cmt"] for r in short] == ["a_b c a_b", "a_a a_a", "x", "", "c a_b", "b_c b_c", "a_b", "it's_\\n it's_\\n"]
    none = phrases.apply_phrases(df, found.limit(0)).orderBy("k").collect()
    assert none[4]["cmt"] == "c a b"


def test_phrase_paths_agree_on_repeated_and_null_keys(spark):
    rows = [(1, "a b c d"), (1, "x y a b"), (None, "a b c d"), (None, "x y")]
    df = spark.createDataFrame(rows, "k long, cmt string")
    found = spark.createDataFrame([("a", "b", 3), ("x", "y", 2)], "a string, b string, n_ab long")
    short, joined = (sorted(r["cmt"] for r in phrases.apply_phrases(df, found, literal_limit=n).collect()) for n in (100, 1))
    assert short == joined == ["a_b c d", "a_b c d", "x_y", "x_y a_b"]


def test_feature_pipelines(spark):
    df = spark.createDataFrame([(i, f"ngon quá {i % 3} w{i % 2}", [1.0] * 7) for i in range(30)], "id long, cmt string, label array<float>")
    train, test = df.filter("id < 20"), df.filter("id >= 20")
    for kind, width in (("wordcount", 6), ("tfidf", 64), ("word2vec", 4)):
        model, a, b = build_features(train, test, feature_pipeline(kind, width), ("id",))
        assert a.columns == ["id", "features", "label"] and a.count() == 20 and b.count() == 10
        assert b.first()["features"].size <= width
    counter = next(s for s in feature_pipeline("wordcount", 3, min_df=1).fit(train).stages if isinstance(s, CountVectorizerModel))
    assert len(counter.vocabulary) == 3 and WIDTHS["tfidf"] == 10000
    try:
        feature_pipeline("other")
    except ValueError as e:
        assert "kind" in str(e)
    else:
        raise AssertionError


def test_phrases_in_every_task_need_no_shuffle_and_equal_the_other_ways(spark):
    lines = ["a b c a b", "a a a a a", "x", "", None, "c \t a b", "b c b c", " a_b c a b\n", "a b.", "q"]
    df = spark.createDataFrame([(i % 3, line, "y") for i, line in enumerate(lines)], "k long, cmt string, _row2 string").repartition(3)
    found = spark.createDataFrame([("a", "b", 9), ("b", "c", 5), ("a", "a", 3), ("a_b", "c", 2), ("zz", "a", 2)], "a string, b string, n_ab long")
    ways = [phrases.apply_phrases(df, found, **limits) for limits in ({}, {"literal_limit": 1}, {"literal_limit": 1, "limit": 0})]
    one, two, three = (sorted(map(tuple, w.collect()), key=repr) for w in ways)
    assert one == two == three
    assert {"a_b c a_b", "a_a a_a a", "", None, "c a_b", "b_c b_c", "a_b_c a_b", "a b.", "q"} <= {r[1] for r in two}
    text = ways[1]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "hashpartitioning" not in text
    assert phrases.apply_phrases(df.filter("k > 5"), found, literal_limit=1).count() == phrases.apply_phrases(df.filter("k > 5"), found, literal_limit=1, limit=0).count() == 0
