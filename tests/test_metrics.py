import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import annotate, metrics
from reviewlens.schema import ANNOTATION_ASPECTS

NAMES = ["A", "B", "C"]


def table(spark, n=300, seed=6):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        t = [rng.choice([0, 0, 1, 2, 3]) for _ in NAMES]
        p = [c if rng.random() < 0.6 else rng.randint(0, 3) for c in t]
        # Class (C, 2) never occurs on either side.
        t[2], p[2] = (0 if t[2] == 2 else t[2]), (0 if p[2] == 2 else p[2])
        data.append((i, t, p))
    return data, spark.createDataFrame(data, "id int, y_true array<int>, y_pred array<int>")


def counts(data, j, c):
    tp = sum(t[j] == c == p[j] for _, t, p in data)
    return tp, sum(t[j] == c for _, t, _ in data), sum(p[j] == c for _, _, p in data)


def f1(tp, t, p):
    return 2 * tp / (t + p) if t + p else 0.0


def test_f1_averages_against_definition(spark):
    data, df = table(spark)
    classes = [counts(data, j, c) for j in range(3) for c in (1, 2, 3)]
    total = [sum(x) for x in zip(*classes, strict=True)]
    support = [c[1] for c in classes]
    want = {
        "micro": f1(*total),
        "macro": sum(f1(*c) for c in classes) / 9,
        "weighted": sum(f1(*c) * s for c, s in zip(classes, support, strict=True)) / sum(support),
        "samples": sum(
            f1(sum(a == b != 0 for a, b in zip(t, p, strict=True)), sum(a != 0 for a in t), sum(b != 0 for b in p))
            for _, t, p in data
        ) / len(data),
    }
    for average, value in want.items():
        got = metrics.multilabel_f1(df, average, aspects=NAMES).collect()
        assert len(got) == 1 and got[0]["f1"] == pytest.approx(value)
    with pytest.raises(ValueError, match="average"):
        metrics.multilabel_f1(df, "odd", aspects=NAMES)


def test_micro_f1_golden_and_symmetric(spark):
    df = spark.createDataFrame([([1, 0], [1, 2]), ([3, 2], [3, 3])], "y_true array<int>, y_pred array<int>")
    assert metrics.multilabel_f1(df, aspects=["A", "B"]).collect()[0]["f1"] == pytest.approx(4 / 7)
    swapped = metrics.multilabel_f1(df, true="y_pred", pred="y_true", aspects=["A", "B"])
    assert swapped.collect()[0]["f1"] == pytest.approx(4 / 7)


def test_f1_of_nothing_is_zero(spark):
    df = spark.createDataFrame([([0], [0])], "y_true array<int>, y_pred array<int>")
    for average in ("micro", "macro", "weighted", "samples"):
        assert metrics.multilabel_f1(df, average, aspects=["A"]).collect()[0]["f1"] == 0
    assert metrics.multilabel_f1(df.limit(0), aspects=["A"]).collect()[0]["f1"] == 0


def test_accuracy(spark):
    df = spark.createDataFrame(
        [([-2.0, 1.0], [-1.9, 0.2]), ([0.0, 1.0], [0.4, 0.9])], "label array<float>, prediction array<float>"
    )
    got = {r["aspect"]: (r["correct"], r["total"], r["accuracy"]) for r in metrics.accuracy_report(df, names=["a", "b"]).collect()}
    assert got == {"a": (2, 2, 1.0), "b": (1, 2, 0.5), "overall": (3, 4, 0.75)}
    empty = metrics.aspect_correct(df.limit(0), names=["a", "b"]).collect()
    assert [(r["correct"], r["total"], r["accuracy"]) for r in empty] == [(0, 0, None)] * 2
    by = metrics.accuracy_report(df.withColumn("slot", F.lit("s")), names=["a", "b"], by=["slot"])
    assert {(r["slot"], r["aspect"]) for r in by.collect()} == {("s", "a"), ("s", "b"), ("s", "overall")}


def test_kappa(spark):
    data, df = table(spark)
    got = {r["aspect"]: r["kappa"] for r in metrics.cohen_kappa(df, aspects=NAMES).collect()}
    n = len(data)
    for j, name in enumerate(NAMES):
        po = sum(t[j] == p[j] for _, t, p in data) / n
        pe = sum(sum(t[j] == c for _, t, _ in data) * sum(p[j] == c for _, _, p in data) for c in range(4)) / n**2
        assert got[name] == pytest.approx((po - pe) / (1 - pe))
    assert "ALL" in got
    same = spark.createDataFrame([([1], [1])], "y_true array<int>, y_pred array<int>")
    assert metrics.cohen_kappa(same, aspects=["A"]).filter("aspect = 'A'").collect()[0]["kappa"] is None


def test_metrics_shuffle_only_cells(spark):
    _, df = table(spark)
    plan = metrics.multilabel_f1(df, aspects=NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Join" not in plan


def annotations(spark):
    names = ", ".join(f"{a} string" for a in ANNOTATION_ASPECTS)
    blank = [None] * 6
    data = [
        ("a", 0, "x", "positive", *blank), ("a", 1, "y", None, *blank), ("a", 2, "z", "neutral", *blank),
        ("b", 0, "x", "positive", *blank), ("b", 1, "y!", "negative", *blank), ("b", 3, "w", None, *blank),
    ]
    return spark.createDataFrame(data, f"annotator string, rec long, review string, {names}")


def test_misaligned_and_agreement(spark):
    df = annotations(spark)
    got = {tuple(r) for r in annotate.misaligned(df, "a", "b").collect()}
    assert got == {(1, "different review"), (2, "not in b"), (3, "not in a")}
    value = annotate.agreement(annotate.with_codes(df), "a", "b").collect()[0]["f1"]
    assert value == pytest.approx(2 * 1 / (1 + 2))
    marks = annotate.benchmark(annotate.with_codes(df), "a").collect()
    assert [(r["annotator"], r["f1"]) for r in marks] == [("b", pytest.approx(2 / 3))]


def test_missing_reviews_are_equal(spark):
    df = annotations(spark).withColumn("review", F.when(F.col("rec") > 0, F.col("review")))
    df = df.withColumn("review", F.when((F.col("rec") == 1) & (F.col("annotator") == "a"), F.col("review")))
    assert {tuple(r) for r in annotate.misaligned(df.filter("rec < 2"), "a", "b").collect()} == {(1, "different review")}


@pytest.mark.parametrize(("aspect", "sentiment"), [("PARKING", "positive"), ("price", "positive"), (None, "positive")])
def test_edits_of_unknown_aspects_raise(spark, aspect, sentiment):
    df = annotations(spark).filter("annotator = 'a'").withColumnRenamed("rec", "doc_id")
    edits = spark.createDataFrame([(0, aspect, sentiment, 1)], "doc_id long, aspect string, sentiment string, seq long")
    with pytest.raises(Exception, match="not an aspect"):
        annotate.apply_edits(df, edits).collect()


@pytest.mark.parametrize("average", ["micro", "macro", "weighted", "samples"])
def test_f1_options(spark, average):
    rng = random.Random(3)
    data = [([rng.randrange(4) for _ in range(7)], [rng.randrange(4) for _ in range(7)], rng.randrange(1, 5)) for _ in range(40)]
    df = spark.createDataFrame([*data, ([0] * 7, [0] * 7, 2)], "y_true array<int>, y_pred array<int>, w int")
    plain = metrics.multilabel_f1(df, average).collect()[0]["f1"]
    same = metrics.multilabel_f1(df, average, labels=range(21)).collect()[0]["f1"]
    assert same == pytest.approx(plain)
    repeated = df.withColumn("n", F.explode(F.sequence(F.lit(1), "w"))).drop("n")
    want = metrics.multilabel_f1(repeated, average).collect()[0]["f1"]
    assert metrics.multilabel_f1(df, average, sample_weight="w").collect()[0]["f1"] == pytest.approx(want)
    empty = spark.createDataFrame([([0] * 7, [0] * 7)], "y_true array<int>, y_pred array<int>")
    assert metrics.multilabel_f1(empty, average, zero_division=1.0).collect()[0]["f1"] == 1.0
    first = df.select(F.slice("y_true", 1, 1).alias("y_true"), F.slice("y_pred", 1, 1).alias("y_pred"))
    alone = metrics.multilabel_f1(first, average, aspects=ANNOTATION_ASPECTS[:1]).collect()[0]["f1"]
    assert metrics.multilabel_f1(df, average, labels=[0, 1, 2]).collect()[0]["f1"] == pytest.approx(alone)


def test_edits_latest_wins_and_dne_clears(spark):
    df = annotations(spark).filter("annotator = 'a'").drop("annotator").withColumnRenamed("rec", "doc_id")
    edits = spark.createDataFrame(
        [(0, "GENERAL", "neutral", 1), (0, "GENERAL", "dne", 2), (1, "PRICE", "negative", 5), (1, "PRICE", "positive", 4), (99, "PRICE", "neutral", 9)],
        "doc_id long, aspect string, sentiment string, seq long",
    )
    got = {r["doc_id"]: (r["GENERAL"], r["PRICE"]) for r in annotate.apply_edits(df, edits).collect()}
    assert got == {0: (None, None), 1: (None, "negative"), 2: ("neutral", None)}
    bad = spark.createDataFrame([(0, "PRICE", "odd", 1)], edits.schema)
    with pytest.raises(Exception, match="not a sentiment"):
        annotate.apply_edits(df, bad).collect()


def test_a_document_with_most_edits(spark):
    df = annotations(spark).filter("annotator = 'a'").drop("annotator").withColumnRenamed("rec", "doc_id")
    edits = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).cast("long").alias("doc_id"),
        F.lit("PRICE").alias("aspect"),
        F.when(F.col("id") % 2 == 0, "neutral").otherwise("positive").alias("sentiment"), F.col("id").alias("seq"),
    )
    got = {r["doc_id"]: r["PRICE"] for r in annotate.apply_edits(df, edits).collect()}
    want = {}
    for i in range(20_000):
        want[0 if i % 3 == 0 else i % 1000] = "neutral" if i % 2 == 0 else "positive"
    assert got == {k: want[k] for k in got}


@pytest.mark.parametrize("average", ["micro", "macro", "weighted", "samples"])
def test_weights_that_are_all_zero(spark, average):
    df = spark.createDataFrame([([1], [1], 0.0), ([2], [1], 0.0)], "y_true array<int>, y_pred array<int>, w double")
    got = metrics.multilabel_f1(df, average, aspects=["A"], sample_weight="w", zero_division=0.5).collect()[0]["f1"]
    assert got == 0.5
