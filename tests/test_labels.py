import math
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.operators import rows as rw
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS


def col(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build("x")).collect()]


def nearest(x):
    gaps = [abs(-2 - x), abs(0 - x), abs(-1 - x), abs(1 - x)]
    low = min(gaps)
    return next((v for v, g in zip((-2.0, 0.0, -1.0), gaps, strict=False) if g == low), 1.0)


def test_parse_label(spark):
    texts = ["1.0", "0.0", "-1.0", "1", "nan", None, "", "2.0", "-1", "x"]
    assert col(spark, texts, "string", lb.parse_label) == [1, 0, -1, 1, -2, -2, -2, -2, -1, -2]
    exact = col(spark, texts, "string", lambda c: lb.parse_label(c, "exact"))
    assert exact == [1, 0, -1, -2, -2, -2, -2, -2, -2, -2]
    with pytest.raises(ValueError, match="mode"):
        lb.parse_label("x", "other")


def test_snap_is_nearest_with_ties(spark):
    rng = random.Random(4)
    values = [-9.0, -1.5, -1.2, -0.5, 0.5, 0.7, -2.0, 0.0, 1.0, 5.0] + [rng.uniform(-4, 4) for _ in range(500)]
    assert col(spark, values, "double", lb.snap) == [nearest(v) for v in values]


def test_snap_of_special_values(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1e17, None]
    assert col(spark, values, "double", lb.snap) == [1, 1, -2, 1, None]
    assert col(spark, values, "double", lambda c: lb.snap(c, parity=True)) == [1, -2, -2, -2, None]
    assert nearest(math.inf) == -2 and nearest(1e17) == -2


def test_blank_absent(spark):
    assert col(spark, [-2.0, -1.0, 0.0, 1.0], "float", lb.blank_absent) == ["", "-1.0", "0.0", "1.0"]


def test_codes_and_names(spark):
    assert col(spark, [0, 1, 2, 3, None], "int", lb.code_to_sentiment) == [None, "negative", "neutral", "positive", None]
    names = [None, "dne", "negative", "neutral", "positive"]
    assert col(spark, names, "string", lb.sentiment_to_code) == [0, 0, 1, 2, 3]
    assert col(spark, [*names, "odd"], "string", lambda c: lb.sentiment_to_code(c, "null")) == [0, 0, 1, 2, 3, None]
    with pytest.raises(Exception, match="not a sentiment: good"):
        col(spark, ["good"], "string", lb.sentiment_to_code)
    wide = spark.createDataFrame([(1, "good", "neutral")], "k int, a string, b string")
    assert [tuple(r) for r in lb.unknown_sentiments(wide, ["a", "b"], ["k"]).collect()] == [(1, "a", "good")]
    assert col(spark, [0, 1, 2, 3], "int", lb.code_to_training) == [-2, -1, 0, 1]
    assert col(spark, [-2.2, -1.0, 0.1, 3.0], "float", lb.training_to_code) == [0, 1, 2, 3]
    assert col(spark, [[0, 3]], "array<int>", lb.to_multilabel) == [[False] * 5 + [True]]


def test_decode_label_text(spark):
    texts = ["{PRICE, positive}, {QUALITY, negative}", "{PRICE, positive}, {PRICE, neutral}", "", "{FOO, neutral}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, labels string")
    out = [r.asDict() for r in lb.decode_label_text(df, keep=["i", "labels"]).orderBy("i").collect()]
    assert [(r["PRICE"], r["QUALITY"], r["GENERAL"]) for r in out] == [
        ("positive", "negative", None), ("neutral", None, None), (None, None, None), (None, None, None),
    ]
    assert [r["labels"] for r in out] == texts
    assert [tuple(r) for r in lb.unknown_label_names(df, keep=["i"]).collect()] == [(3, "FOO")]


def test_encode_then_decode_is_identity(spark):
    rng = random.Random(5)
    data = [tuple(rng.choice([None, "negative", "neutral", "positive"]) for _ in range(7)) for _ in range(100)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, " + ", ".join(f"{a} string" for a in ANNOTATION_ASPECTS))
    back = lb.decode_label_text(df.select("i", lb.encode_label_text().alias("labels")), keep=["i"]).orderBy("i")
    assert [tuple(r)[1:] for r in back.collect()] == data


def test_to_training(spark):
    df = spark.createDataFrame([(1, "positive", *[None] * 5, "negative")], "id int, " + ", ".join(f"{a} string" for a in ANNOTATION_ASPECTS))
    row = lb.to_training(df, ["id"]).collect()[0]
    assert list(row["label"]) == [1.0, *[-2.0] * 5, -1.0] and row["general"] == 1.0 and row["background"] == -1.0


def test_sentence_result_and_presence(spark):
    df = spark.createDataFrame([(1, [-2.1, -0.9, 0.2, 0.9, 5.0, -1.5, -0.5])], "id int, prediction array<float>")
    assert list(rw.sentence_result(df).collect()[0]) == ["", "-1.0", "0.0", "1.0", "1.0", "", "0.0"]
    ann = spark.createDataFrame([(1, None, "neutral")], "id int, GENERAL string, PRICE string")
    assert tuple(rw.with_dne(ann, ["GENERAL", "PRICE"]).collect()[0]) == (1, "dne", "neutral")
    codes = spark.createDataFrame([(1, 0, 3)], "id int, GENERAL int, PRICE int")
    assert [tuple(r) for r in rw.mentioned_aspects(codes, ["id"], ["GENERAL", "PRICE"]).collect()] == [(1, "PRICE", "positive")]


def test_hash_split_is_disjoint_whole_and_layout_free(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    train, test = rw.split_reviews(df)
    a = {r[0] for r in train.collect()}
    b = {r[0] for r in test.collect()}
    assert not a & b and len(a | b) == 5000 and 0.77 < len(a) / 5000 < 0.83
    again, _ = rw.split_reviews(df.repartition(7))
    assert {r[0] for r in again.collect()} == a
    other, _ = rw.split_reviews(df, seed=51)
    assert {r[0] for r in other.collect()} != a
    left, right = rw.split_reviews(df, method="random")
    assert left.count() + right.count() == 5000


def test_row_index(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("x")).repartition(7)
    out = rw.with_row_index(df)
    assert sorted(r["ColumnIndex"] for r in out.collect()) == list(range(1000))
    ordered = rw.with_row_index(df, order_by=["x"])
    assert all(r["x"] == r["ColumnIndex"] for r in ordered.collect())
    assert rw.with_row_index(spark.range(5), stable=True).filter("id = ColumnIndex").count() == 5
    assert rw.with_row_index(df.filter("x < 0")).count() == 0


def test_clean_reviews_columns(spark):
    df = spark.createDataFrame([("Ngon #x", "1.0", *["nan"] * 6, "drop")], ", ".join(f"{c} string" for c in ["cmt", *ASPECTS, "extra"]))
    out = rw.clean_reviews(df)
    assert out.columns == ["cmt", *ASPECTS, "label"]
    row = out.collect()[0]
    assert row["cmt"] == "ngon HASTAG" and list(row["label"]) == [1.0, *[-2.0] * 6]
