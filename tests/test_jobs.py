import pytest
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.operators import annotate
from reviewlens.plans import jobs
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS
from reviewlens.sources import annotations as an
from reviewlens.streaming.score import score_stream, write_scores


@pytest.fixture(scope="module")
def reviews(spark):
    words = F.array(F.lit("Ngon tuyệt 50k"), F.lit("dở quá #te"), F.lit("bình thường"), F.lit("không rõ 😀"))
    text = F.concat(F.get(words, (F.col("id") % 4).cast("int")), F.lit(" quán "), (F.col("id") % 7).cast("string"))
    label = F.get(F.array(*map(F.lit, ["1.0", "-1.0", "0.0", "nan"])), (F.col("id") % 4).cast("int"))
    return spark.range(400).select(F.col("id").alias("doc_id"), text.alias("cmt"), *[label.alias(a) for a in ASPECTS])


@pytest.fixture(scope="module")
def trained(reviews, tmp_path_factory):
    root = tmp_path_factory.mktemp("models")
    paths = {"features_path": str(root / "features"), "net_path": str(root / "net")}
    done = jobs.train(reviews, "rnn", "tfidf", 256, hidden=[16], maxEpoch=8, numPartitions=2, clipNorm=0.0, **paths)
    return done, paths


def test_train_learns_and_reports(trained):
    report = {r["aspect"]: r for r in trained[0].report.collect()}
    assert set(report) == {*ASPECTS, "overall"} and report["overall"]["accuracy"] > 0.9
    assert report["overall"]["total"] == 7 * report["price"]["total"]


def test_evaluate_reads_what_train_saved(reviews, trained):
    done, paths = trained
    stored = jobs.evaluate(reviews, jobs.load_features(paths["features_path"]), jobs.load_net(paths["net_path"]))
    direct = jobs.evaluate(reviews, done.features, done.net)
    assert sorted(stored.collect()) == sorted(direct.collect())
    assert stored.filter("aspect = 'price'").collect()[0]["total"] == 400


def test_compare_models_equals_evaluate(reviews, trained, tmp_path):
    done, paths = trained
    other = {"features_path": str(tmp_path / "f"), "net_path": str(tmp_path / "n")}
    basic = jobs.Prep("basic")
    second = jobs.train(reviews, "mlp", "wordcount", 50, basic, hidden=[8, 4], maxEpoch=1, numPartitions=2, **other)
    slots = {"one": jobs.Slot(**paths), "two": jobs.Slot(**other, prep=basic)}
    table = jobs.compare_models(reviews, slots)
    for name, want in (("one", jobs.evaluate(reviews, done.features, done.net)), ("two", jobs.evaluate(reviews, second.features, second.net, basic))):
        assert sorted(table.filter(F.col("slot") == name).drop("slot").collect()) == sorted(want.collect())


def test_slot_per_row_equals_slot_by_slot(spark, reviews, trained, tmp_path):
    """Other cleaning, features and width in each slot; tables and streams, null and unknown slots, no rows."""
    done, paths = trained
    other = {"features_path": str(tmp_path / "f"), "net_path": str(tmp_path / "n")}
    basic = jobs.Prep("basic")
    second = jobs.train(reviews, "mlp", "wordcount", 50, basic, hidden=[8, 4], maxEpoch=1, numPartitions=2, **other)
    slots = {"one": jobs.Slot(**paths), "two": jobs.Slot(**other, prep=basic)}
    rows = reviews.select("doc_id", "cmt", F.get(F.array(F.lit("one"), F.lit("two"), F.lit(None)), (F.col("doc_id") % 3).cast("int")).alias("slot"))
    got = jobs.score_slots(rows, slots, keep=["doc_id", "slot"])
    for name, fit, prep in (("one", done, None), ("two", second, basic)):
        want = jobs.score(rows.filter(F.col("slot") == name), fit.features, fit.net, prep, ["doc_id", "slot"])
        assert sorted(got.filter(F.col("slot") == name).collect()) == sorted(want.collect())
    unnamed = got.filter("slot IS NULL").select(*ASPECTS).distinct().collect()
    assert len(unnamed) == 1 and set(unnamed[0]) == {None}
    assert "Exchange" not in jobs.score_slots(spark.read.parquet(_stored(rows, tmp_path)), slots)._jdf.queryExecution().toString()
    assert jobs.score_slots(rows.limit(0), slots, keep=["doc_id"]).count() == 0
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    out = str(tmp_path / "out")
    write_scores(jobs.score_slots(stream, slots, keep=["doc_id", "slot"]), out, str(tmp_path / "mark")).awaitTermination()
    assert sorted(spark.read.parquet(out).collect(), key=str) == sorted(got.collect(), key=str)
    with pytest.raises(Exception, match="unknown slot: three"):
        jobs.score_slots(rows.withColumn("slot", F.lit("three")), slots).collect()


def _stored(rows, root):
    rows.write.parquet(str(root / "rows"))
    return str(root / "rows")


def test_predict_sentence(spark, trained):
    done, _ = trained
    assert jobs.predict_sentence(spark, "Ngon tuyệt 50k quán 3", done.features, done.net) == ["1.0"] * 7
    assert jobs.predict_sentence(spark, "không rõ 😀 quán 'x'", done.features, done.net) == [""] * 7


def test_stream_equals_batch(spark, reviews, trained, tmp_path):
    done, _ = trained
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    reviews.select("doc_id", "cmt").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, cmt string").option("maxFilesPerTrigger", 1).parquet(source)
    scored = score_stream(stream, done.features, done.net, keep=["doc_id"])
    write_scores(scored, out, str(tmp_path / "mark")).awaitTermination()
    batch = jobs.score(reviews, done.features, done.net, keep=["doc_id"])
    got = spark.read.parquet(out)
    assert got.count() == 400 and got.exceptAll(batch).count() == 0


def test_train_without_a_key(reviews):
    done = jobs.train(reviews.drop("doc_id"), "gru", "wordcount", 50, key=None, hidden=[8], maxEpoch=1, numPartitions=2)
    assert done.report.count() == 8


def test_auto_label(spark, reviews, trained):
    done, _ = trained
    table = reviews.select(
        F.col("doc_id").alias("id"), F.col("cmt").alias("review"), *[F.lit("neutral").alias(a) for a in ANNOTATION_ASPECTS]
    )
    everything = annotate.auto_label(table, done.features, done.net)
    assert everything.columns == table.columns and everything.count() == 400
    ids = spark.createDataFrame([(0,), (3,), (3,)], "id long")
    some = {r["id"]: r for r in annotate.auto_label(table, done.features, done.net, ids=ids).collect()}
    want = {r["id"]: r for r in everything.filter("id in (0, 3)").collect()}
    assert len(some) == 400 and some[0] == want[0] and some[3] == want[3] and some[1]["PRICE"] == "neutral"


def test_compare_annotators_from_files(spark, tmp_path):
    base = spark.range(30).select("id", F.concat(F.lit("r"), "id").alias("review"), *[
        F.when(F.col("id") % (j + 2) == 0, "positive").alias(a) for j, a in enumerate(ANNOTATION_ASPECTS)
    ])
    other = base.withColumn("PRICE", F.lit("negative"))
    for name, df in (("a", base), ("b", other), ("gold", base)):
        an.write_annotations_txt(df, str(tmp_path / name))
    table = an.read_annotations_txt(spark, {n: str(tmp_path / n) for n in ("a", "b", "gold")}, offset=1)
    got = {r["measure"]: r["f1"] for r in jobs.compare_annotators(table, "a", "b", "gold").collect()}
    assert got["benchmark a"] == 1.0 and got["agreement"] == pytest.approx(got["benchmark b"]) and got["agreement"] < 1
    short = table.filter("not (annotator = 'b' and rec = 3)")
    with pytest.raises(ValueError, match="differ"):
        jobs.compare_annotators(short, "a", "b", "gold")


def test_training_labels_from_annotations_feed_training(spark, reviews):
    ann = reviews.select(F.col("doc_id"), "cmt", *[
        lb.code_to_sentiment(lb.training_to_code(lb.parse_label(a))).alias(n) for a, n in zip(ASPECTS, ANNOTATION_ASPECTS, strict=True)
    ])
    back = lb.to_training(ann, ["doc_id"]).orderBy("doc_id").drop("label").collect()
    want = reviews.select("doc_id", *[lb.parse_label(a).alias(a) for a in ASPECTS]).orderBy("doc_id").collect()
    assert back == want


def test_words_learned_in_training_are_used_in_scoring(spark, reviews, trained):
    done = jobs.train(reviews, "rnn", "tfidf", 64, segment_rounds=2, segment_threshold=2.0, hidden=[4], maxEpoch=1, numPartitions=2)
    assert done.prep.lexicon_path
    lexicon = {r["word"] for r in spark.read.parquet(done.prep.lexicon_path).collect()}
    assert any(w.startswith("ngon_tuyệt") for w in lexicon)
    cleaned = done.prep.sentences(reviews, ["doc_id"]).filter("doc_id = 0").collect()[0]["cmt"]
    assert cleaned.startswith("ngon_tuyệt")
    assert jobs.score(reviews, done.features, done.net, done.prep, ["doc_id"]).count() == 400


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_annotators_are_compared_after_one_shuffle_of_rows(spark):
    rows = [("a", 1, "x", [0, 3, 1]), ("b", 1, "x", [0, 2, 1]), ("g", 1, "x", [1, 3, 1]), ("a", 2, None, [2, 0, 0]), ("b", 2, None, [2, 0, 0]), ("g", 2, None, [2, 0, 3])]
    table = spark.createDataFrame(rows, "annotator string, rec int, review string, codes array<int>")
    wide = annotate.side_by_side(table, ["a", "b", "g"])
    assert _plan(wide).count("Exchange hashpartitioning") == 1 and "SortAggregate" not in _plan(wide)
    got = {r["rec"]: (r["y_0"], r["y_1"], r["y_2"]) for r in wide.collect()}
    assert got == {1: ([0, 3, 1], [0, 2, 1], [1, 3, 1]), 2: ([2, 0, 0], [2, 0, 0], [2, 0, 3])}
    assert annotate.misaligned_side_by_side(wide, ["a", "b", "g"], "g").count() == 0
    bad = [("a", 3, "x", [0]), ("g", 3, "y", [0]), ("b", 3, "y", [0]), ("a", 4, "x", [0]), ("g", 5, "x", [0]), ("a", 5, "x", [0]), ("a", 5, "x", [0]), ("a", 6, None, [0]), ("g", 6, "", [0])]
    wide = annotate.side_by_side(spark.createDataFrame(bad, table.schema), ["a", "b", "g"])
    found = sorted(map(tuple, annotate.misaligned_side_by_side(wide, ["a", "b", "g"], "g").collect()))
    assert found == [
        (3, "a", "different review"), (4, "a", "not in g"), (5, "a", "repeated in a"), (5, "b", "not in b"), (6, "a", "different review"), (6, "b", "not in b"),
    ]


@pytest.mark.parametrize("parts", [2, 7])
def test_exact_split_takes_the_same_rows_on_any_partitioning(spark, parts):
    from reviewlens.operators.rows import exact_split

    df = spark.range(1003).select("id", F.concat(F.lit("t"), F.col("id") % 10).alias("cmt"))
    same = spark.createDataFrame([(5000, "copy")] * 500 + [(None, None)] * 3, "id long, cmt string")
    table = df.unionByName(same).repartition(parts)
    train, test = exact_split(table, 0.8, bits=4)
    assert (train.count(), test.count()) == (1205, 301)
    assert sorted(map(repr, train.unionByName(test).collect())) == sorted(map(repr, table.collect()))
    one, _ = exact_split(df.unionByName(same).coalesce(1), 0.8)
    assert sorted(map(repr, train.collect())) == sorted(map(repr, one.collect()))
    none, every = exact_split(df.limit(0), 0.8)
    assert none.count() == every.count() == 0


def test_training_cleans_once(trained):
    assert "regexp_replace" not in trained[0].predictions._jdf.queryExecution().toString()
