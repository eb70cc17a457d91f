import codecs
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reviewlens import session as se
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS
from reviewlens.sources import annotations as an
from reviewlens.sources import reviews as rv


def parts(path):
    return sorted(p for p in Path(path).iterdir() if p.name.startswith("part-"))


def test_read_reviews_by_name_with_missing_cells(spark, tmp_path):
    head = ["extra", *reversed(ASPECTS), "cmt"]
    body = ['1,nan,1.0,,NA,0.0,-1.0,1,"a ""q"", b\nsecond line"', "2,,,,,,,," + "null"]
    (tmp_path / "r.csv").write_text("﻿" + ",".join(head) + "\n" + "\n".join(body) + "\n", encoding="utf-8")
    df = rv.read_reviews(spark, str(tmp_path / "r.csv"))
    assert df.columns == ["cmt", *ASPECTS]
    rows = sorted(df.collect(), key=lambda r: r["cmt"] is None)
    assert rows[0]["cmt"] == 'a "q", b\nsecond line' and rows[0]["general"] == "1" and rows[0]["background"] is None
    assert [rows[0][a] for a in ("price", "quality", "service", "stylefood", "location")] == ["-1.0", "0.0", None, None, "1.0"]
    assert rows[1]["cmt"] is None and len(rows) == 2
    assert rv.read_reviews(spark, [str(tmp_path / "r.csv")] * 2).count() == 4


def test_sentences_hold_quotes(spark):
    text = "it's {a} \"b\" \\ ; drop"
    assert [r["cmt"] for r in rv.sentences_df(spark, text).collect()] == [text]
    assert rv.sentences_df(spark, ["a", "b"]).count() == 2


def test_acronym_rules(spark):
    rows = [(0, "nvp", "nhân viên phục vụ", None), (1, "ks", "khách sạn", None), (2, "kks", "khách sạn", ""), (3, "abc", "một hai", "ghi chú"),
            (4, "ksn", "khách sạn", None), (5, "pho", "phở bò", "x")]
    df = spark.createDataFrame(rows, "pos long, a string, b string, c string")
    rules = rv.acronym_rules(df, ["a", "b", "c"], "pos")
    assert rv.collect_rules(rules) == [("nvp", "nhân viên phục vụ"), ("ksn", "khách sạn"), ("pho", "phở bò")]
    with pytest.raises(ValueError, match="rules"):
        rv.collect_rules(rules, limit=2)


@pytest.fixture
def many_files(spark):
    """Small test tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def annotated(spark, n=50):
    df = spark.range(n).select((F.col("id") * 3).alias("id"), F.concat(F.lit(' món "ngon", '), F.col("id")).alias("review"))
    for j, a in enumerate(ANNOTATION_ASPECTS):
        df = df.withColumn(a, F.when(F.col("id") % (j + 2) == 0, "positive").when(F.col("id") % 5 == 1, "negative"))
    return df


def test_txt_text_is_exact(spark, tmp_path, many_files):
    out = str(tmp_path / "out")
    df = annotated(spark, 20).withColumn("review", F.when(F.col("id") == 3, "two\nlines").when(F.col("id") == 6, "").otherwise(F.col("review")))
    an.write_annotations_txt(df.repartition(5), out)
    want = []
    for i, r in enumerate(df.orderBy("id").collect(), 1):
        label = ", ".join(f"{{{a}, {r[a]}}}" for a in ANNOTATION_ASPECTS if r[a])
        want += [f"#{i}", r["review"].replace("\n", " "), label, ""]
    assert len(parts(out)) > 1
    assert "".join(p.read_text(encoding="utf-8") for p in parts(out)) == "\n".join(want[:-1]) + "\n"


def test_txt_with_given_numbers(spark, tmp_path, many_files):
    out = str(tmp_path / "out")
    df = annotated(spark, 40).withColumn("n", (F.col("id") / 3).cast("long")).repartition(5)
    an.write_annotations_txt(df, out, rec="n")
    back = an.read_annotations_txt(spark, {"x": out}, offset=1).orderBy("rec").collect()
    assert len(parts(out)) > 1
    assert [r["review"] for r in back] == [r["review"] for r in df.orderBy("n").collect()]


def test_txt_round_trip_over_many_splits(spark, tmp_path, many_files):
    out = str(tmp_path / "out")
    df = annotated(spark, 400)
    an.write_annotations_txt(df.repartition(3), out)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size == "1000" else "4m")
            assert size == "128m" or spark.read.text(out).rdd.getNumPartitions() > 20
            back = an.read_annotations_txt(spark, {"x": out}, offset=1).orderBy("rec").collect()
            source = df.orderBy("id").collect()
            assert [r["rec"] for r in back] == list(range(400))
            for b, s in zip(back, source, strict=True):
                assert b["review"] == s["review"] and all(b[a] == s[a] for a in ANNOTATION_ASPECTS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4m")


def test_txt_with_header_line_and_carriage_returns(spark, tmp_path):
    blocks = ["#1\nngon\r\n{PRICE, positive}\n", "#2\n\n\n", "#3\ndở\n{PRICE, negative}, {PRICE, neutral}"]
    (tmp_path / "a.txt").write_bytes(("header\n" + "\n".join(blocks)).encode())
    (tmp_path / "b.txt").write_bytes(("header\n" + "\n".join(blocks[:1])).encode())
    df = an.read_annotations_txt(spark, {"a": str(tmp_path / "a.txt"), "b": str(tmp_path / "b.txt")})
    got = [(r["annotator"], r["rec"], r["review"], r["PRICE"]) for r in df.orderBy("annotator", "rec").collect()]
    assert got == [("a", 0, "ngon\r", "positive"), ("a", 1, "", None), ("a", 2, "dở", "neutral"), ("b", 0, "ngon\r", "positive")]


def test_csv_export_has_index_and_mark(spark, tmp_path, many_files):
    out = str(tmp_path / "csv")
    df = annotated(spark, 30).withColumn("review", F.when(F.col("id") == 0, "a\nb").otherwise(F.col("review")))
    an.write_annotations_csv(df.repartition(3), out)
    assert all(p.read_bytes().startswith(codecs.BOM_UTF8 + b",id,review,GENERAL") for p in parts(out))
    back = an.read_annotations_csv(spark, out)
    assert back.columns == ["id", "review", *ANNOTATION_ASPECTS]
    key = F.col("id").cast("long")
    assert [tuple(r)[1:] for r in back.orderBy(key).collect()] == [tuple(r)[1:] for r in df.orderBy("id").collect()]
    plain = str(tmp_path / "plain")
    an.write_annotations_csv(df, plain, bom=False)
    assert parts(plain)[0].read_bytes().startswith(b"_index,id,")


def test_csv_with_two_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,text\n1,x\n")
    row = an.read_annotations_csv(spark, str(tmp_path / "t.csv")).collect()[0]
    assert (row["id"], row["review"]) == ("1", "x") and all(row[a] is None for a in ANNOTATION_ASPECTS)
    (tmp_path / "bad.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(ValueError, match="columns"):
        an.read_annotations_csv(spark, str(tmp_path / "bad.csv"))


class FakeSession:
    """Only what shared_dir asks a session for."""

    def __init__(self, master, configured=None):
        self.settings = {"spark.checkpoint.dir": configured} if configured else {}
        self.master, self.current = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_shared_dir_comes_from_the_session(spark):
    assert se.shared_dir(spark) == se.shared_dir(spark)
    assert se.scratch_path(spark, "x") != se.scratch_path(spark, "x")
    cluster = FakeSession("spark://host:7077", "hdfs://name/shared/")
    assert se.shared_dir(cluster) == "hdfs://name/shared" and cluster.current == "hdfs://name/shared/"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        se.shared_dir(FakeSession("yarn"))


def test_spread_out_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert se.spread_out(wide) is wide
    assert se.spread_out(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4


def test_unknown_aspects_in_text_files_raise_or_are_skipped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#1\nreview\n{PRICE, neutral}, {PARKING, positive}\n\n", encoding="utf-8")
    with pytest.raises(Exception, match="not an aspect: PARKING"):
        an.read_annotations_txt(spark, {"a": str(tmp_path / "a.txt")}, offset=1).collect()
    row = an.read_annotations_txt(spark, {"a": str(tmp_path / "a.txt")}, offset=1, unknown="skip").collect()[0]
    assert row["PRICE"] == "neutral"
