import csv
import io
import random

import pytest

from reviewlens.sources import csv_records as cr
from reviewlens.sources.reviews import read_csv


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("97", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in zip(keys, before, strict=True):
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([("id", "cmt", "x"), *rows])
    path.write_text(out.getvalue(), encoding="utf-8", newline="")


def cells(n, seed):
    rng = random.Random(seed)
    parts = ["plain", 'a "word"', "two\nlines", ",", "\n\n", '"', "größe", '""', "x" * 150, "'", '"\n"', "\\"]
    return [(str(k), "".join(rng.choices(parts, k=rng.randrange(1, 5))) + ("." if rng.random() < 0.5 else ""), rng.choice(["", "1.0", "nan", 'q"'])) for k in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_of_many_splits_equal_the_one_task_reader(spark, tmp_path, small_splits, seed):
    rows = cells(60, seed)
    for name, part in (("a", rows[:35]), ("b", rows[35:]), ("c", [])):
        write(tmp_path / f"{name}.csv", part)
    df = cr.read_split_csv(spark, str(tmp_path))
    assert rows_of(df) == sorted([(a, b or None, c or None) for a, b, c in rows], key=repr)
    assert rows_of(read_csv(spark, str(tmp_path), "split")) == rows_of(read_csv(spark, str(tmp_path)))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_one_record_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {k} "quoted"' for k in range(80))
    rows = [("1", "before", "x"), ("2", long, "y"), ("3", "after\nit", "z")]
    write(tmp_path / "a.csv", rows)
    assert rows_of(cr.read_split_csv(spark, str(tmp_path / "a.csv"))) == rows


def test_other_line_ends_blank_lines_and_a_header_over_lines(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", [("1", "two words", "x"), ("2", "more", "y")], "\r\n")
    assert rows_of(cr.read_split_csv(spark, str(tmp_path / "a.csv"))) == [("1", "two words", "x"), ("2", "more", "y")]
    (tmp_path / "b.csv").write_text('id,"a\nname"\n\n1,x\n\n2,"y\nz"', encoding="utf-8")
    df = cr.read_split_csv(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["id", "a\nname"] and rows_of(df) == [("1", "x"), ("2", "y\nz")]
