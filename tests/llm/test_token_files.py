import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewlens.llm import token_files as tf
from reviewlens.session import scratch_path


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_coding_returns_every_number(values):
    v = np.array(values, np.uint32)
    control, data = tf.encode(v)
    assert len(control) == -(-len(v) // 4)
    assert len(data) == sum(max(1, -(-int(x).bit_length() // 8)) for x in values)
    assert tf.decode(control, data, len(v)).tolist() == values


def test_frequent_ids_get_small_numbers():
    rank, by_rank = tf.ranks({5: 9, 2: 9, 7: 20}, 9)
    assert by_rank.tolist() == [7, 2, 5, 0, 1, 3, 4, 6, 8]
    assert rank[by_rank].tolist() == list(range(9))


def expected(rows):
    """Every document by plain loops, with the tokenizers library."""
    tok = Tokenizer.from_file(public_tokenizers.path(tf.VOCABULARY))
    docs = []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        docs.append((doc_id, ids, zlib.crc32(np.array(ids, "<u4").tobytes())))
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, len(d[1]), d[2]))
    out, start = [], 0
    for doc_id, ids, crc in docs:
        out.append((doc_id, start, len(ids), crc, ids))
        start += len(ids)
    return out


def found(df):
    order = lambda r: (r["start"],)
    return [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in sorted(df.collect(), key=order)]


def test_round_trip_equals_plain_loops(spark):
    rng = random.Random(3)
    words = ["tea", "größe", "x1", "…", "<|endoftext|>", "\n", "12345", "  ", "日本", "the", "the", "the"]
    rows = [(rng.randrange(-40, 200), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for _ in range(300)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (9, "same"), (9, "same"), (9, "same"), (500, "long " * 40_000)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, n int").repartition(5)
    path = scratch_path(spark, "tokens")
    tf.write_token_files(docs, path, file_ids=2000)
    assert found(tf.read_token_files(spark, path)) == expected(rows)
    assert spark.read.parquet(f"{path}/manifest").count() > 3
    assert tf.read_token_files(spark, path, ids=False).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_one_id_held_by_most_rows_spreads_over_files(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 600 + [(k, "x") for k in range(2, 20)], "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    tf.write_token_files(docs, path, file_ids=200)
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert max(r["n_docs"] for r in manifest) < 300
    assert tf.read_token_files(spark, path).count() == 618


def test_files_beside_the_manifest_are_not_read(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    tf.write_token_files(docs, path)
    folder = Path("/" + path.removeprefix("file:").lstrip("/")) / "files"
    (folder / "000000-left-by-a-lost-task").write_bytes(b"half a file")
    assert tf.read_token_files(spark, path).count() == 2


def test_empty_table_and_other_keys(spark):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tf.read_token_files(spark, path).collect() == []
    with pytest.raises(ValueError, match="whole number"):
        tf.write_token_files(spark.createDataFrame([("a", "b")], "doc_id string, text string"), path)
