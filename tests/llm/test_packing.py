import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewlens.llm import packing
from reviewlens.llm.tokenizer import Ids

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OWN = Ids()


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdé ñ\n\t '1.,  　 漢🙂S\x1c\x85"), max_size=30), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    assert [x.tolist() for x in OWN.texts(pa.array(texts, pa.string()))] == [whole(t) for t in texts]


def test_ids_of_odd_texts():
    texts = [None, "", " ", "x <|endoftext|> y", "don't we'll\n\nstop  now \n", "a" * 5000, "é è " * 3000]
    assert [x.tolist() for x in OWN.texts(pa.array(texts, pa.string()))] == [whole(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 10)), max_size=60))
def test_no_limit_is_exceeded(items):
    demands = np.array([(t, 1, loss) for t, loss in items], np.int64).reshape(-1, 3)
    limits = np.array([30, 4, 10])
    number = packing.place(demands, limits)
    assert len(number) == len(items) and (number >= 0).all()
    for k in set(number.tolist()):
        assert (demands[number == k].sum(0) <= limits).all()


def test_dot_product_fills_both_scarce_dimensions():
    # Long answers and long prompts go together: four full sequences.
    demands = np.array([(90, 1, 80)] * 4 + [(10, 1, 20)] * 4)
    assert packing.place(demands, np.array([100, 8, 100])).max() == 3


def test_too_large_example_is_refused():
    with pytest.raises(ValueError):
        packing.place(np.array([[31, 1, 1]]), np.array([30, 4, 10]))


def test_documents_round_trip(spark):
    texts = [(k, " ".join(f"word{(k * j) % 97}" for j in range(k * 37 % 3000))) for k in range(60)]
    rows = [*texts, (60, None), (60, None), (None, "x"), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", packing.F.lit("x"))
    out = packing.packed_documents(docs, tokens=512).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts:
        ids = np.array([*whole(t), 1], "<u4")
        own = sorted(parts[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(range(0, len(ids), 512))
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert len(parts[60]) == 2 and parts[61][0].length == 1 and len(parts[None]) == 1
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    used = sum(r.length for r in out)
    assert used > 0.97 * 512 * (len(sequences) - 1)
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_carried_columns_with_clashing_names(spark):
    rows = [(k % 7, 100 + k, 50, k, "x", "a b", 5, -1, 9) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, length long, loss_tokens long, lane long, shard string, `a b` string, offset long, sequence_id long, start long")
    out = packing.pack(frame, ["doc_id", "start"], tokens=400)
    assert out.columns == ["doc_id", "length", "loss_tokens", "shard", "a b", "start", "sequence_id", "offset"]
    found = out.collect()
    assert len(found) == 40 and {r.shard for r in found} == {"x"} and min(r.sequence_id for r in found) == 0
    assert packing.pack(frame.limit(0), ["doc_id"], tokens=400).collect() == []
