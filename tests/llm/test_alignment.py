import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlens.llm import alignment as al

SIZE = WIDTH = 50


def stretch(a_ends, b_ends, low, high_a, high_b):
    """The tokens of two streams whose ends lie above ``low`` and up to a place of each stream's own."""
    a = [e for e in a_ends if low[0] < e <= high_a]
    b = [e for e in b_ends if low[1] < e <= high_b]
    return al.Tokens(*(np.array(x, np.int64) for x in ([e % 7 for e in a], a, [e % 5 for e in b], b)))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40)), st.lists(st.tuples(st.integers(0, 41), st.integers(0, 41)), min_size=1, max_size=6), st.integers(0, 99))
def test_fragments_compose_in_any_bracketing(a_ends, b_ends, cuts, seed):
    a_ends, b_ends = sorted(a_ends | {41}), sorted(b_ends | {41})
    xs, ys = sorted(c[0] for c in cuts), sorted(c[1] for c in cuts)
    low, parts = (0, 0), []
    for hi in [*zip(xs, ys, strict=True), (41, 41)]:
        parts.append(al.fragment(stretch(a_ends, b_ends, low, *hi), SIZE, WIDTH))
        low = hi
    want = al.whole(al.fragment(stretch(a_ends, b_ends, (0, 0), 41, 41), SIZE, WIDTH), SIZE, WIDTH)
    rng = random.Random(seed)
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [al.compose(parts[k], parts[k + 1], SIZE, WIDTH)]
    got = al.whole(parts[0], SIZE, WIDTH)
    assert (got.text, got.n) == (want.text, want.n)
    assert got.pairs.tolist() == want.pairs.tolist() and got.times.tolist() == want.times.tolist()
    # Plain loops: groups end at common ends, and overlapping ranges are linked.
    assert got.n == len(set(a_ends) & set(b_ends))
    ranges = [list(zip([0, *e[:-1]], e, strict=True)) for e in (a_ends, b_ends)]
    links = Counter((y % 7) * WIDTH + (v % 5) for x, y in ranges[0] for u, v in ranges[1] if x < v and u < y)
    assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == dict(links)


def expected(rows):
    """Every row by plain loops over both libraries' tokens."""
    tok = Tokenizer.from_file(public_tokenizers.path(al.BYTE_VOCABULARY))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(al.PIECE_VOCABULARY))
    to_byte = {}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for i, b in enumerate([*keep, *(b for b in range(256) if b not in keep)]):
        to_byte[chr(b if i < len(keep) else 256 + i - len(keep))] = b
    done = []
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            a = [(i, bytes(to_byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))]
            full = (" " + text).encode()
            if b"".join(x for _, x in a) == full == b"".join(x for _, x in b):
                spans = []
                for side in (a, b):
                    at, own = 0, []
                    for i, x in side:
                        own.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(own)
                common = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
                for cut in sorted(common):
                    groups.append(tuple([i for i, _, e in side if e <= cut] for side in spans))
                    spans_left = [[x for x in side if x[2] > cut] for side in spans]
                    links += [(i, j) for i, s, e in spans[0] if e <= cut for j, u, v in spans[1] if v <= cut and s < v and u < e]
                    spans = spans_left
        done.append((doc_id, groups, links))
    docs_with = Counter(p for _, _, links in done for p in set(links))
    best = defaultdict(int)
    for (i, _), n in docs_with.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, groups, links in done:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(docs_with[p] == best[p[0]] for p in links), sum(docs_with[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def found(docs, **options):
    rows = al.aligned(docs, **options)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return rows.withColumn("groups_sha256", digest).drop("groups")


WORDS = ["tea", "größe", "x1", "…", "<|endoftext|>", "\n", "12345", "  ", "日本語", "the", "internationalisation", "don't", "\t", "\r\n", "😀", " ", "<s>", "á"]


def corpus():
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(0, 30))) + rng.choice(["", " ", "\n", "."])) for k in range(60)]
    rows += [(None, "no id here"), (None, None), (7, None), (8, ""), (9, "same words"), (9, "same words"), (10, "a mark ▁ inside"), (11, "\x00 nul"), (12, " ")]
    return rows + [(13, " lead"), (14, "﻿ bom"), (15, "x" * 900), (16, "many words of a longer text\nwith lines " * 40)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("long", "hot"), [(al.LONG, al.HOT), (64, al.HOT), (64, 30), (al.LONG, 1)])
def test_rows_equal_plain_loops(spark, long, hot):
    """Whole texts and cut ones, frequent links sent to tasks and rare ones joined: the same rows."""
    rows = corpus()
    docs = spark.createDataFrame([(t, k, "x", 0) for k, t in rows], "text string, doc_id long, pairs string, row int").repartition(3)
    path = al.scratch_path(spark, "aligned")
    found(docs, long=long).write.parquet(path)
    table = spark.read.parquet(path)
    got = al.with_counts(table, al.link_counts(table), hot).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_a_very_long_text_is_many_tasks_work(spark):
    text = " ".join(random.Random(5).choices(WORDS, k=60_000))
    docs = spark.createDataFrame([(1, text), (2, "y" * 300_000), (3, "one")], "doc_id long, text string")
    whole_rows, cut_rows = (
        {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"], r["pairs"], r["times"]) for r in al.aligned(docs, long=n).collect()}
        for n in (1 << 30, 4096)
    )
    assert whole_rows == cut_rows and cut_rows[1][0] > 60_000


def test_empty_table_and_text_keys(spark):
    assert al.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = al.aligned(spark.createDataFrame([("k", "a text")], "doc_id string, text string")).collect()[0]
    assert one["doc_id"] == "k" and one["n_groups"] > 0
