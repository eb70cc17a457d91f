import random
import re

from reviewlens.llm import licenses


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    w, places = words_of(text), []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        statements = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a = licenses.Automaton(statements)
        text = [rng.randrange(4) for _ in range(30)]
        parts = {tuple(s[i:j]) for s in statements for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for at, (state, length) in enumerate(a.statistics(text)):
            want = max((n for n in range(1, at + 2) if tuple(text[at + 1 - n : at + 1]) in parts), default=0)
            assert length == want
            if length:
                passage = text[at + 1 - length : at + 1]
                assert a.ends[state] == sorted((k, e) for k, s in enumerate(statements) for e in range(length, len(s) + 1) if s[e - length : e] == passage)


def test_table(spark):
    mit = licenses.TEMPLATES["mit"][0]
    edited = mit.replace("any person", "any natural person").replace("free of charge, ", "")
    rows = [
        (1, "x Released under the MIT License.\nMIT license, Apache-License é general public license"),
        (2, f"intro words {edited} outro"),
        (3, "all rights reserved"), (4, "the rights of all and the above copyright notice"),
        (5, None), (6, ""), (7, "..."), (8, "mit"), (9, "license"), (None, "Licensed under CC BY-NC 4.0."), (10, "MIT License " * 3000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", licenses.pa and __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).coalesce(1)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)
    assert got[1].labels == "apache,gpl,mit"
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1 and got[2].spans[0].begin == 2
    assert got[3].labels == "proprietary" and got[4].labels == "" and got[None].labels == "cc-by-nc"
    assert (got[5].labels, got[5].score) == ("", 0.0)
    assert licenses.scan(docs.limit(0)).collect() == []
