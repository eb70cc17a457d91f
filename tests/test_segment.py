import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.operators import segment as sg

SYLLABLES = ["a", "b", "c", "d."]
LEXICON = st.dictionaries(
    st.lists(st.sampled_from(SYLLABLES), min_size=1, max_size=4).map("_".join), st.integers(1, 12), max_size=12
)


def by_trying_all(syllables, costs, unknown):
    """Every way of cutting, the cheapest with the longest first words."""
    best = None
    for marks in product([0, 1], repeat=max(0, len(syllables) - 1)):
        words, run = [], []
        for s, mark in zip(syllables, [*marks, 0], strict=True):
            run.append(s)
            if not mark:
                words.append(run)
                run = []
        if any(s.endswith((".", "!", "?")) for w in words for s in w[:-1]):
            continue
        prices = [costs.get("_".join(w), unknown if len(w) == 1 else None) for w in words]
        if None not in prices:
            found = (sum(prices), [-len(w) for w in words])
            best = found if best is None else min(best, found)
    return [-k for k in best[1]]


@settings(deadline=None)
@given(st.lists(st.sampled_from(SYLLABLES), min_size=1, max_size=9), LEXICON)
def test_cheapest_equals_trying_all(syllables, costs):
    assert sg.cheapest(syllables, sg.trie(costs), 9) == by_trying_all(syllables, costs, 9)


def texts(spark):
    rng = random.Random(2)
    units = ["nhân viên", "khách sạn", "phục vụ", "ngon", "rất", "giá rẻ.", "không gian quán", "ăn", "!", "ở đây"]
    rows = [(k, " ".join(rng.choices(units, k=rng.randrange(1, 25)))) for k in range(150)] + [(900, None), (901, ""), (902, "  mới \t toanh\n")]
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, cmt string, _known string").repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_joined_lexicon_gives_the_broadcast_one(spark):
    df = texts(spark)
    lexicon = sg.gram_lexicon(df, least=3, threshold=1.0)
    one = rows_of(sg.segment(df, lexicon))
    assert one == rows_of(sg.segment(df, lexicon, limit=0))
    assert any("_" in (r[1] or "") for r in one) and (900, None, "x") in one and (902, "mới toanh", "x") in one


def test_the_most_frequent_words_of_a_large_lexicon_are_not_joined(spark):
    df = texts(spark)
    lexicon = sg.gram_lexicon(df, least=3, threshold=1.0)
    counts = sorted((r["n"] for r in lexicon.collect()), reverse=True)
    one = rows_of(sg.segment(df, lexicon))
    for limit in (1, 7, len(counts) // 2, len(counts) - 1):
        least = sg._least_of(lexicon, limit)
        head = sum(n >= least for n in counts)
        assert head <= limit and (head == limit or counts[head : limit + 1].count(counts[head]) > limit - head)
        assert one == rows_of(sg.segment(df, lexicon, limit=limit))
    assert sg._least_of(lexicon, 0) > counts[0]
    few = [sorted(map(tuple, sg.learn_lexicon(df, least=3, threshold=2.0, limit=n).collect())) for n in (10**6, 9, 0)]
    assert few[0] == few[1] == few[2]


def test_learned_words(spark):
    found = {r["word"]: r["n"] for r in sg.learn_lexicon(texts(spark), threshold=3.0).collect()}
    assert {"nhân_viên", "khách_sạn", "phục_vụ", "không_gian_quán", "ở_đây"} <= set(found)
    assert "viên" not in found and not any(w.startswith("rẻ._") or "!_" in w for w in found)


def test_counts_of_a_round_are_those_of_the_texts(spark):
    df = texts(spark)
    first = sg.gram_lexicon(df, least=3, threshold=2.0)
    after = {r["word"]: r["n"] for r in sg.learn_lexicon(df, rounds=1, least=3, threshold=2.0).collect()}
    used: dict[str, int] = {}
    for r in sg.segment(df, first).collect():
        for w in (r["cmt"] or "").split():
            used[w] = used.get(w, 0) + 1
    assert after == {w: n for w, n in used.items() if n >= 3}


@pytest.mark.parametrize("text", ["", None])
def test_empty_lexicon_and_table(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, cmt string")
    lexicon = sg.gram_lexicon(df)
    assert lexicon.count() == 0
    assert sg.segment(df, lexicon).collect()[0]["cmt"] == text
    assert sg.segment(df.filter(F.lit(False)), lexicon).count() == 0


def test_counts_of_runs_are_those_of_counting_every_run(spark):
    """The filter loses no run, also where a syllable is written like a run; and a task needs no large lexicon per row."""
    rows = [r["cmt"] for r in texts(spark).select("cmt").collect()] + ["a b_c a b_c a b c a_b c"] * 2
    for some in (rows, rows[:-2]):
        expected: dict[str, int] = {}
        for text in some:
            words = (text or "").split()
            for i in range(len(words)):
                for k in range(1, 5):
                    run = words[i : i + k]
                    if len(run) == k and not any(w.endswith((".", "!", "?")) for w in run[:-1]):
                        expected["_".join(run)] = expected.get("_".join(run), 0) + 1
        table = spark.createDataFrame([(t,) for t in some], "cmt string")
        found = {r["word"]: r["n"] for r in sg.gram_lexicon(table, least=4).collect()}
        assert found == {w: n for w, n in expected.items() if n >= 4}


def test_rare_runs_are_not_shuffled_as_text(spark):
    """Of runs seen once only hashes of one and two syllables may leave a task."""
    table = spark.createDataFrame([(" ".join(f"w{i}x{k}" for k in range(50)),) for i in range(40)], "text string")
    counts = sg._gram_counts(table, 4, 5)
    assert counts.count() == 0
    assert sg._frequent(table, 1, range(1, 3)).count() == 40 * (50 + 49)


def test_runs_leave_a_task_as_arrays(spark):
    """No row is made of a run before the rare ones are gone, and parts of the hashes lose none."""
    table = spark.createDataFrame([(" ".join(f"w{(i * 7 + k) % 90}" for k in range(50)),) for i in range(40)], "text string").repartition(3)
    found = sg._frequent(table, 5, range(1, 3))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "HashAggregate" not in text
    assert found.count() == sg._frequent(table, 5, range(1, 3), split=6).count() == len(pairs_of(table, 5))
    assert sg._split(0) == 0 and sg._split(sg._PART) == 0 and sg._split(5 * sg._PART) == 3


def pairs_of(table, least):
    seen: dict[tuple, int] = {}
    for r in table.collect():
        words = r["text"].split()
        for run in [*zip(words), *zip(words, words[1:])]:
            seen[run] = seen.get(run, 0) + 1
    return [run for run, n in seen.items() if n >= least]


def test_texts_are_written_once_and_not_checkpointed(spark, monkeypatch):
    df = texts(spark)
    before = sg.stored
    seen = []
    monkeypatch.setattr(sg, "stored", lambda df, name: (seen.append(df), before(df, name))[1])
    checkpoints = []
    monkeypatch.setattr(type(df), "checkpoint", lambda self, eager=True: checkpoints.append(self.columns))
    found = rows_of(sg.segment(df, sg.gram_lexicon(df, least=3, threshold=1.0), limit=0))
    assert (902, "mới toanh", "x") in found and not checkpoints
    rows = next(x for x in seen if "all" in x.columns)
    assert rows.columns == ["all", "text", "row"] and rows.schema["all"].dataType.names == ["doc_id", "_known"]
    sg.learn_lexicon(df.select("cmt"), threshold=3.0, limit=0)
    assert not checkpoints


def test_words_are_counted_in_the_tasks(spark):
    found = sg._word_counts(texts(spark).select("cmt"))
    want: dict[str, int] = {}
    for r in texts(spark).collect():
        for w in (r["cmt"] or "").split():
            want[w] = want.get(w, 0) + 1
    assert {r["word"]: r["n"] for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["segment_words", "segment_words_joined", "apply_phrases", "count_vectors", "word_vectors", "learned_words"])
def test_queries_that_read_cleaned_rows_again_clean_them_once(spark, tmp_path, name, monkeypatch):
    from reviewlens.plans import queries as plans

    rows = [(k, f"ngon quá giá rẻ {k % 3} Hà Nội" + " ngon quá" * (k % 4), "vi", "s", 10) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cleaned = []
    plain = plans._cleaned
    monkeypatch.setattr(plans, "_cleaned", lambda *a: (cleaned.append(1), plain(*a))[1])
    found = plans.queries()[name](spark, str(tmp_path))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString() and len(cleaned) == 1
