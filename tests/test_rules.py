"""Large dictionaries: the same as the plain fold."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text as tx
from reviewlens.functions.rules import Dictionary


def fold(text, rules):
    for written, wanted in rules:
        text = text.replace(written, wanted)
    return text


@pytest.mark.parametrize("seed", range(60))
def test_equals_the_plain_fold(seed):
    """Few letters, so that rules overlap, repeat, delete, and make one another's written forms."""
    draw = random.Random(seed)
    letters = "abc"[: draw.choice([2, 3])]

    def word(least, most):
        return "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))

    rules = [(word(1, 4), word(0, 4)) for _ in range(draw.randint(1, 12))]
    dictionary = Dictionary(rules)
    for _ in range(40):
        text = word(0, 60)
        assert dictionary.apply(text) == fold(text, rules)


def test_rules_that_need_one_another():
    rules = [("a", "bc"), ("xbcy", "long"), ("long", ""), ("bc", "a"), ("a", "z"), ("pq", "q")]
    for text in ["xay", "pxayq", "a" * 50, "", "xa", "ppqq", "pxay" * 400 + "q"]:
        assert Dictionary(rules).apply(text) == fold(text, rules)
    assert Dictionary([("b", "a"), ("a", "c")]).apply("ab") == "cc"
    assert Dictionary([("b", "c"), ("a", "b")]).apply("ab") == "bc"
    assert Dictionary([]).apply("ab") == "ab"


def test_repeated_written_forms():
    assert Dictionary([("a", "a"), ("a", "b")]).apply("xax") == "xbx"
    assert Dictionary([("a", "aa"), ("a", "b")]).apply("a") == "bb"


def test_column_equals_nested_expressions(spark):
    """Above the limit of nested expressions, null and empty texts included; an empty written form does nothing."""
    rules = [("", "x")] + [(f"k{i} ", f"k{i + 1} ") for i in range(150)]
    texts = spark.createDataFrame([(0, "k0 k149 k7"), (1, None), (2, ""), (3, "k150 kk3 đẹp 😀")], "id int, t string")
    out = {r["id"]: r["u"] for r in texts.select("id", tx.apply_rules("t", rules).alias("u")).collect()}
    assert out == {0: "k150 k150 k7", 1: None, 2: "", 3: "k150 kk150 đẹp 😀"}
    assert texts.limit(0).select(tx.apply_rules("t", rules).alias("u")).count() == 0


def test_cleaner_takes_a_large_dictionary(spark):
    acronyms = [(f"zz{i}q", f"từ{i}") for i in range(300)]
    row = spark.createDataFrame([("zz7q nvien zz299q",)], "t string")
    assert row.select(tx.clean_text("t", acronyms=acronyms)).first()[0] == "từ7 nhân viên  từ299"


def test_time_does_not_grow_with_the_dictionary():
    """20,000 rules of which texts hold as many as of 100."""
    draw = random.Random(3)
    small = [("".join(draw.choice("abcdefgh") for _ in range(6)), "w") for _ in range(100)]
    large = small + [("".join(draw.choice("ijklmnop") for _ in range(6)), "w") for _ in range(19_900)]
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(2000)) for _ in range(300)]

    def seconds(rules):
        dictionary, best = Dictionary(rules), float("inf")
        for _ in range(3):
            start = time.perf_counter()
            for text in texts:
                dictionary.apply(text)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(large) < 2 * seconds(small)
