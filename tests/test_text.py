import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import patterns as pt
from reviewlens.functions import text as tx
from reviewlens.operators.rows import clean_reviews
from reviewlens.schema import ASPECTS


def run(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(build("s")).collect()]


@pytest.mark.parametrize(("mode", "text", "want"), [
    ("advanced", "Nvien ok 50k", "nhân viên  ok PRICE"),
    ("advanced", "#ngon quá 12 dưa", "HASTAG qúa PRICEưa"),
    ("advanced", "quà 20.000đ", "qùa PRICE"),
    ("basic", "Giá 50k #re", "giá 50k  re"),
    ("basic", "tốt!(5/5)", "tốt! 5 5 "),
    ("advanced", "mìnhh ăn", "mình ăn"),
    ("basic", None, ""),
    ("basic", "a\tb\nc|d", "a b c d"),
])
def test_training_cleaner(spark, mode, text, want):
    assert run(spark, [text], lambda c: tx.clean_text(c, mode)) == [want]


@pytest.mark.parametrize(("text", "want"), [
    ("50k #ngon", "giátiền hashtag"),
    ("k ngon", "không ngon"),
    ("50 k", "giátiềnhông"),
    ("Hết. RỒI", "hết rồi"),
    ("uàoà ", "uàòa "),
])
def test_annotation_cleaner(spark, text, want):
    assert run(spark, [text], tx.clean_annotation) == [want]


def test_missing_text_as_a_word(spark):
    assert run(spark, [None], lambda c: tx.clean_text(c, missing_text="nan")) == ["nan"]


def test_emoji_sequences_go_as_one(spark):
    texts = ["a😀b", "a👨‍👩‍👧b", "a🇻🇳b", "a#️⃣b", "a👍🏽b", "a❤️b", "a🏴\U000e0067\U000e0062\U000e007fb"]
    assert run(spark, texts, tx.remove_emoji) == ["ab"] * len(texts)


def test_emoji_leaves_plain_text_alone(spark):
    texts = ["#1 * 2", "a‍b", "tiếng Việt ưỡn", "x️", "日本"]
    assert run(spark, texts, tx.remove_emoji) == texts


def test_emoji_ranges_are_the_unicode_property():
    regex = pytest.importorskip("regex")
    prop = regex.compile(r"\p{Emoji}")
    ours = set()
    for item in pt.EMOJI_RANGES:
        lo, hi = (item.split("-") * 2)[:2]
        ours.update(range(int(lo, 16), int(hi, 16) + 1))
    theirs = {c for c in range(0x80, 0x20000) if not 0xD800 <= c <= 0xDFFF and prop.match(chr(c))}
    # A newer Unicode version may add some; it never takes any away.
    assert ours <= theirs | ours and len(theirs ^ ours) < 50


def test_nfc_skips_only_stable_texts():
    spans = [(0x00, 0x2FF), (0x1EA0, 0x1EF9), (0x2002, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20C0), (0x2600, 0x27BF), (0xFE00, 0xFE0F), (0x1F300, 0x1FAFF)]
    stable = {c for lo, hi in spans for c in range(lo, hi + 1)}
    for lo, hi in spans:
        assert f"{lo:X}" in pt.NFC_STABLE.upper().replace("{0", "{") and f"{hi:X}" in pt.NFC_STABLE.upper().replace("{0", "{")
    for c in stable:
        assert unicodedata.is_normalized("NFC", chr(c)) and unicodedata.combining(chr(c)) == 0
    # No stable character is the second part of a composition.
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF:
            parts = unicodedata.decomposition(chr(c)).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                assert int(parts[1], 16) not in stable


def test_nfc_matches_unicodedata(spark):
    rng = random.Random(1)
    marks = "̣̀́̂"
    texts = ["".join(rng.choice("aoeuAO đ😀.") + rng.choice(["", *marks]) for _ in range(12)) for _ in range(200)]
    assert run(spark, texts, tx.nfc) == [unicodedata.normalize("NFC", t) for t in texts]


def test_clean_base_normalises_after_removing_emoji(spark):
    assert run(spark, ["a😀̀"], tx.clean_base) == ["à"]


def test_price_pattern_equals_the_plain_one(spark):
    # The published pattern is exponential, so inputs stay short.
    plain = re.compile(r"((?:(?:\d+[,\.]?)+) ?(?:nghìn đồng|đồng|k|vnd|d|đ))")
    rng = random.Random(2)
    texts = ["".join(rng.choice("12,. kđdvnđồng") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    texts += ["1 nghìn đồng", "1.nghìn đồng", "٣k", "1,2,3 k", ",5k", "1..5k"]
    assert run(spark, texts, tx.mask_prices) == [plain.sub("PRICE", t) for t in texts]


def test_long_digit_runs_stay_cheap(spark):
    text = "1" * 200_000 + "x" + "1," * 100_000
    assert run(spark, [text], tx.mask_prices) == [text]


def test_hashtag_ends_at_any_blank(spark):
    texts = ["#a b", "#a　b", "# x", "#ă#b c", "#a\x1fb"]
    assert run(spark, texts, tx.mask_hashtags) == [re.sub(r"#\S+", "HASTAG", t) for t in texts]


def test_rules_chained_and_folded_agree(spark):
    rules = [(f"a{i}", f"b{i}") for i in range(150)]
    texts = ["a1 a149 a14", "xyz"]
    want = []
    for t in texts:
        for w, x in rules:
            t = t.replace(w, x)
        want.append(t)
    assert run(spark, texts, lambda c: tx.apply_rules(c, rules)) == want
    assert run(spark, texts[:1], lambda c: tx.apply_rules(c, rules[:5])) == ["b1 b149 b14"]
    assert run(spark, texts, lambda c: tx.apply_rules(c, [])) == texts


def test_acronyms_come_first_and_a_spelling_rule_takes_their_place():
    merged = tx.merge_rules([("kks", "khách sạn"), ("qy", "quay")])
    assert merged[:2] == [("kks", "khách sạn"), ("qay", "quay")]
    assert len(merged) == 2 + len(pt.SPELLING_RULES) - 1


def test_autocorrect_is_one_pass(spark):
    words = {w: x for w, x in pt.KEYWORDS}
    pattern = re.compile(
        "(?<![0-9A-Za-z_])(" + "|".join(sorted(words, key=len, reverse=True)) + ")(?![0-9A-Za-z_])", re.IGNORECASE
    )
    rng = random.Random(3)
    pieces = ["k", "ko", "hông", "khong", "oà", "uà", "uỳ", "xẩy", " ", "ệ", "n", "đ", "_", "K"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(2000)] + ["", "k"]
    want = [pattern.sub(lambda m: words[m.group(1).lower()], t) for t in texts]
    assert run(spark, texts, tx.autocorrect) == want


def test_autocorrect_unicode_boundary(spark):
    assert run(spark, ["kệ k"], lambda c: tx.autocorrect(c, boundary="unicode")) == ["kệ không"]


def test_join_phrases(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "a")]
    texts = ["a b c", "a a a", "a a a a", "  x  a   b ", "", "a", None]
    want = ["a_b c", "a_a a", "a_a a_a", "x a_b", "", "a", None]
    assert run(spark, texts, lambda c: tx.join_phrases(c, pairs)) == want
    assert run(spark, ["  x  y "], lambda c: tx.join_phrases(c, [])) == ["x y"]


def test_cleaning_plan_has_one_arrow_step_and_no_row_udf(spark):
    df = spark.range(10).select(F.lit("x").alias("cmt"), *[F.lit("1.0").alias(a) for a in ASPECTS])
    plan = clean_reviews(df.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and plan.count("ArrowEvalPython") == 1


def test_joining_phrases_cleans_a_text_once(spark):
    """The words are read several times, what makes them only once."""
    df = spark.createDataFrame([("Ngon QUÁ đi",), (None,), ("",)], "s string")
    done = df.select(tx.clean_text("s", "advanced", (), [("ngon", "qúa")]).alias("s"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert sorted(r["s"] for r in done.collect()) == ["", "", "ngon_qúa đi"]


def test_autocorrect_works_out_its_text_once(spark):
    df = spark.createDataFrame([("KO ngon",)], "x string").select(tx.autocorrect(F.lower("x")).alias("y"))
    # The other one lower-cases the keyword found.
    assert df._jdf.queryExecution().analyzed().toString().count("lower(x#") == 1
    assert df.collect()[0][0] == "không ngon"


def test_emoji_are_looked_for_only_where_one_can_be(spark):
    assert pt.EMOJI_HINT in spark.range(1).select(tx.remove_emoji(F.lit("c").cast("string")))._jdf.queryExecution().logical().toString()
    found = re.compile(r"[\xA9\xAE\u203C-\U0001FAFA]")
    emoji = set()
    for item in pt.EMOJI_RANGES:
        lo, hi = (item.split("-") * 2)[:2]
        emoji.update(map(chr, range(int(lo, 16), int(hi, 16) + 1)))
    assert all(map(found.match, [*emoji, "\u20e3"]))


def test_unstable_is_all_that_is_not_stable(spark):
    table = spark.range(0x20000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("s"))
    both = table.select(F.col("s").rlike(pt.NFC_UNSTABLE).alias("a"), F.col("s").rlike("[^" + pt.NFC_STABLE[1:]).alias("b"))
    assert both.filter("a <> b").count() == 0 and both.filter("a").count() > 1000
