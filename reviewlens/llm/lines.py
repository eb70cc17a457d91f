"""Near-duplicate line removal with a deletion-neighbourhood join.

Lines are compared as word sequences with an edit bound of one word (inserted, deleted or replaced).
Every variant of a line within the bound, that is the line without one of its words, is emitted as a
hashed key; lines with equal variants meet, their edit distance is verified on the words, and the
earliest line stays. Built-in functions only.

Variants cost one row per word, so they are emitted only for lines that can have a partner: with one
edit, either the first or the last half of the words is untouched, and lines whose halves occur
nowhere else are out before. Of many lines that differ in the same word only the earliest is needed, so
groups are reduced to their minimum on the map side, however large they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import cut_lineage

_BLANKS = " \t\r\x0b\x0c"
MARKS = 1 << 20
_SUM = (1 << 62) - 1
MIN_WORDS = 8  # shorter lines are compared as they are: one word would be too much of them


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _normal(line: Column) -> Column:
    """The line's words with one space between them."""
    odd = F.lit(False)
    for blank in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | line.contains(blank)
    line = F.trim(line, F.lit(_BLANKS))
    return F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _sum(values: Column) -> Column:
    """Sum modulo 2^62, which, other than an exclusive or, does not cancel values that occur twice."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + x.bitwiseAND(_SUM)).bitwiseAND(_SUM))


def words_sum(words: Column) -> Column:
    """The sum of the hashes of a word array. Equal for equal arrays, and hardly ever for others, unless they hold the
    same words in another order."""
    return _sum(F.transform(words, lambda w: F.xxhash64(w)))


def shorter_keys(words: Column, whole: Column) -> Column:
    """Keys of a word array without any one of its words. ``whole``, its sum, is a column of its own, since an expression
    would be evaluated for every word."""
    without = F.transform(words, lambda w: (whole - F.xxhash64(w).bitwiseAND(_SUM)).bitwiseAND(_SUM))
    return F.array_distinct(F.transform(without, lambda x: F.xxhash64(F.size(words) - 1, x)))


def _half_keys(words: Column, n: Column) -> Column:
    """Hashes of the first and last m words, m for partners as long as the line and one shorter or longer;
    words: with one space between them. ``n``, their number, is a column of its own: an expression would be evaluated
    for every key."""

    def ends(m: Column) -> list[Column]:
        return [F.xxhash64(F.lit(side), m, F.call_function("substring_index", words, F.lit(" "), sign * m)) for side, sign in ((1, 1), (2, -1))]

    half = F.shiftright(n, 1)
    # Of an odd number of words both halves are equally long.
    return F.when(n.bitwiseAND(1) == 1, F.array(*ends(half))).otherwise(F.array(*ends(half), *ends(half - 1)))


def _n_words(words: Column) -> Column:
    return (F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("int")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, at, words, h): every line that is not blank; at counts from 0; lines with equal h have equal words."""
    lines = docs.filter("text is not null").select("doc_id", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    lines = lines.filter(F.trim("line", F.lit(_BLANKS)) != "").select("doc_id", "at", _normal(F.col("line")).alias("words"))
    return lines.withColumn("h", F.xxhash64("words"))


def _marked(ids: Column) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(MARKS)).cast("int")


def _marks(frame: DataFrame, ids: str) -> DataFrame:
    """Hash buckets of ``ids``, at most MARKS rows: a filter of bounded size that passes all of them and few others."""
    return F.broadcast(frame.select(_marked(F.col(ids)).alias("mark")).distinct())


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one inserted, deleted or replaced word."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    differs = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x != y)
    at = F.array_position(differs, True).cast("int")  # 0: the shorter is a prefix

    def tail(w: Column, skip: int) -> Column:
        return F.slice(w, at + skip, F.greatest(F.size(w) - at - skip + 1, F.lit(0)))

    return (F.abs(n - m) <= 1) & (
        (at == 0)
        | F.when(n == m, tail(a, 1) == tail(b, 1)).when(n < m, tail(a, 0) == tail(b, 1)).otherwise(tail(a, 1) == tail(b, 0))
    )


def decided(docs: DataFrame, minimum: int = MIN_WORDS) -> DataFrame:
    """(doc_id, at, kind) of the lines to remove from ``docs`` (doc_id, text): kind ``exact`` where an equal
    line, ``near`` where only a line within the edit bound comes earlier.

    Earlier is by doc_id, then line; a null doc_id comes first. Rows with one doc_id count as the
    same document, so a repeated row is treated as the row it repeats.
    """
    found = occurrences(docs)
    place = F.struct("doc_id", "at")
    halves = F.when(F.col("n") >= minimum, _half_keys(F.col("words"), F.col("n")))
    keyed = found.withColumn("n", _n_words(F.col("words"))).select("doc_id", "at", "h", halves.alias("halves"))
    first = cut_lineage(keyed.groupBy("h").agg(F.min(place).alias("first"), F.first("halves").alias("halves")))

    # Lines with a half that another line has too.
    by_half = first.filter("halves is not null").select("h", F.explode("halves").alias("half"))
    common = by_half.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("half")
    named = cut_lineage(by_half.join(common, "half", "left_semi").select("h").distinct())
    suspects = first.select("h", "first").join(named, "h", "left_semi")
    texts = found.join(_marks(named, "h"), _marked(F.col("h")) == F.col("mark"), "left_semi").select(F.col("h").alias("own"), place.alias("place"), "words")
    suspects = suspects.join(texts, (F.col("h") == F.col("own")) & (F.col("first") == F.col("place")))
    suspects = cut_lineage(suspects.dropDuplicates(["h"]).select("h", "first", F.split("words", " ").alias("words")))

    # Variants: the words without word i. Sums of hashes make each one constant work.
    n = F.size("words")
    variants = suspects.withColumn("placed", F.transform("words", lambda w, i: F.xxhash64(w, i)))
    variants = variants.withColumn("all_placed", _xor(F.col("placed"))).withColumn("all_loose", words_sum(F.col("words")))
    replaced = F.transform("placed", lambda x, i: F.xxhash64(n, i, F.col("all_placed").bitwiseXOR(x)))
    shorter = shorter_keys(F.col("words"), F.col("all_loose"))

    by_replaced = variants.select("h", "first", F.explode(replaced).alias("key"))
    earliest = by_replaced.groupBy("key").agg(F.min(F.struct("first", "h")).alias("best"), F.max("h").alias("high"), F.min("h").alias("low"))
    earliest = earliest.filter("low < high").select("key", "best")
    pairs = by_replaced.join(earliest, "key").filter(F.col("best.first") < F.col("first")).select("h", F.col("best.h").alias("other"))
    by_shorter = variants.select("h", "first", F.explode(shorter).alias("key"))
    itself = variants.select(F.col("h").alias("other"), F.col("first").alias("other_first"), F.xxhash64(n, "all_loose").alias("key"))
    apart = by_shorter.join(itself, "key")
    later, earlier = F.col("other_first") < F.col("first"), F.col("first") < F.col("other_first")
    pairs = pairs.union(apart.filter(later).select("h", "other")).union(apart.filter(earlier).select(F.col("other").alias("h"), F.col("h").alias("other")))
    left = suspects.select("h", F.col("words").alias("a"))
    right = suspects.select(F.col("h").alias("other"), F.col("words").alias("b"))
    near = pairs.distinct().join(left, "h").join(right, "other").filter(one_edit(F.col("a"), F.col("b"))).select("h").distinct()
    near = cut_lineage(near).withColumn("near", F.lit(True))

    state = first.select("h", "first").join(near, "h", "left")
    removed = found.select("doc_id", "at", "h").join(state, "h")
    kind = F.when(F.col("first") < place, F.lit("exact")).when(F.col("near"), F.lit("near"))
    return removed.select("doc_id", "at", kind.alias("kind")).filter("kind is not null").distinct()


def _remaining(text: Column, removed: Column) -> Column:
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def deduplicated(docs: DataFrame, minimum: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and any others) as struct ``row``, with text (without the removed lines), n_lines,
    n_exact and n_near (lines removed), one row per row.

    Blank lines stay. A null text stays null with no lines. An empty table gives an empty one.
    """
    lost = decided(docs.select("doc_id", "text"), minimum).groupBy("doc_id").agg(
        F.collect_set("at").alias("removed"),
        F.sum((F.col("kind") == "exact").cast("long")).alias("n_exact"), F.sum((F.col("kind") == "near").cast("long")).alias("n_near"),
    ).withColumnRenamed("doc_id", "lost_id")
    zero = F.lit(0).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    lines = F.when(F.col("text").isNull(), zero).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines")
    # Only rows that may have lost lines are shuffled.
    lost = cut_lineage(lost)
    marks, mark = _marks(lost, "lost_id"), _marked(F.col("doc_id")) == F.col("mark")
    touched = rows.join(marks, mark, "left_semi").join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left")
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(_remaining(F.col("text"), F.col("removed")))
    touched = touched.select("row", text.alias("text"), lines, F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"))
    whole = rows.join(marks, mark, "left_anti").select("row", "text", lines, zero.alias("n_exact"), zero.alias("n_near"))
    return touched.union(whole)
