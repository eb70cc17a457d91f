"""Token statistics behind the bag-of-words and tf-idf features, as plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.operators.counting import word_counts
from reviewlens.operators.lookup import attach_by_key
from reviewlens.session import cut_lineage

# What the tokenizer's \s matches.
_BLANKS = " \t\n\x0b\f\r"


def _body(c: Column | str) -> tuple[Column, Column]:
    """Lower-cased text without trailing blanks, and whether it holds blanks only."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    body = F.rtrim(text, F.lit(_BLANKS))
    return body, (body == "") & (text != "")


def tokenize(c: Column | str) -> Column:
    """Same words as the ML tokenizer: lower-case, split at every blank, keep leading and inner
    empty words, drop trailing ones."""
    body, only_blanks = _body(c)
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(F.split(body, r"\s"))


def spaced(c: Column | str) -> Column:
    """The text between whose single blanks stand the words of ``tokenize``; null if it has none."""
    body, only_blanks = _body(c)
    return F.when(~only_blanks, body)


def count_words(words: Column) -> Column:
    """array<struct<term, tf>>, one element per distinct word.

    Sorting and run lengths inside the row replace a shuffle by (document, word).
    """
    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = F.concat(F.slice(starts, 2, F.size(s)), F.array(F.size(s)))
        return F.zip_with(
            starts, ends,
            lambda i, end: F.struct(F.get(s, i).alias("term"), (end - i).cast("long").alias("tf")),
        )

    # A one-element array binds the sorted words once for the expressions that read them.
    return F.when(F.size(words) == 0, F.array().cast("array<struct<term:string,tf:bigint>>")).otherwise(
        F.element_at(F.transform(F.array(F.sort_array(words)), runs), 1)
    )


def document_terms(df: DataFrame, key: str, text: str = "cmt") -> DataFrame:
    """(key, term, tf) without a shuffle."""
    return df.select(key, F.inline(count_words(tokenize(text))))


def term_stats(df: DataFrame, text: str = "cmt") -> DataFrame:
    """(term, n, df): occurrences and documents per term, counted in every task before they are shuffled."""
    return word_counts(df, spaced(text))


def vocabulary(df: DataFrame, size: int, min_df: int = 5, text: str = "cmt") -> DataFrame:
    """The ``size`` most frequent terms seen in at least ``min_df`` documents, ranked from 0."""
    top = (
        term_stats(df, text).filter(F.col("df") >= min_df)
        .orderBy(F.desc("n"), "term").limit(size)
    )
    # At most ``size`` rows reach this window.
    rank = F.row_number().over(W.orderBy(F.desc("n"), "term")) - 1
    return top.select(rank.alias("rank"), "term", "n", "df")


def term_tfidf(df: DataFrame, key: str, text: str = "cmt") -> DataFrame:
    """(key, term, tf, df, tfidf) with idf = ln((documents + 1) / (df + 1))."""
    documents = df.select(F.count(F.lit(1)).cast("double")).scalar()
    # One row per term, written once; the join below reads it three times.
    stats = cut_lineage(
        term_stats(df, text).select(
            "term", "df", F.log((documents + 1) / (F.col("df") + 1)).alias("idf")
        )
    )
    rows = attach_by_key(document_terms(df, key, text), stats, "term", "df")
    return rows.select(key, "term", "tf", "df", (F.col("tf") * F.col("idf")).alias("tfidf"))
