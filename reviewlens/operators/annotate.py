"""Annotation tables: automatic labels, edits, and comparing annotators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.functions import text as tx
from reviewlens.operators import metrics
from reviewlens.operators.net import AspectNetModel
from reviewlens.schema import ANNOTATION_ASPECTS, SENTIMENTS


def classify(
    df: DataFrame,
    features: PipelineModel,
    net: AspectNetModel,
    text: str = "review",
    clean: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``codes``: seven annotation codes per row, from the annotation cleaner and a network."""
    cleaned = tx.clean_annotation(text) if clean is None else clean
    prepared = df.select(*keep, F.coalesce(cleaned, F.lit("")).alias("cmt"))
    scored = net.transform(features.transform(prepared).select(*keep, "features"))
    return scored.select(*keep, F.transform("prediction", lb.training_to_code).alias("codes"))


def _names(codes: str, aspects: Sequence[str]) -> list[Column]:
    return [lb.code_to_sentiment(F.get(codes, F.lit(i))).alias(a) for i, a in enumerate(aspects)]


def auto_label(
    df: DataFrame,
    features: PipelineModel,
    net: AspectNetModel,
    key: str = "id",
    text: str = "review",
    ids: DataFrame | None = None,
    aspects: Sequence[str] = ANNOTATION_ASPECTS,
) -> DataFrame:
    """Overwrite the labels of every row, or of the rows whose ``key`` is in ``ids``.

    Scoring all rows keeps them where they are. For ``ids`` only the chosen rows are scored.
    """
    if ids is None:
        rest = [c for c in df.columns if c not in aspects]
        scored = classify(df, features, net, text, keep=rest)
        return scored.select(*rest, *_names("codes", aspects)).select(*df.columns)
    chosen = df.join(ids.select(key).distinct(), key, "left_semi")
    fresh = classify(chosen, features, net, text, keep=[key])
    joined = df.join(fresh, key, "left")
    # A fresh null means "not mentioned", so membership and not nullness decides.
    return joined.select(*[
        F.when(F.col("codes").isNotNull(), lb.code_to_sentiment(F.get("codes", F.lit(aspects.index(c)))))
        .otherwise(F.col(c)).alias(c) if c in aspects else F.col(c)
        for c in df.columns
    ])


def apply_edits(
    df: DataFrame, edits: DataFrame, key: str = "doc_id", aspects: Sequence[str] = ANNOTATION_ASPECTS
) -> DataFrame:
    """Latest edit per (document, aspect) wins; ``dne`` clears. Edits: key, aspect, sentiment, seq.

    An aspect or sentiment that is not known raises.

    Sequence number and sentiment are packed into one long, so the newest edit is a plain
    maximum: map-side combined, and a document with very many edits sends one row per task.
    """
    code = F.when(F.col("sentiment") == SENTIMENTS[0], F.lit(0))
    for value, name in enumerate(SENTIMENTS[1:], 1):
        code = code.when(F.col("sentiment") == name, F.lit(value))
    code = code.otherwise(F.raise_error(F.concat(F.lit("not a sentiment: "), F.col("sentiment"))))
    name = F.coalesce("aspect", F.lit("null"))
    refused = F.raise_error(F.concat(F.lit("not an aspect: "), name)).cast("long")
    value = F.when(F.col("aspect").isin(list(aspects)), F.col("seq") * 4 + code.cast("long")).otherwise(refused)
    packed = edits.select(key, "aspect", value.alias("_packed"))
    latest = packed.groupBy(key).agg(*[
        F.max(F.when(F.col("aspect") == a, F.col("_packed"))).alias(f"_{a}") for a in aspects
    ], F.max("_packed").alias("_any")).filter(F.col("_any").isNotNull()).drop("_any")
    joined = df.join(latest, key, "left")
    return joined.select(*[
        F.when(F.col(f"_{c}").isNotNull(), lb.code_to_sentiment(F.pmod(f"_{c}", F.lit(4))))
        .otherwise(F.col(c)).alias(c) if c in aspects else F.col(c)
        for c in df.columns
    ])


def document(df: DataFrame, n: int, index: str = "ColumnIndex") -> DataFrame:
    return df.filter(F.col(index) == n)


def with_codes(df: DataFrame, aspects: Sequence[str] = ANNOTATION_ASPECTS, name: str = "codes") -> DataFrame:
    """The aspect columns' sentiments as one array of codes."""
    return df.withColumn(name, F.array(*[lb.sentiment_to_code(a) for a in aspects]))


def _side(annotations: DataFrame, annotator: str, key: str, column: str, name: str) -> DataFrame:
    return annotations.filter(F.col("annotator") == annotator).select(key, F.col(column).alias(name))


def align(
    annotations: DataFrame, true: str, pred: str, key: str = "rec", codes: str = "codes"
) -> DataFrame:
    """(key, y_true, y_pred) of records both annotators have."""
    return _side(annotations, true, key, codes, "y_true").join(
        _side(annotations, pred, key, codes, "y_pred"), key
    )


def misaligned(
    annotations: DataFrame, a: str, b: str, key: str = "rec", review: str = "review"
) -> DataFrame:
    """(key, problem) for records only one annotator has, or whose reviews differ.

    Digests are joined, not texts, so reviews are not shuffled. Two missing reviews are equal.
    """
    digest = F.struct(F.md5(F.col(review).cast("binary")).alias("digest"))
    marked = annotations.select("annotator", key, digest.alias("digest"))
    both = _side(marked, a, key, "digest", "a").join(_side(marked, b, key, "digest", "b"), key, "full_outer")
    # The struct is null where the record is absent, its field where the review is.
    problem = (
        F.when(F.col("a").isNull(), F.lit(f"not in {a}"))
        .when(F.col("b").isNull(), F.lit(f"not in {b}"))
        .when(~F.col("a.digest").eqNullSafe(F.col("b.digest")), F.lit("different review"))
    )
    return both.select(key, problem.alias("problem")).filter(F.col("problem").isNotNull())


def agreement(
    annotations: DataFrame, a: str, b: str, key: str = "rec",
    aspects: Sequence[str] = ANNOTATION_ASPECTS, average: str = "micro",
) -> DataFrame:
    """F1 of two annotators against each other."""
    return metrics.multilabel_f1(align(annotations, a, b, key), average, aspects=aspects)


def benchmark(
    annotations: DataFrame, gold: str, key: str = "rec",
    aspects: Sequence[str] = ANNOTATION_ASPECTS, average: str = "micro",
) -> DataFrame:
    """(annotator, f1) of every other annotator against ``gold``, in one join and one aggregate."""
    truth = _side(annotations, gold, key, "codes", "y_true")
    others = annotations.filter(F.col("annotator") != gold).select(
        "annotator", key, F.col("codes").alias("y_pred")
    )
    return metrics.multilabel_f1(
        others.join(truth, key), average, aspects=aspects, by=["annotator"]
    )


def side_by_side(
    annotations: DataFrame, names: Sequence[str], key: str = "rec", codes: str = "codes", review: str = "review"
) -> DataFrame:
    """One row per record with what each of ``names`` has of it: (key, n_<i>, d_<i>, e_<i>, y_<i>) in the order of the names.

    n is the annotator's number of rows for the record, d and e are two digests of the review (null where it is missing) and
    y the codes. The only shuffle is that of fixed-width columns, combined in every task first: codes travel as one number.
    Of several rows for one record the largest values stay; n tells.
    """
    packed = F.aggregate(F.reverse(codes), F.lit(0).cast("long"), lambda s, c: s * 4 + c.cast("long"))
    text = F.col(review)
    rows = annotations.select(
        "annotator", key, packed.alias("packed"), F.size(codes).alias("width"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("d"), F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("e"),
    )
    own = [F.col("annotator") == name for name in names]
    wide = rows.groupBy(key).agg(F.max("width").alias("width"), *[
        column.alias(f"{c}_{i}") for i, mine in enumerate(own) for c, column in (
            ("n", F.sum(mine.cast("long"))), ("d", F.max(F.when(mine, F.col("d")))),
            ("e", F.max(F.when(mine, F.col("e")))), ("y", F.max(F.when(mine, F.col("packed")))),
        )
    ])
    places = F.sequence(F.lit(0), F.col("width") - 1)

    def unpacked(i: int) -> Column:
        """A code is two bits; 31 of them fit a long."""
        return F.transform(places, lambda j: F.call_function("shiftright", F.col(f"y_{i}"), j * 2).bitwiseAND(F.lit(3)).cast("int"))

    return wide.select(key, *[c for i in range(len(names)) for c in (f"n_{i}", f"d_{i}", f"e_{i}")], *[
        F.when(F.col(f"n_{i}") > 0, unpacked(i)).alias(f"y_{i}") for i in range(len(names))
    ])


def misaligned_side_by_side(wide: DataFrame, names: Sequence[str], gold: str, key: str = "rec") -> DataFrame:
    """(key, annotator, problem) of a ``side_by_side`` table: records only one of an annotator and ``gold`` has, or more than once, or
    whose reviews differ. Two missing reviews are equal."""
    g = list(names).index(gold)
    found = []
    for i, name in enumerate(names):
        if i == g:
            continue
        same = F.col(f"d_{i}").eqNullSafe(F.col(f"d_{g}")) & F.col(f"e_{i}").eqNullSafe(F.col(f"e_{g}"))
        problem = (
            F.when((F.col(f"n_{i}") == 0) & (F.col(f"n_{g}") == 0), None)
            .when(F.col(f"n_{i}") == 0, F.lit(f"not in {name}")).when(F.col(f"n_{g}") == 0, F.lit(f"not in {gold}"))
            .when(F.col(f"n_{i}") > 1, F.lit(f"repeated in {name}")).when(F.col(f"n_{g}") > 1, F.lit(f"repeated in {gold}"))
            .when(~same, F.lit("different review"))
        )
        found.append(F.struct(F.lit(name).alias("annotator"), problem.alias("problem")))
    return wide.select(key, F.inline(F.array(*found))).filter(F.col("problem").isNotNull())
