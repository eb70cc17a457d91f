"""Accuracy, multi-label F1, agreement and kappa.

Every figure except the per-row F1 comes from one small table: how often each
pair of codes occurs per aspect. Counting it is a map-side combined aggregate
with at most 16 cells per aspect, so nothing but cells is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS

_CODES = (1, 2, 3)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def aspect_correct(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    names: Sequence[str] = ASPECTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Correct rows per aspect after snapping, total rows and accuracy; one aggregate.

    Absent predicted as absent counts as correct. Accuracy is null on no rows.
    """
    hits = [
        F.sum(F.when(F.get(label, F.lit(i)) == lb.snap(F.get(prediction, F.lit(i))), 1).otherwise(0))
        for i in range(len(names))
    ]
    row = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.coalesce(h, F.lit(0)).alias(f"_{n}") for h, n in zip(hits, names, strict=True)],
    )
    cells = F.array(*[F.struct(F.lit(n).alias("aspect"), F.col(f"_{n}").alias("correct")) for n in names])
    return row.select(*by, "total", F.inline(cells)).select(
        *by, "aspect", "correct", "total",
        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).alias("accuracy"),
    )


def accuracy_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    names: Sequence[str] = ASPECTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy per aspect, then a row ``overall`` over all aspects."""
    rows = aspect_correct(df, label, prediction, names, by)
    # The per-aspect rows are len(names) per group; rollup adds the overall row in the same pass.
    keys = [F.col(k) for k in by]
    levels = [[*keys, F.col("aspect")], keys]
    return (
        rows.groupingSets(levels, *keys, F.col("aspect"))
        .agg(
            F.sum("correct").alias("correct"), F.sum("total").alias("total"),
            F.grouping("aspect").alias("_all"),
        )
        .select(
            *by,
            F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("aspect")).alias("aspect"),
            "correct", "total",
            F.when(F.col("total") > 0, F.col("correct") / F.col("total")).alias("accuracy"),
        )
    )


def code_pairs(
    df: DataFrame,
    true: str = "y_true",
    pred: str = "y_pred",
    aspects: Sequence[str] = ANNOTATION_ASPECTS,
    by: Sequence[str] = (),
) -> DataFrame:
    """(aspect, true_code, pred_code, n) from two code arrays."""
    cells = F.array(*[
        F.struct(
            F.lit(a).alias("aspect"),
            F.get(true, F.lit(i)).alias("true_code"),
            F.get(pred, F.lit(i)).alias("pred_code"),
        )
        for i, a in enumerate(aspects)
    ])
    return (
        df.select(*by, F.inline(cells))
        .groupBy(*by, "aspect", "true_code", "pred_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _class_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(aspect, code, tp, true_n, pred_n) for all three codes of every aspect seen."""
    n, t, p = F.col("n"), F.col("true_code"), F.col("pred_code")
    codes = F.explode(F.array(*map(F.lit, _CODES))).alias("code")
    return (
        pairs.select("*", codes)
        .groupBy(*by, "aspect", "code")
        .agg(
            F.sum(F.when((t == F.col("code")) & (p == F.col("code")), n).otherwise(0)).alias("tp"),
            F.sum(F.when(t == F.col("code"), n).otherwise(0)).alias("true_n"),
            F.sum(F.when(p == F.col("code"), n).otherwise(0)).alias("pred_n"),
        )
    )


def f1_per_class(
    df: DataFrame, true: str = "y_true", pred: str = "y_pred",
    aspects: Sequence[str] = ANNOTATION_ASPECTS, by: Sequence[str] = (),
) -> DataFrame:
    """F1 of every (aspect, sentiment) indicator; 0 where neither side has any."""
    counts = _class_counts(code_pairs(df, true, pred, aspects, by), by)
    f1 = _ratio(2.0 * F.col("tp"), F.col("true_n") + F.col("pred_n"))
    return counts.select(
        *by, "aspect", lb.code_to_sentiment("code").alias("sentiment"), "tp", "true_n", "pred_n",
        f1.alias("f1"),
    )


def _row_f1(df: DataFrame, true: str, pred: str, k: int) -> Column:
    def total(cell) -> Column:
        out = F.lit(0)
        for i in range(k):
            out = out + cell(F.get(true, F.lit(i)), F.get(pred, F.lit(i)))
        return out

    both = total(lambda t, p: F.when((t != 0) & (t == p), 1).otherwise(0))
    marks = total(lambda t, p: F.when(t != 0, 1).otherwise(0) + F.when(p != 0, 1).otherwise(0))
    return _ratio(2.0 * both, marks)


def multilabel_f1(
    df: DataFrame,
    average: str = "micro",
    true: str = "y_true",
    pred: str = "y_pred",
    aspects: Sequence[str] = ANNOTATION_ASPECTS,
    by: Sequence[str] = (),
    zero_division: float = 0.0,
    labels: Sequence[int] | None = None,
    sample_weight: str | None = None,
) -> DataFrame:
    """F1 over the (aspect, sentiment) indicators: micro, macro, weighted or samples.

    ``labels`` picks indicators by position (``3 * aspect + code - 1``), ``sample_weight`` names a column
    of row weights, and ``zero_division`` is the value of an F1 without any true or predicted mark, or without any weight.
    """
    if zero_division or labels is not None or sample_weight:
        return _weighted_f1(df, average, true, pred, aspects, by, zero_division, labels, sample_weight)
    if average == "samples":
        scored = df.select(*by, _row_f1(df, true, pred, len(aspects)).alias("f1"))
        return scored.groupBy(*by).agg(F.avg("f1").alias("f1"))
    if average == "micro":
        n, t, p = F.col("n"), F.col("true_code"), F.col("pred_code")
        zero = F.lit(0)
        sums = code_pairs(df, true, pred, aspects, by).groupBy(*by).agg(
            F.coalesce(F.sum(F.when((t != 0) & (t == p), n)), zero).alias("tp"),
            F.coalesce(F.sum(F.when(t != 0, n)), zero).alias("true_n"),
            F.coalesce(F.sum(F.when(p != 0, n)), zero).alias("pred_n"),
        )
        return sums.select(*by, _ratio(2.0 * F.col("tp"), F.col("true_n") + F.col("pred_n")).alias("f1"))
    classes = f1_per_class(df, true, pred, aspects, by)
    if average == "macro":
        return classes.groupBy(*by).agg(F.avg("f1").alias("f1"))
    if average == "weighted":
        total = F.sum("true_n")
        return classes.groupBy(*by).agg(
            _ratio(F.sum(F.col("f1") * F.col("true_n")), total).alias("f1")
        )
    raise ValueError("average must be micro, macro, weighted or samples")


def _weighted_f1(df, average, true, pred, aspects, by, zero_division, labels, sample_weight) -> DataFrame:
    """F1 with options, from one row per record and indicator counted in place."""
    picked = list(range(3 * len(aspects))) if labels is None else list(dict.fromkeys(labels))
    weight = F.col(sample_weight).cast("double") if sample_weight else F.lit(1.0)

    def marks(at: int) -> tuple[Column, Column]:
        place, code = divmod(at, 3)
        return F.get(true, F.lit(place)) == code + 1, F.get(pred, F.lit(place)) == code + 1

    def number(mark: Column) -> Column:
        return F.when(mark, 1.0).otherwise(0.0)

    def f1(tp: Column, both: Column) -> Column:
        return F.when(both > 0, 2.0 * tp / both).otherwise(F.lit(float(zero_division)))

    cells = [(number(t & p), number(t), number(p)) for t, p in map(marks, picked)]
    zero = F.lit(0.0)
    if average == "samples":
        tp, t, p = (sum((c[k] for c in cells), zero) for k in range(3))
        scored = df.select(*by, f1(tp, t + p).alias("f1"), weight.alias("w"))
        mean = F.when(F.sum("w") > 0, F.sum(F.col("f1") * F.col("w")) / F.sum("w")).otherwise(F.lit(float(zero_division)))
        return scored.groupBy(*by).agg(mean.alias("f1"))
    sums = df.groupBy(*by).agg(*[
        F.coalesce(F.sum(c[k] * weight), zero).alias(f"_{name}{i}") for i, c in enumerate(cells) for k, name in enumerate("xtp")
    ])

    def total(name: str) -> Column:
        return sum((F.col(f"_{name}{i}") for i in range(len(cells))), zero)

    each = [f1(F.col(f"_x{i}"), F.col(f"_t{i}") + F.col(f"_p{i}")) for i in range(len(cells))]
    if average == "micro":
        value = f1(total("x"), total("t") + total("p"))
    elif average == "macro":
        value = sum(each, zero) / len(each)
    elif average == "weighted":
        support = sum((e * F.col(f"_t{i}") for i, e in enumerate(each)), zero)
        value = F.when(total("t") > 0, support / total("t")).otherwise(F.lit(float(zero_division)))
    else:
        raise ValueError("average must be micro, macro, weighted or samples")
    return sums.select(*by, value.alias("f1"))


def cohen_kappa(
    df: DataFrame, true: str = "y_true", pred: str = "y_pred",
    aspects: Sequence[str] = ANNOTATION_ASPECTS, by: Sequence[str] = (),
) -> DataFrame:
    """Kappa per aspect and, as aspect ``ALL``, over all decisions together."""
    pairs = code_pairs(df, true, pred, aspects, by)
    keys = [*by, "aspect"]
    levels = pairs.select(
        *by, F.explode(F.array("aspect", F.lit("ALL"))).alias("aspect"), "true_code", "pred_code", "n"
    )
    n, t, p = F.col("n"), F.col("true_code"), F.col("pred_code")
    row = levels.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(t == p, n).otherwise(0)).alias("same"),
        *[F.sum(F.when(t == c, n).otherwise(0)).alias(f"_t{c}") for c in range(4)],
        *[F.sum(F.when(p == c, n).otherwise(0)).alias(f"_p{c}") for c in range(4)],
    )
    total = F.col("n").cast("double")
    observed = F.col("same") / total
    chance = sum(
        (F.col(f"_t{c}") / total * (F.col(f"_p{c}") / total) for c in range(1, 4)),
        F.col("_t0") / total * (F.col("_p0") / total),
    )
    return row.select(*keys, "n", observed.alias("observed"), chance.alias("chance")).select(
        *keys, "n", "observed", "chance",
        F.when(F.col("chance") != 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"),
    )
