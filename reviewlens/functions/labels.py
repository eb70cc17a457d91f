"""Label codecs: label text, training floats, annotation codes and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.schema import ABSENT, ANNOTATION_ASPECTS, ASPECTS, SENTIMENTS

LABEL_PAIR = r"\{(.+?), ([a-z]+)\}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_label(c: Column | str, mode: str = "numeric") -> Column:
    """Label text to float; anything that is not a sentiment means absent.

    ``numeric`` accepts every spelling of -1, 0 and 1; ``exact`` only ``-1.0``, ``0.0``, ``1.0``.
    """
    c = _col(c)
    if mode == "exact":
        known, value = c.isin("0.0", "1.0", "-1.0"), c.try_cast("float")
    elif mode == "numeric":
        value = c.try_cast("float")
        known = value.isin(-1.0, 0.0, 1.0)
    else:
        raise ValueError("mode must be 'numeric' or 'exact'")
    return F.when(known, value).otherwise(F.lit(ABSENT)).cast("float")


def label_array(columns: Sequence[Column | str] = ASPECTS) -> Column:
    return F.array(*[_col(c).cast("float") for c in columns])


def snap(c: Column | str, parity: bool = False) -> Column:
    """Nearest of -2, 0, -1, 1; ties go to the earlier in that order, NaN to 1.

    With ``parity`` a value so large that its distances to -2 and 1 round to the same number
    becomes -2 instead of 1.
    """
    c = _col(c)
    out = (
        F.when(c <= -1.5, F.lit(-2.0)).when(c < -0.5, F.lit(-1.0)).when(c <= 0.5, F.lit(0.0))
        .when(c.isNotNull(), F.lit(1.0))
    )
    if parity:
        x = c.cast("double")
        out = F.when((x > 1) & ~F.isnan(x) & (F.abs(x + 2) == F.abs(x - 1)), F.lit(-2.0)).otherwise(out)
    return out.cast("float")


def snap_predictions(c: Column | str = "prediction", parity: bool = False) -> Column:
    return F.transform(_col(c), lambda x: snap(x, parity))


def blank_absent(c: Column | str) -> Column:
    """``''`` for absent, otherwise the value as text (``'1.0'``)."""
    c = _col(c)
    return F.when(c == ABSENT, F.lit("")).otherwise(c.cast("string"))


def code_to_sentiment(c: Column | str) -> Column:
    c = _col(c)
    names = F.array(*map(F.lit, SENTIMENTS[1:]))
    return F.when(c > 0, F.element_at(names, c.cast("int")))


def sentiment_to_code(c: Column | str, unknown: str = "raise") -> Column:
    """0 for null and ``dne``. A name that is not a sentiment raises, or with ``unknown="null"`` gives null."""
    c = _col(c)
    code = F.when(c.isNull(), F.lit(0))
    for value, name in enumerate(SENTIMENTS):
        code = code.when(c == name, F.lit(value))
    if unknown == "raise":
        code = code.otherwise(F.raise_error(F.concat(F.lit("not a sentiment: "), c)).cast("int"))
    elif unknown != "null":
        raise ValueError("unknown must be 'raise' or 'null'")
    return code.cast("int")


def unknown_sentiments(df: DataFrame, columns: Sequence[str] = ANNOTATION_ASPECTS, keep: Sequence[str] = ()) -> DataFrame:
    """(aspect, sentiment) of cells whose name is not a sentiment, one row each."""
    cells = F.array(*[F.struct(F.lit(c).alias("aspect"), F.col(c).alias("sentiment")) for c in columns])
    return df.select(*keep, F.inline(cells)).filter(F.col("sentiment").isNotNull() & ~F.col("sentiment").isin(list(SENTIMENTS)))


def to_multilabel(codes: Column | str) -> Column:
    """Codes of k aspects to 3k booleans, position ``3j + code - 1``."""
    return F.flatten(F.transform(_col(codes), lambda c: F.array(c == 1, c == 2, c == 3)))


def decode_label_text(df: DataFrame, c: str = "labels", keep: Sequence[str] = ()) -> DataFrame:
    """``{ASPECT, sentiment}, …`` to one column per aspect; the last of a repeated aspect counts."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(c, F.lit(LABEL_PAIR), F.lit(1)).alias("aspect"),
        F.regexp_extract_all(c, F.lit(LABEL_PAIR), F.lit(2)).alias("sentiment"),
    )

    def last(name: str) -> Column:
        same = F.filter("_pairs", lambda p: p["aspect"] == name)
        return F.try_element_at(same, F.lit(-1))["sentiment"].alias(name)

    kept = [k for k in keep if k != c]
    return df.select(*keep, pairs.alias("_pairs")).select(
        *kept, *([c] if c in keep else []), *[last(a) for a in ANNOTATION_ASPECTS]
    )


def unknown_label_names(df: DataFrame, c: str = "labels", keep: Sequence[str] = ()) -> DataFrame:
    """Aspect names in label text that are not among the seven, one row each."""
    names = F.regexp_extract_all(c, F.lit(LABEL_PAIR), F.lit(1))
    return df.select(*keep, F.explode(names).alias("aspect")).filter(
        ~F.col("aspect").isin(ANNOTATION_ASPECTS)
    )


def encode_label_text(columns: Sequence[str] = ANNOTATION_ASPECTS) -> Column:
    return F.concat_ws(
        ", ",
        *[
            F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{{{name}, "), F.col(c), F.lit("}")))
            for c, name in zip(columns, ANNOTATION_ASPECTS, strict=True)
        ],
    )


def code_to_training(c: Column | str) -> Column:
    """Annotation code 0..3 to training value -2, -1, 0, 1."""
    c = _col(c)
    return F.when(c == 0, F.lit(ABSENT)).otherwise(c - 2).cast("float")


def training_to_code(c: Column | str) -> Column:
    """Training value (snapped first) to annotation code."""
    value = snap(c)
    return F.when(value == ABSENT, F.lit(0)).otherwise(value + 2).cast("int")


def to_training(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Annotation columns (sentiment names) to the seven training columns and ``label``."""
    values = [
        code_to_training(sentiment_to_code(name)).alias(aspect)
        for name, aspect in zip(ANNOTATION_ASPECTS, ASPECTS, strict=True)
    ]
    return df.select(*keep, *values).withColumn("label", label_array())
