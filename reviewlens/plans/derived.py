"""Review, annotation and edit tables made from the given tables.

The value expressions are SQL text that Spark and the checking engine both read,
so each table has one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions import labels as lb
from reviewlens.schema import ANNOTATION_ASPECTS, ASPECTS
from reviewlens.session import spread_out

# The given text has no Vietnamese, no emoji and hardly a price; every row gets some of them.
# The sixth holds decomposed letters (a + U+0300, o + U+0302 + U+0323).
CMT = """text || CASE doc_id % 8
    WHEN 0 THEN ' #ngon quá #re'
    WHEN 1 THEN ' giá 50k ko đắt'
    WHEN 2 THEN ' quà 20.000đ và 12 dưa'
    WHEN 3 THEN ' ngon 😀👍🏽 #️⃣ 🇻🇳'
    WHEN 4 THEN ' nvien qay oà hoà khoẻ'
    WHEN 5 THEN ' quà ngon uàoà kệ k'
    WHEN 6 THEN ' Hà Nội'
    ELSE '' END"""

_OTHERS = {
    a: f"""CASE ((doc_id * {17 * j + 5}) % 101 + n_chars) % 4
    WHEN 0 THEN '-1.0' WHEN 1 THEN '0.0' WHEN 2 THEN '1.0' ELSE 'nan' END"""
    for j, a in enumerate(ASPECTS) if j > 0
}
LABELS = {
    "general": "CASE WHEN quality IS NULL THEN 'nan' WHEN quality = 1 THEN '1.0' ELSE '-1.0' END",
    **_OTHERS,
}

# Every reader's code of aspect j, from the label text of the review.
CODE = "CASE {a} WHEN '-1.0' THEN 1 WHEN '0.0' THEN 2 WHEN '1.0' THEN 3 ELSE 0 END"
SHIFTED = "CASE WHEN (doc_id + {j}) % {every} = 0 THEN ({code} + 1) % 4 ELSE {code} END"
READERS = {"a1": None, "a2": 7, "gold": 11}

PREDICTION = "CAST({a} AS DOUBLE) + ((doc_id * {k}) % 13 - 6) / CAST(8 AS DOUBLE)"

# Dictionary rows from the part table: short form, expansion, sometimes a third cell.
ACRONYMS = {
    "short": "substr(p_name, 1, 1) || CAST(p_size AS VARCHAR(10))",
    "expansion": "p_name || CAST(p_partkey % 50 AS VARCHAR(10))",
    "note": "CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END",
}
# Fixed rules for the cleaning queries.
RULES = [("kks", "khách sạn"), ("pour", "pour que"), ("nvp", "nhân viên phục vụ")]


def code_sql(reader: str, aspect: str) -> str:
    code = CODE.format(a=aspect)
    every = READERS[reader]
    return code if every is None else SHIFTED.format(j=ASPECTS.index(aspect), every=every, code=code)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """(doc_id, cmt); needs no join. ``spread`` deals rows over the cores, for work that cleans them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (spread_out(docs) if spread else docs).select("doc_id", F.expr(CMT).alias("cmt"))


def reviews(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """(doc_id, [cmt,] seven label columns as text). Without ``text`` the column is never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", *(["text"] if text else []))
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = (spread_out(docs) if text else docs).join(marks, "doc_id", "left")
    return joined.select(
        "doc_id", *([F.expr(CMT).alias("cmt")] if text else []),
        *[F.expr(sql).alias(a) for a, sql in LABELS.items()],
    )


def annotations(spark: SparkSession, sf_dir: str, with_review: bool = False) -> DataFrame:
    """(annotator, rec, [review,] codes), three readers per review from one scan."""
    rows = reviews(spark, sf_dir, with_review)
    readers = F.array(*[
        F.struct(
            F.lit(r).alias("annotator"),
            F.array(*[F.expr(code_sql(r, a)) for a in ASPECTS]).alias("codes"),
        )
        for r in READERS
    ])
    kept = [F.col("cmt").alias("review")] if with_review else []
    return rows.select(F.col("doc_id").alias("rec"), *kept, F.inline(readers))


def annotated(spark: SparkSession, sf_dir: str, reader: str = "a1", text: bool = True) -> DataFrame:
    """(id, review, seven sentiment columns) of one reader."""
    rows = reviews(spark, sf_dir, text)
    return rows.select(
        F.col("doc_id").alias("id"),
        *([F.col("cmt").alias("review")] if text else []),
        *[
            lb.code_to_sentiment(F.expr(code_sql(reader, a))).alias(name)
            for a, name in zip(ASPECTS, ANNOTATION_ASPECTS, strict=True)
        ],
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, prediction) as float arrays."""
    parsed = reviews(spark, sf_dir, text=False).select("doc_id", *[lb.parse_label(a).alias(a) for a in ASPECTS])
    guess = [F.expr(PREDICTION.format(a=a, k=j + 3)).cast("float") for j, a in enumerate(ASPECTS)]
    return parsed.select("doc_id", lb.label_array().alias("label"), F.array(*guess).alias("prediction"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, aspect, sentiment, seq) from the event stream."""
    documents = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    names = F.array(*map(F.lit, ANNOTATION_ASPECTS))
    kinds = F.array(*map(F.lit, ["dne", "negative", "neutral", "positive"]))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % documents).alias("id"),
        F.get(names, (F.col("event_id") % 7).cast("int")).alias("aspect"),
        F.get(kinds, (F.floor(F.col("event_id") / 7) % 4).cast("int")).alias("sentiment"),
        F.col("event_id").alias("seq"),
    )
