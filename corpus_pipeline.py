"""Documents to packed training sequences, stage by stage.

Every stage works on all rows that its predecessor kept. Stages but the last return the columns of ``documents``;
the last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, jaccard, language, lines, packing
from reviewlens.session import cut_lineage, scratch_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language; those that language identification rejects go.

    Learned from the stage's own labelled rows (those the held-out rule leaves).
    """
    model = language.fit(docs.filter(language.training_rows(docs)))
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    return language.predict(rows, model).filter(~F.col("rejected")).select("doc_id.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated and nearly repeated lines, the earliest stays; documents of which nothing is left go.

    n_chars is that of the remaining text. Documents that had no line that could repeat stay as they are.
    """
    found = lines.deduplicated(docs)
    lost = (F.col("n_exact") + F.col("n_near")) > 0
    kept = found.filter(~lost | (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != ""))
    changed = {"text": F.col("text"), "n_chars": F.when(lost, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, 80 percent) the row with the smallest doc_id stays.

    Decided by row: of repeated rows one stays, and rows that share a doc_id but not their text are told apart. A null
    doc_id counts last; of rows with equal doc_id in one group any one stays. Rows without words are in no group and stay.
    """
    # The numbers are written with the rows, so that they do not change if a task runs again.
    rows = cut_lineage(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")))
    classes = jaccard.classes(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), words=5, percent=80)
    grouped = classes.filter("n_shingles > 0").select(F.col("doc_id").alias("number"), "component_id")
    # Only groups of more than one row need their doc_ids.
    several = grouped.groupBy("component_id").count().filter("count > 1").select("component_id")
    members = cut_lineage(grouped.join(several, "component_id", "left_semi"))
    ids = rows.select("number", F.col("row.doc_id").isNull().alias("unnamed"), "row.doc_id")
    first = members.join(ids, "number").groupBy("component_id").agg(F.min(F.struct("unnamed", "doc_id", "number")).alias("first"))
    copies = members.join(first.select(F.col("first.number").alias("number")), "number", "left_anti").select("number")
    return rows.join(copies, "number", "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 2048, one row per piece."""
    return packing.packed_documents(docs).drop("loss_tokens")


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Nearest centroids, bin packing and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents below ``sf_dir``; each stage is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
