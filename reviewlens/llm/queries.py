"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import (
    alignment,
    decontaminate,
    hnsw,
    jaccard,
    language,
    licenses,
    lines,
    packing,
    pii,
    spelling,
    suffix_tree,
    token_files,
    urls,
)
from reviewlens.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard(spark, sf_dir):
    """Components of documents whose four-word shingles agree to 85 percent."""
    return jaccard.classes(_table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op2_pack_documents(spark, sf_dir):
    """All documents' token ids in sequences of at most 2048."""
    return packing.packed_documents(_table(spark, sf_dir, "documents")).drop("loss_tokens")


@query
def op3_url_rules(spark, sf_dir):
    """Block or allow for every page, by rule or by its aliases."""
    return urls.judge(_table(spark, sf_dir, "pages")).drop("component")


@query
def op4_suffix_tree_scores(spark, sf_dir):
    """Scores of all documents, learned from six sevenths of them."""
    docs = _table(spark, sf_dir, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 7
    found = suffix_tree.scores(docs, rest != 2)
    return found.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)))


@query
def op5_hnsw(spark, sf_dir):
    """The 20 nearest vectors of every twentieth."""
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op6_license_scan(spark, sf_dir):
    """Licence phrases and covered template statements in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark, sf_dir):
    """Benchmark items that documents hold."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op8_line_dedup(spark, sf_dir):
    """Lines removed from every document and a digest of what is left."""
    found = lines.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_exact", "n_near", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def op9_language_id(spark, sf_dir):
    """Language of every document, learned from four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = language.predict(docs, language.fit(docs.filter(language.training_rows(docs))))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_personal_data(spark, sf_dir):
    """Personal data spans of every document."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


@query
def op11_token_alignment(spark, sf_dir):
    """Groups and links of two vocabularies' tokens of every document, with corpus-wide counts of the links."""
    path = scratch_path(spark, "aligned")
    found = alignment.aligned(_table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found.select(*(c for c in found.columns if c != "groups"), digest).write.parquet(path)
    rows = spark.read.parquet(path)
    return alignment.with_counts(rows, alignment.link_counts(rows)).drop("row")


@query
def op12_spelling_variants(spark, sf_dir):
    """Frequent words of all documents with the more frequent spelling each goes back to."""
    return spelling.variants(spelling.words(_table(spark, sf_dir, "documents"), noise=199))


@query
def op13_token_files(spark, sf_dir):
    """All documents' token ids written as files and read back."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path, ids=False)
