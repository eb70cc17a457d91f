"""Features whose state is a table of words: word counts and mean word vectors.

Fitting leaves a table with one row per word and transforming joins it, so neither the vocabulary nor the vectors ever
pass through the driver. The table is part of the stored model, as Parquet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators import vectors
from reviewlens.operators.counting import text_terms
from reviewlens.operators.lookup import BROADCAST_BYTES, attach_by_key
from reviewlens.operators.rows import with_row_index
from reviewlens.operators.terms import spaced, term_stats
from reviewlens.session import scratch_path, stored


def ranked_vocabulary(df: DataFrame, size: int | None, min_df: int = 5, text: str = "cmt") -> DataFrame:
    """(term, n, df, rank): the ``size`` most frequent terms of at least ``min_df`` documents, ranked from 0, ties by term.

    Ranks come from a range partitioning and the counts of its parts, so no task holds the vocabulary. Without ``size`` all are ranked.
    """
    kept = term_stats(df, text).filter(F.col("df") >= min_df).withColumn("less", -F.col("n"))
    ranked = with_row_index(kept, order_by=["less", "term"], name="rank").drop("less")
    return ranked if size is None else ranked.filter(F.col("rank") < size)


@F.arrow_udf(VectorUDT())
def _sparse(places: pa.Array, values: pa.Array, size: pa.Array) -> pa.Array:
    """Sparse vectors from sorted places, values and the width."""
    n = len(places)
    return pa.StructArray.from_arrays(
        [pa.array([0] * n, pa.int8()), size.cast(pa.int32()), places.cast(pa.list_(pa.int32())), values.cast(pa.list_(pa.float64()))],
        ["type", "size", "indices", "values"],
    )


class _TextParams(HasInputCol, HasOutputCol):
    """``inputCol`` is text; the words are those of the ML tokenizer."""


class _TableModel(_TextParams, Model, MLWritable, MLReadable):
    """A model whose state is ``table`` (term, n and more); subclasses say how a row's terms become a vector."""

    def __init__(self, table: DataFrame | None = None, width: int = 0):
        super().__init__()
        self.table, self.width = table, width

    def _values(self) -> int:
        """Numbers that the table holds for a term, besides its count and place."""
        return 0

    def _grouped(self, found: DataFrame) -> DataFrame:
        """One row per text (row) that has any term of the table."""
        raise NotImplementedError

    def _vector(self) -> Column:
        """The vector from that row, all null where there is none."""
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        # Its own row number, over a written input, so any columns and repeated rows will do.
        rows = stored(df.select(F.struct(*df.columns).alias("all"), F.monotonically_increasing_id().alias("row")), "rows")
        text = F.coalesce(F.col("all")[self.getInputCol()], F.lit(""))
        terms = text_terms(rows.select("row", spaced(text).alias("text")))
        found = attach_by_key(terms, self.table, "term", "n", BROADCAST_BYTES // (1 + self._values() // 8))
        joined = rows.join(self._grouped(found), "row", "left")
        # With the width in the schema no later stage runs the join to look at a first row.
        sized = self._vector().alias(out, metadata={"ml_attr": {"num_attrs": self.width}})
        return joined.select(*(F.col("all")[c].alias(c) for c in df.columns), sized)

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, instance: _TableModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model = self.instance
        DefaultParamsWriter.saveMetadata(model, path, SparkSession.active().sparkContext, extraMetadata={"width": model.width})
        model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _TableModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        model = self.kind(spark.read.parquet(f"{path}/table"), meta["width"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def _stored(table: DataFrame, name: str) -> DataFrame:
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


class TermCountsModel(_TableModel):
    """Sparse vectors of word counts, placed by rank."""

    def _grouped(self, found: DataFrame) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("at"), F.col("tf").cast("double").alias("value"))))
        return found.groupBy("row").agg(cells.alias("cells"))

    def _vector(self) -> Column:
        places = F.coalesce(F.col("cells.at"), F.array().cast("array<int>"))
        return _sparse(places, F.coalesce(F.col("cells.value"), F.array().cast("array<double>")), F.lit(self.width))


class TermCounts(_TextParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Word counts of the ``vocabSize`` most frequent words found in ``minDF`` documents; 0 takes all."""

    vocabSize = Param(Params._dummy(), "vocabSize", "words kept, 0 for all", TypeConverters.toInt)
    minDF = Param(Params._dummy(), "minDF", "documents a word must be in", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="cmt", outputCol="features_vec", vocabSize=3000, minDF=5):
        super().__init__()
        self._setDefault(inputCol="cmt", outputCol="features_vec", vocabSize=3000, minDF=5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TermCountsModel:
        size = self.getOrDefault(self.vocabSize) or None
        ranked = _stored(ranked_vocabulary(df, size, self.getOrDefault(self.minDF), self.getInputCol()), "vocabulary")
        return self._copyValues(TermCountsModel(ranked, ranked.count()))


class WordVectorsModel(_TableModel):
    """The mean vector of a text's words; a word without a vector counts as zero."""

    def _values(self) -> int:
        return self.width

    def _grouped(self, found: DataFrame) -> DataFrame:
        sums = [F.sum(F.col("tf") * F.get("vector", F.lit(r))).alias(f"c{r}") for r in range(self.width)]
        return found.groupBy("row").agg(F.max("length").alias("length"), *sums)

    def _vector(self) -> Column:
        return array_to_vector(F.array(*[F.coalesce(F.col(f"c{r}") / F.col("length"), F.lit(0.0)) for r in range(self.width)]))


class WordVectors(_TextParams, HasSeed, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Word vectors from co-occurrence, see ``operators.vectors``."""

    vectorSize = Param(Params._dummy(), "vectorSize", "length of a vector", TypeConverters.toInt)
    minCount = Param(Params._dummy(), "minCount", "occurrences a word must have", TypeConverters.toInt)
    window = Param(Params._dummy(), "window", "words to each side", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="cmt", outputCol="features_vec", vectorSize=300, minCount=5, window=5, seed=42):
        super().__init__()
        self._setDefault(inputCol="cmt", outputCol="features_vec", vectorSize=300, minCount=5, window=5, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> WordVectorsModel:
        get = self.getOrDefault
        found = vectors.word_vectors(df, get(self.vectorSize), self.getInputCol(), get(self.window), get(self.minCount), get(self.seed))
        return self._copyValues(WordVectorsModel(_stored(found, "vectors"), get(self.vectorSize)))
