"""Feature pipelines on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, Tokenizer, VectorAssembler, Word2Vec
from pyspark.sql import DataFrame, SparkSession

from reviewlens.operators.wordtables import TermCounts, WordVectors

# Default width per kind of features.
WIDTHS = {"wordcount": 3000, "tfidf": 10000, "word2vec": 300, "termcount": 3000, "wordvectors": 300}


def feature_pipeline(
    kind: str = "tfidf",
    num_features: int | None = None,
    min_df: float = 5,
    w2v_partitions: int | None = None,
    w2v_min_count: int = 5,
) -> Pipeline:
    """``cmt`` to ``features``: word counts, hashed tf-idf or mean word vectors.

    ``termcount`` and ``wordvectors`` are counts and mean vectors whose vocabulary is a table that never passes through the
    driver (``operators.wordtables``): the kinds for large corpora.

    Word vectors are trained on one partition per core and averaged; ``w2v_partitions=1`` trains
    them in a single task, which suits small tables only. Spark keeps the words seen at least
    ``w2v_min_count`` times in the driver, so raise it with the corpus.
    """
    if kind not in WIDTHS:
        raise ValueError(f"kind must be one of {', '.join(WIDTHS)}")
    width = num_features or WIDTHS[kind]
    last = VectorAssembler(inputCols=["features_vec"], outputCol="features")
    if kind == "termcount":
        # Here 0 asks for the whole vocabulary.
        return Pipeline(stages=[TermCounts(vocabSize=width if num_features != 0 else 0, minDF=int(min_df)), last])
    if kind == "wordvectors":
        return Pipeline(stages=[WordVectors(vectorSize=width, minCount=w2v_min_count), last])
    tokenizer = Tokenizer(inputCol="cmt", outputCol="words")
    if kind == "wordcount":
        middle = [CountVectorizer(inputCol="words", outputCol="features_vec", minDF=min_df, vocabSize=width)]
    elif kind == "tfidf":
        middle = [
            HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=width),
            IDF(inputCol="rawFeatures", outputCol="features_vec"),
        ]
    else:
        parts = w2v_partitions or SparkSession.active().sparkContext.defaultParallelism
        middle = [
            Word2Vec(
                inputCol="words", outputCol="features_vec", vectorSize=width, seed=42,
                numPartitions=parts, minCount=w2v_min_count,
            )
        ]
    return Pipeline(stages=[tokenizer, *middle, last])


def build_features(
    train: DataFrame, test: DataFrame, pipeline: Pipeline, keep: tuple[str, ...] = ()
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit on the training rows only and keep ``features`` and ``label`` of both sides."""
    fitted = pipeline.fit(train)
    columns = [*keep, "features", "label"]
    return fitted, fitted.transform(train).select(*columns), fitted.transform(test).select(*columns)
