"""Scoring a stream of reviews with the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reviewlens.operators.net import AspectNetModel
from reviewlens.plans.jobs import Prep, score


def score_stream(
    stream: DataFrame,
    features: PipelineModel,
    net: AspectNetModel,
    prep: Prep | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The same row-by-row plan as ``score``: no state, no watermark, no shuffle."""
    return score(stream, features, net, prep, keep)


def write_scores(
    scored: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "10 seconds"
) -> StreamingQuery:
    """Append scored rows as parquet, exactly once per input row."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.outputMode("append").trigger(**trigger).start()
