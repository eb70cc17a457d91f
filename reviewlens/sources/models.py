"""Stored feature pipelines and networks."""

from __future__ import annotations

from pyspark.ml import PipelineModel

from reviewlens.operators.net import AspectNetModel


def save_features(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_features(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_net(model: AspectNetModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_net(path: str) -> AspectNetModel:
    return AspectNetModel.load(path)
