"""AspectNet: a small network over feature vectors as a Spark ML estimator.

Training is data-parallel. Each epoch is one Spark job: every partition runs
mini-batch descent from the broadcast weights, the weights are cut into chunks,
and chunks are averaged by a shuffle keyed on the chunk, so that no task and not
the driver ever receives all replicas. Only the averaged weights return.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
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
from pyspark.sql import types as T

from reviewlens.operators import descent
from reviewlens.operators import kernels as kn
from reviewlens.session import cut_lineage

# Hidden sizes per architecture.
HIDDEN = {"mlp": [1000, 256], "rnn": [256], "gru": [256], "lstm": [256]}
CELL_DROPOUT = 0.2

_CHUNK = 16_384  # floats per chunk: an averaging group holds at most FAN_IN of them
_BLOCK = 16  # mini-batches shuffled together within a task
SCORED = 256  # vectors scored at once
_MODEL_LIMIT = 1 << 30  # bytes of weights that may be broadcast
_REPLICA = "name string, chunk int, part int, n long, w binary"


def _chunks(w: kn.Weights) -> Iterator[tuple[str, int, np.ndarray]]:
    for name, array in w.items():
        flat = array.ravel()
        for at, start in enumerate(range(0, len(flat), _CHUNK)):
            yield name, at, flat[start : start + _CHUNK]


FAN_IN = 64  # replicas that one group averages


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean of one chunk over partitions, weighted by rows; fixed order, so repeatable."""
    pdf = pdf.sort_values("part")
    total = np.zeros(len(pdf["w"].iloc[0]) // 4, np.float64)
    for n, raw in zip(pdf["n"], pdf["w"], strict=True):
        total += n * np.frombuffer(raw, np.float32)
    mean = (total / pdf["n"].sum()).astype(np.float32)
    return pd.DataFrame({
        "name": pdf["name"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN_IN,
        "n": pdf["n"].sum(), "w": [mean.tobytes()],
    })


def _assemble(rows, sizes: dict[str, tuple[int, ...]]) -> kn.Weights:
    parts: dict[str, list] = {}
    for name, chunk, values in rows:
        parts.setdefault(name, []).append((chunk, values))
    return {
        name: np.concatenate([v for _, v in sorted(parts[name], key=lambda p: p[0])]).reshape(shape)
        for name, shape in sizes.items()
    }


def _check_size(sizes: dict[str, tuple[int, ...]]) -> None:
    if 4 * sum(int(np.prod(s)) for s in sizes.values()) > _MODEL_LIMIT:
        raise ValueError("the network is too large to broadcast; use fewer features or units")


def _check_loss(history: list[float]) -> None:
    if not np.isfinite(history[-1]):
        raise ArithmeticError(f"loss is {history[-1]} after epoch {len(history)}; lower learningRate or set clipNorm")


class _NetParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    arch = Param(Params._dummy(), "arch", "mlp, rnn, gru or lstm", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "hidden sizes", TypeConverters.toListInt)

    def getArch(self) -> str:
        return self.getOrDefault(self.arch)


class AspectNet(_NetParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Least-squares fit of ``label`` (array<float>) from ``features``.

    ``keyCol`` names a unique column. With it, the rows of every mini-batch are fixed by (seed,
    numPartitions) and not by the layout of the input. Without it rows are dealt out evenly.

    With ``syncRows`` there are no replicas: steps of so many rows use the sum of all tasks' gradients.
    """

    batchSize = Param(Params._dummy(), "batchSize", "rows per step", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "step size", TypeConverters.toFloat)
    maxEpoch = Param(Params._dummy(), "maxEpoch", "passes over the data", TypeConverters.toInt)
    dropout = Param(Params._dummy(), "dropout", "dropout before the output", TypeConverters.toFloat)
    clipNorm = Param(Params._dummy(), "clipNorm", "gradient norm bound, 0 for none", TypeConverters.toFloat)
    numPartitions = Param(Params._dummy(), "numPartitions", "replicas, 0 for one per core", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "unique key column or ''", TypeConverters.toString)
    syncRows = Param(
        Params._dummy(), "syncRows", "rows of a step taken together by all tasks, 0 for averaged replicas", TypeConverters.toInt
    )

    @keyword_only
    def __init__(
        self, *, arch="mlp", hidden=None, batchSize=64, learningRate=0.2, maxEpoch=10, dropout=None,
        clipNorm=1.0, numPartitions=0, keyCol="", syncRows=0, featuresCol="features", labelCol="label",
        predictionCol="prediction", seed=50,
    ):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(
            arch="mlp", batchSize=64, learningRate=0.2, maxEpoch=10, clipNorm=1.0, numPartitions=0,
            keyCol="", syncRows=0, featuresCol="features", labelCol="label", predictionCol="prediction", seed=50,
        )
        self._set(**given)
        name = self.getArch()
        if name not in kn.GATES:
            raise ValueError("arch must be 'mlp', 'rnn', 'gru' or 'lstm'")
        self._setDefault(hidden=HIDDEN[name], dropout=0.0 if name == "mlp" else CELL_DROPOUT)

    def _training_rows(self, df: DataFrame) -> tuple[DataFrame, int, int]:
        """Checkpointed (f, y) in training order, input width and output width."""
        get = self.getOrDefault
        wanted = get(self.numPartitions) or df.sparkSession.sparkContext.defaultParallelism
        rows = df.select(
            F.unwrap_udt(get(self.featuresCol)).alias("f"),
            F.col(get(self.labelCol)).cast("array<float>").alias("y"),
            *([F.col(get(self.keyCol)).alias("key")] if get(self.keyCol) else []),
        )
        if get(self.keyCol):
            # By the whole row: equal keys spread, and rows that tie are equal, so any input layout gives one order.
            spread = F.xxhash64(F.lit(get(self.seed)), "f.indices", "f.values", "y", "key")
            placed = rows.withColumn("h", spread).repartition(wanted, "h")
            placed = placed.sortWithinPartitions("h", "key", "f.indices", "f.values", "y")
        else:
            placed = rows.repartition(wanted)
        placed = cut_lineage(placed.select(kn.plain_vector("f"), "y"))

        def measure(table: DataFrame):
            return (
                table.groupBy(F.spark_partition_id().alias("part"))
                .agg(
                    F.count(F.lit(1)).alias("n"), F.max("f.size").alias("sparse_width"),
                    F.max(F.size("f.values")).alias("dense_width"), F.max(F.size("y")).alias("out"),
                ).collect()
            )

        parts = measure(placed)
        n = sum(p["n"] for p in parts)
        if n == 0:
            raise ValueError("no training rows")
        # Spark keeps the width only in sparse vectors; a dense one is as long as its values.
        width = max(max(p["sparse_width"] or 0, p["dense_width"] or 0) for p in parts)
        return placed, width, max(p["out"] for p in parts)

    def _fit_together(self, df: DataFrame) -> AspectNetModel:
        """Synchronous steps, see ``operators.descent``; the weights do not depend on cores or partitions."""
        get = self.getOrDefault
        arch, hidden, seed = get(self.arch), tuple(get(self.hidden)), get(self.seed)
        rows = descent.numbered(df, get(self.featuresCol), get(self.labelCol), seed)
        found = rows.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.coalesce("f.size", F.size("f.values"))).alias("n_in"), F.max(F.size("y")).alias("n_out")
        ).collect()[0]
        if not found["n"]:
            raise ValueError("no training rows")
        _check_size(kn.shapes(arch, found["n_in"], hidden, found["n_out"]))
        weights, history = kn.initial(arch, found["n_in"], hidden, found["n_out"], seed), []
        for loss, weights in descent.fit(  # noqa: B020
            rows, found["n"], arch, weights, get(self.syncRows), get(self.maxEpoch), get(self.learningRate),
            get(self.clipNorm), get(self.dropout), seed,
        ):
            history.append(loss)
            _check_loss(history)
        return self._copyValues(AspectNetModel({k: v.astype(np.float32) for k, v in weights.items()}, history))

    def _fit(self, df: DataFrame) -> AspectNetModel:
        if self.getOrDefault(self.syncRows) > 0:
            return self._fit_together(df)
        get = self.getOrDefault
        arch, hidden, seed = get(self.arch), tuple(get(self.hidden)), get(self.seed)
        rows, n_in, n_out = self._training_rows(df)
        sizes = kn.shapes(arch, n_in, hidden, n_out)
        _check_size(sizes)
        weights = kn.initial(arch, n_in, hidden, n_out, seed)
        batch, rate, clip = get(self.batchSize), get(self.learningRate), get(self.clipNorm)
        drop = get(self.dropout)
        sc = df.sparkSession.sparkContext
        history = []
        for epoch in range(get(self.maxEpoch)):
            shared = sc.broadcast(weights)

            def replica(batches, shared=shared, epoch=epoch):
                part = TaskContext.get().partitionId()
                rng = np.random.default_rng([seed, epoch, part])
                w = {k: v.copy() for k, v in shared.value.items()}
                seen, loss = 0, 0.0
                for table in kn.rechunk(batches, batch * _BLOCK):
                    x = kn.Rows(table["f"])
                    y = table["y"].combine_chunks().flatten().to_numpy().reshape(len(x), -1)
                    order = rng.permutation(len(x))
                    for start in range(0, len(x), batch):
                        pick = order[start : start + batch]
                        mask = None
                        if drop > 0:
                            kept = rng.random((len(pick), w["wo"].shape[0]), dtype=np.float32) >= drop
                            mask = kept.astype(np.float32) / np.float32(1 - drop)
                        columns, block = x.batch(pick)
                        value, grad = kn.gradients(arch, w, columns, block, y[pick], mask)
                        kn.descend(w, grad, columns, rate, clip)
                        loss += value * len(pick)
                    seen += len(x)
                if not seen:
                    return
                w["loss"] = np.array([loss / seen], np.float32)
                for name, at, values in _chunks(w):
                    yield pa.RecordBatch.from_pydict({
                        "name": [name], "chunk": pa.array([at], pa.int32()),
                        "part": pa.array([part], pa.int32()), "n": [seen],
                        "w": [values.astype(np.float32).tobytes()],
                    })

            replicas, left = rows.mapInArrow(replica, _REPLICA), rows.rdd.getNumPartitions()
            while left > FAN_IN:
                by = ["name", "chunk", F.expr(f"part div {FAN_IN}")]
                replicas, left = replicas.groupBy(*by).applyInPandas(_average, _REPLICA), -(-left // FAN_IN)
            averaged = replicas.groupBy("name", "chunk").applyInPandas(_average, _REPLICA).select("name", "chunk", "w").collect()
            shared.destroy()
            parts = [(r["name"], r["chunk"], np.frombuffer(r["w"], np.float32)) for r in averaged]
            history.append(float(next(v[0] for name, _, v in parts if name == "loss")))
            _check_loss(history)
            weights = _assemble((p for p in parts if p[0] != "loss"), sizes)
        return self._copyValues(AspectNetModel(weights, history))


def _outputs(arch: str, w: kn.Weights, vectors: pa.Array) -> np.ndarray:
    out = np.empty((len(vectors), w["bo"].shape[0]), np.float32)
    # Small blocks bound the dense input of one matrix product, and what is worked out for the vectors' places.
    for start in range(0, len(vectors), SCORED):
        rows = kn.Rows(vectors.slice(start, SCORED))
        out[start : start + SCORED] = kn.forward(arch, w, *rows.batch(np.arange(len(rows))))[0]
    return out


def vector_parts(features: str) -> tuple[Column, Column]:
    """Positions (none for a dense vector) and values of a vector column."""
    v = F.unwrap_udt(features)
    return kn.positions(v), v["values"]


def predict_by_name(spark: SparkSession, nets: Mapping[str, AspectNetModel]):
    """A function of (name, *vector_parts): the output of the network of that name; null for a null name. A task loads only the
    networks that its rows name."""
    shared = {name: (net.getArch(), spark.sparkContext.broadcast(net.weights)) for name, net in nets.items()}

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def predict(names: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
        names, vectors = names.to_pylist(), kn.vectors(indices, values)
        out: list[np.ndarray | None] = [None] * len(names)
        for name in sorted({n for n in names if n is not None}):
            at = [i for i, n in enumerate(names) if n == name]
            arch, weights = shared[name]
            for start in range(0, len(at), SCORED):
                pick = at[start : start + SCORED]
                for i, values in zip(pick, _outputs(arch, weights.value, vectors.take(pa.array(pick))), strict=True):
                    out[i] = values
        return pa.array(out, pa.list_(pa.float32()))

    return predict


class AspectNetModel(_NetParams, Model, MLWritable, MLReadable):
    """Adds ``prediction`` (array<float>); works on tables and streams alike."""

    def __init__(self, weights: kn.Weights | None = None, history: list[float] | None = None):
        super().__init__()
        self.weights = weights or {}
        self.history = history or []
        self._shared = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast(self.weights)
        shared, arch = self._shared, self.getArch()

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def predict(indices: pa.Array, values: pa.Array) -> pa.Array:
            out = _outputs(arch, shared.value, kn.vectors(indices, values))
            offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

        return df.withColumn(
            self.getOrDefault(self.predictionCol), predict(*vector_parts(self.getOrDefault(self.featuresCol)))
        )

    def write(self) -> MLWriter:
        return _NetWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _NetReader()


class _NetWriter(MLWriter):
    def __init__(self, instance: AspectNetModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        net, spark = self.instance, SparkSession.active()
        extra = {"sizes": {k: list(v.shape) for k, v in net.weights.items()}, "history": net.history}
        DefaultParamsWriter.saveMetadata(net, path, spark.sparkContext, extraMetadata=extra)
        rows = [(name, at, values.tobytes()) for name, at, values in _chunks(net.weights)]
        # The size of one network, checked at training time.
        spark.createDataFrame(rows, "name string, chunk int, w binary").write.parquet(f"{path}/weights")


class _NetReader(MLReader):
    def load(self, path: str) -> AspectNetModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        rows = spark.read.parquet(f"{path}/weights").collect()
        parts = [(r["name"], r["chunk"], np.frombuffer(r["w"], np.float32)) for r in rows]
        sizes = {k: tuple(v) for k, v in meta["sizes"].items()}
        net = AspectNetModel(_assemble(parts, sizes), meta["history"])
        net._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(net, meta)
        return net
