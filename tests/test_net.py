import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.operators import kernels as kn
from reviewlens.operators import net
from reviewlens.operators.net import AspectNet, AspectNetModel, vector_parts

ARCHS = ["mlp", "rnn", "gru", "lstm"]


@pytest.mark.parametrize("arch", ARCHS)
def test_gradients_against_differences(arch):
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in kn.initial(arch, 9, (5, 4), 3, 1).items()}
    columns = np.array([1, 3, 4, 8])
    x, y = rng.normal(size=(6, 4)), rng.normal(size=(6, 3))
    mask = None if arch == "mlp" else (rng.random((6, w["wo"].shape[0])) > 0.3) / 0.7
    _, grad = kn.gradients(arch, w, columns, x, y, mask)

    def loss():
        out, _ = kn.forward(arch, w, columns, x, mask)
        return np.mean((out - y) ** 2)

    for name, g in grad.items():
        target = w[name]
        for spot in np.ndindex(g.shape):
            at = (columns[spot[0]], *spot[1:]) if name == "w0" else spot
            keep, step = target[at], 1e-5
            target[at] = keep + step
            up = loss()
            target[at] = keep - step
            down = loss()
            target[at] = keep
            assert abs((up - down) / (2 * step) - g[spot]) < 1e-6, (name, spot)


def test_rows_read_sparse_and_dense_vectors(spark):
    vectors = [Vectors.sparse(5, [1, 4], [2.0, 3.0]), Vectors.dense([1, 0, 0, 0, 5]), Vectors.sparse(5, [], []), Vectors.sparse(5, [0], [7.0])]
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", VectorUDT())])
    df = spark.createDataFrame(list(enumerate(vectors)), schema).coalesce(1)
    column = df.select(F.unwrap_udt("v").alias("f")).toArrow()["f"]
    for part in (column, column.slice(1, 3)):
        rows = kn.Rows(part)
        dense = np.zeros((len(rows), 5))
        columns, block = rows.batch(np.arange(len(rows)))
        dense[:, columns] = block
        assert dense.tolist() == [v.toArray().tolist() for v in vectors[-len(rows):]]
    columns, block = kn.Rows(column).batch(np.array([3, 0]))
    assert columns.tolist() == [0, 1, 4] and block.tolist() == [[7, 0, 0], [0, 2, 3]]


def test_rechunk_ignores_incoming_sizes():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(a, b), pa.int64())}) for a, b in ((0, 3), (3, 3), (3, 11), (11, 12))]
    assert [t["x"].to_pylist() for t in kn.rechunk(iter(batches), 5)] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]


def separable(spark, n=600, parts=5):
    x = F.array(*[F.when(F.col("id") % 4 == j, 1.0).otherwise(0.0) for j in range(4)])
    y = F.array(*[(F.col("id") % 4 - 2 + j * 0).cast("float") for j in range(7)])
    return spark.range(0, n, 1, parts).select("id", array_to_vector(x).alias("features"), y.alias("label"))


@pytest.mark.parametrize("arch", ARCHS)
def test_loss_falls(spark, arch):
    hidden = [16, 8] if arch == "mlp" else [16]
    net = AspectNet(arch=arch, hidden=hidden, maxEpoch=6, keyCol="id", numPartitions=2, learningRate=1.0, clipNorm=0.0, batchSize=16)
    model = net.fit(separable(spark))
    assert model.history[-1] < 0.5 * model.history[0]


def test_result_depends_on_seed_and_partitions_only(spark):
    def fit(df, **kw):
        return AspectNet(arch="gru", hidden=[8], maxEpoch=2, keyCol="id", **{"numPartitions": 3, **kw}).fit(df)

    a, b = fit(separable(spark)), fit(separable(spark, parts=2).orderBy(F.desc("id")))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)
    c = fit(separable(spark), seed=7)
    assert any(not np.array_equal(a.weights[k], c.weights[k]) for k in a.weights)


def test_repeated_keys_give_the_same_weights_from_any_layout(spark):
    rows = separable(spark, 900).withColumn("id", F.col("id") % 3).collect()
    frames = [spark.createDataFrame(rows, separable(spark).schema).repartition(n) for n in (2, 5)]
    a, b = (AspectNet(arch="gru", hidden=[8], maxEpoch=1, keyCol="id", numPartitions=3).fit(f) for f in frames)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_a_key_holding_most_rows_is_spread(spark):
    # Rows are spread by all they hold; rows equal in everything stay together.
    x = F.array(F.col("id") / 40_000, F.lit(1.0), F.lit(0.0), F.lit(1.0))
    df = separable(spark, 40_000).withColumn("features", array_to_vector(x))
    df = df.withColumn("id", F.when(F.col("id") % 3 != 0, 0).otherwise(F.col("id")))
    placed, width, out = AspectNet(arch="rnn", keyCol="id", numPartitions=8)._training_rows(df)
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 6000 and (width, out) == (4, 7)


def test_save_load_and_pipeline(spark, tmp_path):
    df = separable(spark, 100)
    net = AspectNet(arch="lstm", hidden=[8], maxEpoch=1)
    model = net.fit(df)
    model.save(str(tmp_path / "net"))
    model.write().overwrite().save(str(tmp_path / "net"))
    back = AspectNetModel.load(str(tmp_path / "net"))
    assert back.history == model.history and back.getArch() == "lstm"
    first, second = (m.transform(df).orderBy("id").select("prediction").collect() for m in (model, back))
    assert first == second and len(first[0]["prediction"]) == 7
    fitted = Pipeline(stages=[net]).fit(df)
    fitted.save(str(tmp_path / "pipe"))
    again = PipelineModel.load(str(tmp_path / "pipe"))
    assert again.transform(df).count() == 100


def test_refusals(spark):
    with pytest.raises(ValueError, match="arch"):
        AspectNet(arch="cnn")
    with pytest.raises(ValueError, match="no training rows"):
        AspectNet(arch="rnn").fit(separable(spark).limit(0))
    with pytest.raises(ArithmeticError, match="loss"), np.errstate(all="ignore"):
        big = separable(spark).withColumn("label", F.transform("label", lambda x: x * F.lit(1e30).cast("float")))
        AspectNet(arch="mlp", hidden=[8, 8], maxEpoch=4, learningRate=10.0, clipNorm=0.0).fit(big)


def test_dense_vectors_travel_without_null_lists(spark):
    """Arrow's writer takes time by the square of a batch's null lists."""
    data = [(Vectors.dense([1.0, 0.0, 2.0]),), (Vectors.sparse(3, [1], [4.0]),), (Vectors.sparse(3, [], []),), (None,)]
    df = spark.createDataFrame(data, T.StructType([T.StructField("features", VectorUDT())]))
    table = df.coalesce(1).select(*[c.alias(n) for c, n in zip(vector_parts("features"), ("indices", "values"), strict=True)]).toArrow()
    assert table["indices"].null_count == 0
    rows = kn.Rows(kn.vectors(table["indices"].combine_chunks(), table["values"].combine_chunks()))
    assert rows.lengths.tolist() == [3, 1, 0, 0] and rows.at.tolist() == [0, 1, 2, 1] and rows.values.tolist() == [1, 0, 2, 4]
    plain = df.select(F.unwrap_udt("features").alias("f")).select(kn.plain_vector("f"))
    assert plain.filter("f.indices IS NULL").count() == 0


def test_scoring_holds_the_places_of_few_vectors_at_once():
    rng = np.random.default_rng(3)
    n, k = 4000, 200
    ends = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    places = pa.ListArray.from_arrays(ends, pa.array(np.tile(np.arange(0, 2 * k, 2, dtype=np.int32), n)))
    column = kn.vectors(places, pa.ListArray.from_arrays(ends, pa.array(rng.random(n * k))))
    w = kn.initial("gru", 2 * k, (8,), 3, 1)
    tracemalloc.start()
    out = net._outputs("gru", w, column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    for at in (0, 255, 256, 3999):
        assert np.allclose(net._outputs("gru", w, column.slice(at, 1))[0], out[at], atol=1e-6)
    assert net._outputs("gru", w, column.slice(0, 0)).shape == (0, 3)
