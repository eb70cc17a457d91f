import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from reviewlens.operators import descent
from reviewlens.operators import kernels as kn
from reviewlens.operators.net import AspectNet

ARCHS = ["mlp", "rnn", "gru", "lstm"]
SCHEMA = T.StructType([
    T.StructField("features", VectorUDT()), T.StructField("label", T.ArrayType(T.FloatType())), T.StructField("at", T.StringType()),
])


def rows():
    rng = np.random.default_rng(4)
    out = []
    for k in range(700):
        x = rng.normal(size=6)
        y = [float(x[0] - x[3]), float(x[1])]
        v = Vectors.dense(x) if k % 2 else Vectors.sparse(6, [0, 1, 3], [x[0], x[1], x[3]])
        out.append((v, y, "own"))
    return out + out[:50]


@pytest.fixture(scope="module")
def small_parts():
    keep = descent.PART, descent.FAN_IN, descent.CHUNK
    descent.PART, descent.FAN_IN, descent.CHUNK = 64, 3, 5
    yield
    descent.PART, descent.FAN_IN, descent.CHUNK = keep


@pytest.mark.parametrize("arch", ARCHS)
def test_the_sum_of_parts_is_the_gradient_of_all_rows(spark, arch, small_parts):
    data = rows()
    table = descent.numbered(spark.createDataFrame(data, SCHEMA).repartition(3), "features", "label", 1)
    assert sorted(r["at"] for r in table.select("at").collect()) == list(range(len(data)))
    w = {k: v.astype(np.float64) for k, v in kn.initial(arch, 6, (5, 4), 2, 1).items()}
    loss, grad = descent.gradient(table, arch, w, 0, len(data))
    x = np.array([v.toArray() for v, _, _ in data], np.float32).astype(np.float64)
    y = np.array([np.array(y, np.float32) for _, y, _ in data], np.float64)
    want_loss, want = kn.gradients(arch, w, np.arange(6), x, y)
    assert abs(loss - want_loss) < 1e-12 and set(grad) == set(want)
    for name in want:
        assert np.allclose(grad[name], want[name], rtol=0, atol=1e-13)
    # A part of the rows: just those numbers.
    some = {r["at"]: r["y"] for r in table.select("at", "y").collect() if 100 <= r["at"] < 333}
    out = kn.forward(arch, w, np.arange(6), np.zeros((1, 6)))[0]
    assert out.shape == (1, 2) and len(some) == 233
    assert descent.gradient(table, arch, w, 100, 333)[0] > 0


@pytest.mark.parametrize("arch", ["mlp", "lstm"])
def test_layouts_give_the_same_weights_to_the_last_bit(spark, arch, small_parts):
    data = rows()
    fitted = []
    for parts in (1, 2, 7):
        df = spark.createDataFrame(data[::-1] if parts == 2 else data, SCHEMA).repartition(parts)
        fitted.append(AspectNet(arch=arch, hidden=[8, 4], maxEpoch=2, syncRows=200, seed=9).fit(df))
    for other in fitted[1:]:
        assert other.history == fitted[0].history
        for name, w in fitted[0].weights.items():
            assert np.array_equal(w, other.weights[name])
    assert fitted[0].history[1] < fitted[0].history[0]


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no training rows"):
        AspectNet(arch="rnn", hidden=[4], syncRows=10).fit(spark.createDataFrame([], SCHEMA))


def test_small_steps_cost_no_job_each(spark, monkeypatch):
    """75 steps of one part each, in far fewer jobs; the weights are those of steps put together from several parts."""
    sc, df = spark.sparkContext, spark.createDataFrame(rows(), SCHEMA)
    net = AspectNet(arch="gru", hidden=[8], maxEpoch=1, syncRows=10, seed=9, dropout=0.0)
    monkeypatch.setattr(descent, "RUN", 300)
    sc.setJobGroup("small steps", "")
    fitted = net.fit(df)
    jobs = len(sc.statusTracker().getJobIdsForGroup("small steps"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 75
    monkeypatch.setattr(descent, "PART", 4)
    for name, w in net.fit(df).weights.items():
        assert np.allclose(w, fitted.weights[name], rtol=0, atol=1e-6)
