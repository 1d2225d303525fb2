"""Newton logistic regression against a plain version."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from lendscope.operators import logistic as L


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(500, 3)) * [1, 5, 0.1] + [0, 2, 30]
    y = (rnd.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(int(y[i]), i % 3, *map(float, x[i])) for i in range(500)], "y int, fold int, a double, b double, c double").repartition(4)
    return x, y, df


def plain(x, y, w, c, keep):
    z = np.column_stack([np.ones(len(x)), x])[keep]
    t, s = y[keep], np.where(y == 1, w[1], w[0])[keep]
    b = np.zeros(4)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - 0.5 * np.linalg.solve(c * (z * (s * p * (1 - p))[:, None]).T @ z + np.eye(4), c * z.T @ (s * (p - t)) + b)
    return b


@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_models_of_all_folds_reach_the_minimum(data, c):
    x, y, df = data
    weights = [(1.0, 3.0), (0.7, 1.5), (1.0, 1.0)]
    outs = [0, 2, -1]
    for beta, out, w in zip(L.newton(df, ["a", "b", "c"], "y", outs, weights, c), outs, weights):
        assert np.allclose(beta, plain(x, y, w, c, np.arange(500) % 3 != out), atol=1e-6, rtol=1e-6)


def test_separable_classes_and_no_rows(spark):
    df = spark.createDataFrame([(int(i > 5), 0, float(i)) for i in range(10)], "y int, fold int, a double")
    beta, = L.newton(df, ["a"], "y", [-1], [(1.0, 1.0)], 1e4)
    assert np.isfinite(beta).all() and beta[1] > 1
    assert L.newton(df.limit(0), ["a"], "y", [-1], [(1.0, 1.0)], 1.0)[0].tolist() == [0.0, 0.0]


def test_model_is_saved_and_scores(data, tmp_path):
    x, y, df = data
    beta = np.array([0.5, 1.0, -0.2, 0.01])
    PipelineModel(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), L.LogisticModel.of(beta)]).write().overwrite().save(str(tmp_path / "m"))
    for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect():
        p = 1 / (1 + np.exp(-(beta[0] + np.dot(beta[1:], [r.a, r.b, r.c]))))
        assert r.probability[1] == pytest.approx(p, rel=1e-12) and r.prediction == float(p > 0.5)
