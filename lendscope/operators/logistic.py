"""L2 logistic regression by Newton steps over distributed sums.

The objective is |b|^2 / 2 + C sum w log(1 + exp(-s b.x)) with the constant
among the penalised coefficients.  A step is one scan: every task sends the
loss, gradient and Gram matrix of its rows, for all models (left-out folds) at
once; the sums, (d + 1) (d + 2) / 2 numbers a model, come to the driver, which
solves for the step.  A step that raises the loss is halved.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE, MAX_STEPS = 1e-8, 100


def _sums(rows: DataFrame, features: list[str], target: str, outs: list[int], weights: list[tuple[float, float]],
          at: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, Gram matrix) of each model at its coefficients, without the penalty."""
    d = len(features) + 1
    i, j = np.triu_indices(d)
    size = 1 + d + len(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(outs), size))
        for b in batches:
            if not b.num_rows:
                continue
            y, fold = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            x = np.stack([np.ones(len(y)), *(c.to_numpy(zero_copy_only=False) for c in b.columns[2:])], axis=1)
            for m, (out, w, beta) in enumerate(zip(outs, weights, at, strict=True)):
                c = np.where(y == 1, w[1], w[0]) * (fold != out)
                z = x @ beta
                p = 1 / (1 + np.exp(-z))
                total[m, 0] += float((c * (np.logaddexp(0, z) - y * z)).sum())
                total[m, 1:d + 1] += (c * (p - y)) @ x
                total[m, d + 1:] += ((x * (c * p * (1 - p))[:, None]).T @ x)[i, j]
        n, k = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(n.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(total.ravel())], ["model", "cell", "v"])

    src = rows.select(F.col(target).cast("double"), F.col("fold").cast("int"), *[F.col(c).cast("double") for c in features])
    found = np.zeros((len(outs), size))
    # bounded by models x (d + 1) (d + 4) / 2
    for r in src.mapInArrow(run, "model int, cell int, v double").groupBy("model", "cell").agg(F.sum("v").alias("v")).collect():
        found[r["model"], r["cell"]] = r["v"]
    out_ = []
    for row in found:
        h = np.zeros((d, d))
        h[i, j] = h[j, i] = row[d + 1:]
        out_.append((float(row[0]), row[1:d + 1], h))
    return out_


def newton(rows: DataFrame, features: list[str], target: str, outs: list[int], weights: list[tuple[float, float]], c: float,
           steps: int | None = None) -> list[np.ndarray]:
    """Coefficients (constant first) of one model per left-out fold (-1: none), to a gradient of TOLERANCE.

    ``rows`` has a ``fold``; ``weights`` are the class weights of each model.
    ``steps`` takes so many full steps instead.  A table without rows gives zeros.
    """
    d = len(features) + 1
    at = [np.zeros(d) for _ in outs]
    best: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * len(outs)  # loss, coefficients, step from them
    open_ = list(range(len(outs)))
    for turn in range(MAX_STEPS if steps is None else steps):
        found = _sums(rows, features, target, [outs[m] for m in open_], [weights[m] for m in open_], [at[m] for m in open_])
        going = []
        for m, (loss, g, h) in zip(open_, found, strict=True):
            value = c * loss + at[m] @ at[m] / 2
            if steps is None and best[m] is not None and value > best[m][0] * (1 + 1e-14):
                loss0, from_, step = best[m]
                best[m], at[m] = (loss0, from_, step / 2), from_ + step / 2
                going.append(m)
                continue
            gradient = c * g + at[m]
            if steps is None and np.linalg.norm(gradient) <= TOLERANCE * max(1.0, c * float(np.abs(np.diag(h)).sum())):
                continue
            step = -np.linalg.solve(c * h + np.eye(d), gradient)
            best[m], at[m] = (value, at[m], step), at[m] + step
            going.append(m)
        open_ = going
        if not open_:
            break
    return at


class LogisticModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Coefficients over a ``features`` vector: adds ``probability`` and ``prediction``, all in built-in functions."""

    coefficients = Param(Params._dummy(), "coefficients", "constant and coefficients as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, coefficients: str | None = None) -> None:
        super().__init__()
        self._setDefault(coefficients="[0.0]")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, beta: np.ndarray) -> LogisticModel:
        return cls(coefficients=json.dumps([float(b) for b in beta]))

    def _transform(self, df: DataFrame) -> DataFrame:
        constant, *beta = json.loads(self.getOrDefault(self.coefficients))
        products = F.zip_with(vector_to_array("features"), F.array(*[F.lit(b) for b in beta]), lambda x, b: x * b)
        z = F.aggregate(products, F.lit(float(constant)), lambda total, p: total + p)
        p = df.withColumn("_p1", 1 / (1 + F.exp(-z)))
        return p.withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1")))).withColumn(
            "prediction", (F.col("_p1") > 0.5).cast("double")).drop("_p1")
