"""Scoring: align features, apply a fitted model, threshold and ladder.

The model is a fitted ``pyspark.ml`` pipeline; ``transform`` runs inside
the executors, so batch scoring scales with the partitions of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import confidence, decision

DEFAULT_THRESHOLD = 0.5


def align_features(df: DataFrame, feature_list: list[str], keep: list[str] | None = None) -> DataFrame:
    """PRJ-6 / PRJ-7: the training feature list in training order; absent ones are 0.0,
    unknown input columns are dropped."""
    present = set(df.columns)
    cols = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c)
            for c in feature_list]
    return df.select(*(keep or []), *cols)


def apply_decisions(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, p: str = "probability") -> DataFrame:
    """SCO-2 / SCO-3: binary flag at the tuned threshold and the decision ladder.

    The ladder does not look at the flag: p = 0.405 is REJECT even with the
    flag 0 at threshold 0.65.
    """
    return scored.withColumn("prediction", (F.col(p) >= F.lit(threshold)).cast("int")) \
        .withColumn("decision", decision(p)).withColumn("confidence_level", confidence(p))


def score(model, df: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """SCO-1..3: class-1 probability from a fitted pipeline, then flag and ladder."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    out = out.withColumn("probability", vector_to_array("probability")[1])
    drop = [c for c in ("rawPrediction", "prediction", "features", "scaled", "selected") if c in out.columns]
    return apply_decisions(out.drop(*drop), threshold)
