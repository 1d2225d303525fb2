"""Attach late outcomes to logged predictions.

The service's feedback call sets the outcome on every still-unlabelled
prediction of the customer.  Replayed over time this is a forward as-of
join: each prediction takes the earliest feedback of its customer at or
after its own time (ties by feedback id); the first label wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import forward_asof


def attach_outcomes(log: DataFrame, fb: DataFrame, grain: str = "day") -> DataFrame:
    """JOIN-1: log + actual_outcome, feedback_date, feedback_id (nulls when unlabelled)."""
    m = forward_asof(log, fb.select("customer_id", "feedback_ts", "feedback_id", "actual_outcome"),
                     "customer_id", F.col("timestamp"), "feedback_ts", ["feedback_id"], grain)
    return m.select(*log.columns,
                    F.col("_m.actual_outcome").alias("actual_outcome"),
                    F.col("_m.feedback_ts").alias("feedback_date"),
                    F.col("_m.feedback_id").alias("feedback_id"))


def unmatched_feedback(log: DataFrame, fb: DataFrame, grain: str = "day") -> DataFrame:
    """JOIN-2: feedback that labelled no prediction (the service's 404 case)."""
    used = attach_outcomes(log, fb, grain).where(F.col("feedback_id").isNotNull()) \
        .select("feedback_id").distinct()
    return fb.join(used, "feedback_id", "left_anti")
