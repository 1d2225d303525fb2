"""Prediction-log KPIs, business return and daily series.

Every function reads the log once through a look-back filter on the event
time (pushed into the scan; with a date-partitioned log also pruned) and
aggregates with partial + final hash aggregation.  Results are one-row
DataFrames; a window with no rows gives total 0 and null rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import RISK_LOW_MAX, RISK_MEDIUM_MAX, try_div
from ..sources.tables import as_of_lit
from .metrics import roc_auc

# Business assumptions of the return calculation.
AVG_LOAN_AMOUNT = 20000
DEFAULT_COST_RATE = 0.60
GOOD_CUSTOMER_MARGIN = 0.05
MANUAL_REVIEW_COST = 50
COST_PER_PREDICTION = 0.10
BASELINE_PRECISION = 0.161
CURRENT_PRECISION_CLAIM = 0.372


def lookback(log: DataFrame, days: int, as_of=None) -> DataFrame:
    """SRC-3: rows with timestamp >= as_of - days."""
    now = as_of if as_of is not None else as_of_lit()
    return log.where(F.col("timestamp") >= now - F.make_dt_interval(days=F.lit(days)))


def _decision_counts():
    d = F.col("decision")
    return [F.count_if(d == "APPROVE").alias("approved"),
            F.count_if(d == "REJECT").alias("rejected"),
            F.count_if(d == "REVIEW").alias("reviews")]


def performance_metrics(log: DataFrame, days_back: int = 7, as_of=None) -> DataFrame:
    """AGG-13..16 + MON-1 in one row."""
    w = lookback(log, days_back, as_of)
    p = F.col("probability")
    lab = F.col("actual_outcome").isNotNull()
    pred, y = F.col("prediction"), F.col("actual_outcome")
    conf = F.col("confidence_level")
    a = w.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg(p).alias("avg_probability"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        *_decision_counts(),
        F.count_if(p <= RISK_LOW_MAX).alias("n_low"),
        F.count_if((p > RISK_LOW_MAX) & (p <= RISK_MEDIUM_MAX)).alias("n_medium"),
        F.count_if(p > RISK_MEDIUM_MAX).alias("n_high"),
        F.count_if(conf == "HIGH").alias("n_conf_high"),
        F.count_if(conf == "MEDIUM").alias("n_conf_medium"),
        F.count_if(conf == "LOW").alias("n_conf_low"),
        F.count_if(lab).alias("labeled_samples"),
        F.count_if(lab & (y == 1) & (pred == 1)).alias("tp"),
        F.count_if(lab & (y == 0) & (pred == 1)).alias("fp"),
        F.count_if(lab & (y == 1) & (pred == 0)).alias("fn"),
        F.count_if(lab & (y == 0) & (pred == 0)).alias("tn"),
    )
    auc = roc_auc(w.where(lab), "actual_outcome", "probability").select(F.col("auc").alias("roc_auc"))
    n = F.col("total_predictions")

    def share(c):
        return try_div(F.col(c), n)

    has_lab = F.col("labeled_samples") > 0
    return a.crossJoin(auc).select(
        F.lit(days_back).alias("period_days"),
        n.cast("bigint").alias("total_predictions"),
        "avg_probability", "avg_processing_time_ms",
        share("approved").alias("approval_rate"),
        share("rejected").alias("rejection_rate"),
        share("reviews").alias("review_rate"),
        share("n_low").alias("low_risk"),
        share("n_medium").alias("medium_risk"),
        share("n_high").alias("high_risk"),
        share("n_conf_high").alias("conf_high"),
        share("n_conf_medium").alias("conf_medium"),
        share("n_conf_low").alias("conf_low"),
        F.when(has_lab, F.coalesce(try_div("tp", F.col("tp") + F.col("fp")), F.lit(0.0))).alias("precision"),
        F.when(has_lab, F.coalesce(try_div("tp", F.col("tp") + F.col("fn")), F.lit(0.0))).alias("recall"),
        F.when(has_lab, F.coalesce(try_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                                   F.lit(0.0))).alias("f1_score"),
        F.when(has_lab, F.col("roc_auc")).alias("roc_auc"),
        F.col("labeled_samples").cast("bigint").alias("labeled_samples"),
    )


def confidence_distribution(log: DataFrame, days_back: int = 7, as_of=None) -> DataFrame:
    """AGG-16: level -> count and share of the look-back rows."""
    w = lookback(log, days_back, as_of)
    g = w.groupBy("confidence_level").agg(F.count(F.lit(1)).alias("n"))
    tot = w.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(tot)).select(
        "confidence_level", F.col("n").cast("bigint").alias("n"), try_div("n", "total").alias("share"))


def lifetime_stats(log: DataFrame) -> DataFrame:
    """AGG-17: whole-log counts; averages default to 0, approval rate 0 on an empty log."""
    a = log.agg(F.count(F.lit(1)).alias("total_predictions"),
                F.coalesce(F.avg("probability"), F.lit(0.0)).alias("avg_probability"),
                *_decision_counts(),
                F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)).alias("avg_processing_time_ms"))
    return a.select(F.col("total_predictions").cast("bigint").alias("total_predictions"), "avg_probability",
                    F.col("approved").cast("bigint").alias("approvals"),
                    F.col("rejected").cast("bigint").alias("rejections"),
                    F.col("reviews").cast("bigint").alias("reviews"),
                    F.coalesce(try_div("approved", "total_predictions"), F.lit(0.0)).alias("approval_rate"),
                    "avg_processing_time_ms")


def roi_metrics(log: DataFrame, days_back: int = 30, as_of=None) -> DataFrame:
    """AGG-18..22: decisions, costs, savings over labelled rows, baseline gain, efficiency."""
    w = lookback(log, days_back, as_of)
    lab = F.col("actual_outcome").isNotNull()
    pred, y = F.col("prediction"), F.col("actual_outcome")
    a = w.agg(F.count(F.lit(1)).alias("n"), *_decision_counts(),
              F.avg("processing_time_ms").alias("avg_processing_time_ms"),
              F.count_if(lab).alias("labeled"),
              F.count_if(lab & (pred == 1) & (y == 1)).alias("tp"),
              F.count_if(lab & (pred == 1) & (y == 0)).alias("fp"))
    n = F.col("n")
    has_lab = F.col("labeled") > 0
    api = n * COST_PER_PREDICTION
    review = F.col("reviews") * MANUAL_REVIEW_COST
    prevented = F.col("tp") * AVG_LOAN_AMOUNT * DEFAULT_COST_RATE
    opportunity = F.col("fp") * AVG_LOAN_AMOUNT * GOOD_CUSTOMER_MARGIN
    precision = F.coalesce(try_div("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    improvement = (precision - BASELINE_PRECISION) / BASELINE_PRECISION
    return a.select(
        F.lit(days_back).alias("period_days"),
        n.cast("bigint").alias("total_predictions"),
        F.col("approved").cast("bigint").alias("approved"),
        F.col("rejected").cast("bigint").alias("rejected"),
        F.col("reviews").cast("bigint").alias("reviews"),
        api.cast("double").alias("api_processing_cost"),
        review.cast("double").alias("manual_review_cost"),
        (api + review).cast("double").alias("total_operational_cost"),
        F.when(has_lab, F.col("tp")).cast("bigint").alias("defaults_prevented"),
        F.when(has_lab, prevented).cast("double").alias("default_cost_prevented"),
        F.when(has_lab, F.col("fp")).cast("bigint").alias("good_customers_rejected"),
        F.when(has_lab, opportunity).cast("double").alias("opportunity_cost"),
        F.when(has_lab, prevented - opportunity).cast("double").alias("net_savings"),
        F.when(has_lab, F.col("labeled")).cast("bigint").alias("labeled_sample_size"),
        F.when(has_lab, precision).alias("current_precision"),
        F.when(has_lab, improvement).alias("precision_improvement"),
        F.when(has_lab, improvement * prevented).cast("double").alias("estimated_additional_savings"),
        try_div(F.col("approved") + F.col("rejected"), n).alias("automation_rate"),
        try_div("reviews", n).alias("manual_review_rate"),
        "avg_processing_time_ms",
        (n / F.lit(days_back)).cast("double").alias("daily_prediction_volume"),
    )


def daily_series(log: DataFrame, days_back: int = 30, as_of=None) -> DataFrame:
    """AGG-24: per-day volume and mean latency behind the dashboard panels."""
    w = lookback(log, days_back, as_of)
    return w.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).cast("bigint").alias("predictions"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"))


def daily_snapshot(log: DataFrame) -> DataFrame:
    """SNK-6: the performance_metrics table, one row per day.

    ``avg_confidence`` has no formula in the reference; here it is the mean
    of max(p, 1 - p), the probability mass of the predicted side.
    """
    lab = F.col("actual_outcome").isNotNull()
    pred, y = F.col("prediction"), F.col("actual_outcome")
    g = log.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(lab & (y == 1) & (pred == 1)).alias("tp"),
        F.count_if(lab & (y == 0) & (pred == 1)).alias("fp"),
        F.count_if(lab & (y == 1) & (pred == 0)).alias("fn"),
        F.count_if(F.col("decision") == "APPROVE").alias("approved"),
        F.avg(F.greatest(F.col("probability"), 1 - F.col("probability"))).alias("avg_confidence"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("date", F.col("total_predictions").cast("bigint").alias("total_predictions"),
                    F.coalesce(try_div(tp, tp + fp), F.lit(0.0)).alias("precision_score"),
                    F.coalesce(try_div(tp, tp + fn), F.lit(0.0)).alias("recall_score"),
                    F.coalesce(try_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
                    try_div("approved", "total_predictions").alias("approval_rate"),
                    "avg_confidence")
