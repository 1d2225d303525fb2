"""Reports as long tables: (section, metric, value) or (panel, label, value).

The reference renders Markdown / HTML around these figures; only the
figures are produced here (text layout and plotting are out of scope).
All inputs are one-row frames, so the reports are projections plus a
``stack`` unpivot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import try_div
from .monitor import BASELINE_PRECISION

# Fixed value: alerts shown by the history view.
HISTORY_SHOWN = 20


def _long(row: DataFrame, items: list[tuple[str, str, object]], names=("section", "metric", "value")) -> DataFrame:
    """One-row frame -> rows (section, metric, value double)."""
    cols = []
    for sec, name, expr in items:
        e = F.col(expr) if isinstance(expr, str) else expr
        cols += [F.lit(sec), F.lit(name), e.cast("double")]
    return row.select(F.inline(F.array(*[
        F.struct(cols[i].alias(names[0]), cols[i + 1].alias(names[1]), cols[i + 2].alias(names[2]))
        for i in range(0, len(cols), 3)])))


def executive_summary(roi: DataFrame) -> DataFrame:
    """RPT-1: figures of the executive summary (savings rows only with labels)."""
    cost_per = try_div(F.col("total_operational_cost"), F.col("total_predictions"))
    items = [
        ("kpi", "total_predictions", "total_predictions"),
        ("kpi", "automation_rate", "automation_rate"),
        ("kpi", "manual_review_rate", "manual_review_rate"),
        ("kpi", "avg_processing_time_ms", "avg_processing_time_ms"),
        ("financial", "defaults_prevented", "defaults_prevented"),
        ("financial", "default_cost_prevented", "default_cost_prevented"),
        ("financial", "net_savings", "net_savings"),
        ("baseline", "current_precision", "current_precision"),
        ("baseline", "baseline_precision", F.when(F.col("labeled_sample_size") > 0, F.lit(BASELINE_PRECISION))),
        ("baseline", "precision_improvement", "precision_improvement"),
        ("operations", "daily_prediction_volume", "daily_prediction_volume"),
        ("operations", "total_operational_cost", "total_operational_cost"),
        ("operations", "cost_per_prediction", cost_per),
    ]
    return _long(roi, items).where(F.col("value").isNotNull() | (F.col("section") == "kpi"))


def daily_report(kpis_1d: DataFrame, roi_1d: DataFrame, drift: DataFrame) -> DataFrame:
    """RPT-2: 1-day executive figures, KPI figures and the computed drift count."""
    nd = drift.agg(F.count_if(F.col("drift_detected")).alias("drifted_metrics"))
    row = kpis_1d.crossJoin(nd)
    items = [
        ("volume", "total_predictions", "total_predictions"),
        ("volume", "approval_rate", "approval_rate"),
        ("volume", "rejection_rate", "rejection_rate"),
        ("volume", "review_rate", "review_rate"),
        ("risk", "avg_probability", "avg_probability"),
        ("model", "precision", "precision"),
        ("model", "recall", "recall"),
        ("model", "f1_score", "f1_score"),
        ("model", "labeled_samples", F.when(F.col("labeled_samples") > 0, F.col("labeled_samples"))),
        ("system", "avg_processing_time_ms", "avg_processing_time_ms"),
        ("trends", "drifted_metrics", "drifted_metrics"),
    ]
    kp = _long(row, items).where(F.col("value").isNotNull() | F.col("section").isin("volume", "trends"))
    return executive_summary(roi_1d).unionByName(kp)


def dashboard_data(kpis: DataFrame, days_back: int) -> DataFrame:
    """RPT-3: the data behind the dashboard panels."""
    items = [
        ("decision", "APPROVE", "approval_rate"), ("decision", "REJECT", "rejection_rate"),
        ("decision", "REVIEW", "review_rate"),
        ("risk", "low_risk", "low_risk"), ("risk", "medium_risk", "medium_risk"), ("risk", "high_risk", "high_risk"),
        ("confidence", "HIGH", "conf_high"), ("confidence", "MEDIUM", "conf_medium"), ("confidence", "LOW", "conf_low"),
        ("volume", "daily_average", F.col("total_predictions") / F.greatest(F.lit(days_back), F.lit(1))),
        ("quality", "precision", "precision"), ("quality", "recall", "recall"), ("quality", "f1_score", "f1_score"),
    ]
    return _long(kpis, items, names=("panel", "label", "value")).where(
        F.col("value").isNotNull() & ((F.col("panel") != "confidence") | (F.col("value") > 0)))


def monitoring_summary(health: DataFrame, kpis7: DataFrame, roi30: DataFrame) -> DataFrame:
    """MON-13: health, 7-day KPIs and 30-day return in one row."""
    return health.select("overall_status", "active_alerts", "recommendations").crossJoin(
        kpis7.select(F.col("total_predictions").alias("predictions_7d"), F.col("approval_rate").alias("approval_rate_7d"),
                     F.col("avg_probability").alias("avg_probability_7d"),
                     F.col("avg_processing_time_ms").alias("avg_processing_time_ms_7d"),
                     "precision", "recall", "f1_score", "roc_auc", "labeled_samples")).crossJoin(
        roi30.select(F.col("total_predictions").alias("predictions_30d"),
                     F.col("automation_rate").alias("automation_rate_30d"),
                     F.col("net_savings").alias("net_savings_30d")))


def alert_history(sent_alerts: DataFrame, ts_col: str = "timestamp", shown: int = HISTORY_SHOWN) -> DataFrame:
    """MON-14 / WIN-3: newest ``shown`` sent alerts with the total count.

    ``orderBy().limit()`` is a distributed top-k (each partition keeps its
    own top rows); the limit is the feature here, not a cap on the input.
    """
    total = sent_alerts.agg(F.count(F.lit(1)).cast("bigint").alias("total_alerts"))
    top = sent_alerts.orderBy(F.col(ts_col).desc(), F.col("alert_id").desc()).limit(shown)
    return top.crossJoin(total)

