"""Drift tests, alert rules, health status and model status.

All inputs are one-row KPI frames (``monitor``) or the few drift rows, so
the rules are column expressions over tiny frames; the heavy lifting is
the single look-back scan behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import severity_from_p
from ..sources.tables import as_of_lit
from ..session import written
from .metrics import ks_of_counts
from .score_store import LATENCY, PROBABILITY

# Monitoring limits and messages.
PRECISION_MIN = 0.35
F1_MIN = 0.20
VOLUME_CHANGE_MAX = 0.30
RESPONSE_TIME_MAX_MS = 500
HEALTH_RESPONSE_TIME_MS = 200
DRIFT_P = 0.05
MIN_DRIFT_ROWS = 10
MIN_RECENT_LATENCY_ROWS = 5
HISTORY_DAYS = 30
ALERT_FIELDS = ["type", "severity", "message", "value", "threshold"]


def detect_drift(log: DataFrame, days_back: int = 7, baseline_days: int = 30, as_of=None) -> DataFrame:
    """MON-2..4: KS drift of probability and latency, recent vs baseline window.

    One scan covers both windows (a period flag) and gives one row per metric
    and distinct value, from which ``drift_of_counts`` tests both metrics.
    """
    now = as_of if as_of is not None else as_of_lit()
    recent = now - F.make_dt_interval(days=F.lit(days_back))
    base = now - F.make_dt_interval(days=F.lit(baseline_days))
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in (PROBABILITY, LATENCY)])
    scan = log.where(F.col("timestamp") >= base).select((F.col("timestamp") >= recent).alias("recent"), F.inline(metrics))
    return drift_of_counts(scan.groupBy("metric", "value").agg(F.count_if("recent").alias("c1"), F.count_if(~F.col("recent")).alias("c0")))


def drift_of_counts(counts: DataFrame) -> DataFrame:
    """The drift rows of (metric, value, c1 recent, c0 baseline); a null value counts rows without the metric.

    Rows: (metric, ks_statistic, p_value, drift_detected, severity,
    recent_samples, baseline_samples); none when either window has fewer
    than 10 rows; no latency row unless more than 5 recent latencies exist.
    """
    counts = written(counts, "drift-counts")
    p, known = F.col("metric") == PROBABILITY, F.col("value").isNotNull()
    samples = counts.agg(F.sum(F.when(p, F.col("c1"))).cast("bigint").alias("recent_samples"), F.sum(F.when(p, F.col("c0"))).cast("bigint").alias("baseline_samples"),
                         F.coalesce(F.sum(F.when(~p & known, F.col("c1"))), F.lit(0)).alias("_rl"))
    enough = (F.col("recent_samples") >= MIN_DRIFT_ROWS) & (F.col("baseline_samples") >= MIN_DRIFT_ROWS)
    # two rows, each with the one row of sample sizes
    k = ks_of_counts(counts.where(known)).crossJoin(F.broadcast(samples)).where(
        enough & ((F.col("metric") == PROBABILITY) | (F.col("_rl") > MIN_RECENT_LATENCY_ROWS)))
    name = F.when(F.col("metric") == PROBABILITY, F.lit("probability_drift")).otherwise(F.lit("processing_time_drift"))
    return k.select(name.alias("metric"), "ks_statistic", "p_value", (F.col("p_value") < DRIFT_P).alias("drift_detected"),
                    severity_from_p("p_value").alias("severity"), "recent_samples", "baseline_samples")


def _pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def _alert(cond: Column, type_: str, severity, message: Column, value: Column, threshold) -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return F.when(cond, F.struct(F.lit(type_).alias("type"), sev.alias("severity"), message.alias("message"),
                                 value.cast("double").alias("value"), thr.alias("threshold")))


# Alert types, severities and texts, and the recommendations below, as the monitor's readers expect them.
def generate_alerts(kpis: DataFrame, history_total: DataFrame) -> DataFrame:
    """MON-5..7: alert rows from a KPI row and the 30-day prediction count.

    ``history_total`` is a one-row frame with ``history_predictions``.
    Missing latency means no latency alert (the reference loses every
    alert in that case; not copied).
    """
    row = kpis.crossJoin(history_total)
    p, f1, lat = F.col("precision"), F.col("f1_score"), F.col("avg_processing_time_ms")
    hist = F.col("history_predictions") / F.lit(float(HISTORY_DAYS))
    cur = F.col("total_predictions") / F.col("period_days")
    change = F.abs(cur - hist) / F.when(hist != 0, hist)
    alerts = F.array(
        _alert(p < PRECISION_MIN, "PERFORMANCE_DEGRADATION", "HIGH",
               F.concat(F.lit("Precision dropped to "), _pct(p), F.lit(" (below "), _pct(F.lit(PRECISION_MIN)),
                        F.lit(")")), p, PRECISION_MIN),
        _alert(f1 < F1_MIN, "F1_SCORE_LOW", "MEDIUM",
               F.concat(F.lit("F1-score dropped to "), _pct(f1), F.lit(" (below "), _pct(F.lit(F1_MIN)), F.lit(")")),
               f1, F1_MIN),
        _alert(lat > RESPONSE_TIME_MAX_MS, "SLOW_RESPONSE_TIME", "MEDIUM",
               F.concat(F.lit("Average response time: "), F.format_string("%.1f", lat),
                        F.lit(f"ms (above {RESPONSE_TIME_MAX_MS}ms)")), lat, RESPONSE_TIME_MAX_MS),
        _alert(change > VOLUME_CHANGE_MAX, "VOLUME_ANOMALY", "MEDIUM",
               F.concat(F.lit("Prediction volume changed by "), _pct(change), F.lit(" (current: "),
                        F.format_string("%.1f", cur), F.lit("/day, historical: "), F.format_string("%.1f", hist),
                        F.lit("/day)")), change, VOLUME_CHANGE_MAX),
    )
    return row.select(F.explode(alerts).alias("a")).where(F.col("a").isNotNull()).select("a.*")


def drift_alerts(drift: DataFrame) -> DataFrame:
    """MON-8: one DATA_DRIFT alert per drifted metric, severity carried, no value/threshold."""
    d = drift.where(F.col("drift_detected"))
    return d.select(F.lit("DATA_DRIFT").alias("type"), F.col("severity"),
                    F.concat(F.lit("Data drift detected in "), F.regexp_replace("metric", "_", " "),
                             F.lit(" (p-value: "), F.format_string("%.4f", F.col("p_value")), F.lit(")"))
                    .alias("message"),
                    F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"))


def health_status(kpis: DataFrame, alerts: DataFrame, drift: DataFrame, roi: DataFrame) -> DataFrame:
    """MON-10 / MON-11: overall status and recommendations as one row.

    ERROR (no rows in the look-back) stays the highest status; the
    reference lets a drift overwrite it with WARNING (not copied).
    """
    n_alerts = alerts.agg(F.count(F.lit(1)).alias("active_alerts"))
    n_drift = drift.agg(F.count_if(F.col("drift_detected")).alias("drifted_metrics"))
    row = kpis.select("total_predictions").crossJoin(n_alerts).crossJoin(n_drift) \
        .crossJoin(roi.select("manual_review_rate"))
    status = (F.when(F.col("total_predictions") == 0, "ERROR")
              .when((F.col("active_alerts") > 0) | (F.col("drifted_metrics") > 0), "WARNING")
              .otherwise("HEALTHY"))
    recs = F.filter(F.array(
        F.when(F.col("active_alerts") > 0, F.lit("Review and address active alerts")),
        F.when(F.col("manual_review_rate") > 0.3,
               F.lit("High manual review rate - consider threshold optimization"))), lambda x: x.isNotNull())
    recs = F.when(F.size(recs) > 0, recs).otherwise(F.array(F.lit("System operating normally - continue monitoring")))
    return row.select(status.alias("overall_status"), F.col("active_alerts").cast("bigint").alias("active_alerts"),
                      F.col("drifted_metrics").cast("bigint").alias("drifted_metrics"),
                      F.array_join(recs, "; ").alias("recommendations"))


def model_status(kpis: DataFrame, drift: DataFrame) -> DataFrame:
    """MON-12: health score and status with the list of warnings."""
    d = drift.agg(F.count_if(F.col("drift_detected")).alias("drifted"),
                  F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("metric")))).alias("dm"))
    row = kpis.crossJoin(d)
    has_lab = F.col("labeled_samples") > 0
    low_p = has_lab & (F.col("precision") < PRECISION_MIN)
    low_f1 = has_lab & (F.col("f1_score") < F1_MIN)
    slow = F.coalesce(F.col("avg_processing_time_ms") > HEALTH_RESPONSE_TIME_MS, F.lit(False))
    score = (F.lit(100) - F.when(low_p, 30).otherwise(0) - F.when(low_f1, 20).otherwise(0)
             - F.when(slow, 10).otherwise(0) - F.col("drifted") * 15)
    status = (F.when(score >= 90, "EXCELLENT").when(score >= 75, "GOOD").when(score >= 60, "WARNING")
              .otherwise("CRITICAL"))
    warnings = F.concat(
        F.filter(F.array(F.when(low_p, F.lit("Precision below target (35%)")),
                         F.when(low_f1, F.lit("F1-score below minimum (20%)")),
                         F.when(slow, F.lit("Slow response times"))), lambda x: x.isNotNull()),
        F.transform(F.col("dm"), lambda m: F.concat(F.lit("Data drift detected in "), m)))
    return row.select(status.alias("model_status"), score.cast("int").alias("health_score"),
                      F.array_join(warnings, "; ").alias("warnings"),
                      F.col("total_predictions").alias("predictions_last_7_days"),
                      (F.col("total_predictions") / 7.0).alias("avg_daily_volume"),
                      (F.col("drifted") > 0).alias("data_drift_detected"))


def history_total(log: DataFrame, as_of=None, days: int = HISTORY_DAYS) -> DataFrame:
    from .monitor import lookback
    return lookback(log, days, as_of).agg(F.count(F.lit(1)).cast("bigint").alias("history_predictions"))

