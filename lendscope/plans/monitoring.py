"""RPT-4: one monitoring cycle over the prediction log.

The cycle reads the look-back window of the log once, writes it to the
shared checkpoint folder (every metric then scans that table), evaluates
KPIs, drift, alerts (with cooldown against the alerts already sent),
return, health, report and dashboard figures, and appends them to tables
under ``out_dir``.  Nothing is collected except the one-row status that is
returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..operators import monitor, report
from ..operators.cooldown import cooldown
from ..session import written

CYCLE_DAYS = 30


def run_monitoring_cycle(log: DataFrame, out_dir: str, as_of, sent_alerts: DataFrame | None = None,
                         days_back: int = 7) -> dict:
    """Evaluate and persist one cycle; returns the health row as a dict."""
    w = written(monitor.lookback(log, CYCLE_DAYS, as_of), "cycle-log")
    # few rows, read by several consumers: computed once
    kpis = written(monitor.performance_metrics(w, days_back, as_of), "cycle-kpis")
    drift = written(AL.detect_drift(w, days_back, CYCLE_DAYS, as_of), "cycle-drift")
    raised = AL.generate_alerts(kpis, AL.history_total(w, as_of)).unionByName(AL.drift_alerts(drift))
    roi = written(monitor.roi_metrics(w, CYCLE_DAYS, as_of), "cycle-roi")
    health = written(AL.health_status(kpis, raised, drift, roi), "cycle-health")

    # cooldown against what was already sent: earlier sends take part in the
    # fold, only the new alerts are written
    new = raised.select(F.monotonically_increasing_id().alias("alert_id"), "*", as_of.alias("timestamp"))
    new = written(new, "cycle-alerts")
    hist = sent_alerts.select(F.lit(None).cast("long").alias("alert_id"), "type", "timestamp") \
        if sent_alerts is not None else None
    pool = new.select("alert_id", "type", "timestamp")
    if hist is not None:
        # history ids are negative so they never collide with the new ones
        pool = hist.withColumn("alert_id", -1 - F.monotonically_increasing_id()).unionByName(pool)
    flags = cooldown(pool).where(F.col("sent")).select("alert_id")
    sent = new.join(flags, "alert_id", "left_semi")

    stamp = as_of.alias("cycle_at")
    health.select(stamp, "*").write.mode("append").parquet(f"{out_dir}/health")
    sent.write.mode("append").parquet(f"{out_dir}/alerts")
    report.daily_report(monitor.performance_metrics(w, 1, as_of), monitor.roi_metrics(w, 1, as_of), drift) \
        .select(stamp, "*").write.mode("append").parquet(f"{out_dir}/daily_report")
    report.dashboard_data(kpis, days_back).select(stamp, "*").write.mode("append").parquet(f"{out_dir}/dashboard")
    return health.first().asDict()
