"""Boundary values and golden figures from the reference's logs and rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendscope.functions import exprs as X
from lendscope.functions.features import add_features
from lendscope.operators import alerts as AL
from lendscope.operators import metrics as M
from lendscope.operators.cooldown import cooldown


def test_decision_ladder_golden(spark):
    cases = [(0.1127, "APPROVE"), (0.1520, "APPROVE"), (0.1029, "APPROVE"), (0.0896, "APPROVE"),
             (0.1903, "APPROVE"), (0.2048, "APPROVE"), (0.2196, "APPROVE"), (0.2983, "REVIEW"),
             (0.4050, "REJECT"), (0.5867, "REJECT"), (0.5014, "REJECT")]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p double")
    got = [r[0] for r in df.select(X.decision("p")).collect()]
    assert got == [d for _, d in cases]


def test_ladder_edges(spark):
    df = spark.createDataFrame([(0.15,), (0.25,), (0.40,)], "p double")
    got = [(r[0], r[1]) for r in df.select(X.decision("p"), X.confidence("p")).collect()]
    assert got == [("APPROVE", "HIGH"), ("APPROVE", "MEDIUM"), ("REVIEW", "MEDIUM")]


def test_sweep_step_11():
    assert M.sweep_thresholds()[11] == 0.6500000000000001
    assert len(M.sweep_thresholds()) == 16


def test_age_cut(spark):
    years = [0, 25, 25.01, 100, 100.01]
    df = spark.createDataFrame([(-y * 365.25,) for y in years], "Age_Days double")
    got = [r.Age_Group for r in add_features(df).collect()]
    assert got == ["Young", "Young", "Adult", "Elder", None]


def test_kolmogorov_series(spark):
    df = spark.createDataFrame([(1.36,), (0.5,), (0.1,)], "lam double")
    got = [r[0] for r in df.select(X.kolmogorov_pvalue("lam")).collect()]
    assert got[0] == pytest.approx(0.049486, abs=1e-6)
    assert got[1] == pytest.approx(0.963945, abs=1e-6)
    assert got[2] == 1.0


def test_cooldown_edge(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 0)
    mins = [0, 30, 61, 90, 121]
    rows = [(i, "PERF", t0 + dt.timedelta(minutes=m)) for i, m in enumerate(mins)]
    df = spark.createDataFrame(rows, "alert_id long, type string, timestamp timestamp_ntz")
    got = sorted((r.alert_id, r.sent) for r in cooldown(df).collect())
    assert [mins[i] for i, s in got if s] == [0, 61, 121]


def test_cooldown_exactly_sixty_passes(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 0)
    rows = [(i, "X", t0 + dt.timedelta(minutes=60 * i)) for i in range(4)]
    df = spark.createDataFrame(rows, "alert_id long, type string, timestamp timestamp_ntz")
    assert all(r.sent for r in cooldown(df).collect())


def _kpi_row(spark, total, period, precision, f1, lat, labeled):
    return spark.createDataFrame(
        [(total, period, precision, f1, lat, labeled)],
        "total_predictions long, period_days int, precision double, f1_score double, "
        "avg_processing_time_ms double, labeled_samples long")


def test_volume_anomaly_young_log(spark):
    # every row falls in the last 7 days: (n/7)/(n/30) - 1
    k = _kpi_row(spark, 70, 7, None, None, 10.0, 0)
    h = spark.createDataFrame([(70,)], "history_predictions long")
    a = AL.generate_alerts(k, h).collect()
    assert len(a) == 1 and a[0].type == "VOLUME_ANOMALY" and a[0].severity == "MEDIUM"
    assert a[0].value == pytest.approx(3.2857142857142856, rel=1e-12)


def test_precision_and_f1_zero(spark):
    k = _kpi_row(spark, 30, 7, 0.0, 0.0, None, 12)
    h = spark.createDataFrame([(130,)], "history_predictions long")
    a = {r.type: r for r in AL.generate_alerts(k, h).collect()}
    assert a["PERFORMANCE_DEGRADATION"].severity == "HIGH"
    assert a["PERFORMANCE_DEGRADATION"].threshold == 0.35
    assert a["PERFORMANCE_DEGRADATION"].message == "Precision dropped to 0.0% (below 35.0%)"
    assert a["F1_SCORE_LOW"].severity == "MEDIUM" and a["F1_SCORE_LOW"].threshold == 0.20
    # missing latency gives no latency alert and does not drop the others
    assert "SLOW_RESPONSE_TIME" not in a


def test_auc_monotone_invariant_and_single_class(spark):
    rows = [(i % 3 == 0 and 1 or 0, (i * 37 % 101) / 101.0) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    a1 = M.roc_auc(df, "y", "s").first().auc
    a2 = M.roc_auc(df.withColumn("s", F.exp(F.col("s") * 3)), "y", "s").first().auc
    assert a1 == pytest.approx(a2, abs=1e-12)
    one = M.roc_auc(df.where("y = 1"), "y", "s").first()
    assert one.auc is None and one.n_neg == 0


def test_ks_symmetric(spark):
    rows = [((i * 13 % 97) / 97.0, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "v double, f int")
    k1 = M.ks_two_sample(df, "v", "f").first()
    k2 = M.ks_two_sample(df.withColumn("f", 1 - F.col("f")), "v", "f").first()
    assert k1.ks_statistic == pytest.approx(k2.ks_statistic)
    assert k1.p_value == pytest.approx(k2.p_value)


def test_numeric_repair(spark):
    from lendscope.functions.features import repair_types
    df = spark.createDataFrame([(" 12 ",), ("1d",), ("$",), ("1e3",), (None,), ("-.5",)], "Client_Income string")
    out, conv = repair_types(df)
    assert conv == ["Client_Income"]
    assert [r[0] for r in out.collect()] == [12.0, None, None, 1000.0, None, -0.5]
