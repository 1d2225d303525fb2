"""Committed batches, score counts, the metric store and ROC corners."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lendscope.functions import exprs as X
from lendscope.operators import metrics, monitor
from lendscope.operators import score_store as SS
from lendscope.operators.labels import attach_outcomes
from lendscope.session import shared_dir, written
from lendscope.sources import committed as CO

T0 = dt.datetime(2024, 1, 1)
LOG = "id long, customer_id string, timestamp timestamp_ntz, probability double, prediction int, processing_time_ms double"


def events(n=260, customers=9, days=6, seed=3):
    """Predictions and feedback of few customers, one of them with a third of all, some without customer."""
    rnd = random.Random(seed)
    when = lambda: T0 + dt.timedelta(seconds=rnd.randrange(days * 86400))
    who = lambda: rnd.choice(["hot"] * 4 + [f"c{rnd.randrange(customers)}"] * 7 + [None])
    log = []
    for i in range(n):
        p = rnd.randrange(0, 1001) / 1000
        log.append((i, who(), when(), p, int(p >= 0.5), rnd.choice([None, float(rnd.randrange(50, 60))])))
    fb = [(i, when(), who(), rnd.randrange(2)) for i in range(n // 2)]
    return log, fb


def frames(spark, log, fb):
    d = spark.createDataFrame(log, LOG).withColumns({"decision": X.decision("probability"), "confidence_level": X.confidence("probability")})
    return d, spark.createDataFrame(fb, "feedback_id long, feedback_ts timestamp_ntz, customer_id string, actual_outcome int")


def as_set(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_batches_are_seen_once_and_only_when_committed(spark):
    log, _ = frames(spark, *events())
    log = written(log.withColumn("date", F.when(F.col("id") % 50 != 0, F.to_date("timestamp"))), "rows")  # some without date
    path = shared_dir(spark, "log")
    schema = "id long, customer_id string"
    assert CO.read_committed(spark, path, schema).count() == 0
    for b in (0, 1, 1):
        CO.commit_batch(log.where(F.col("id") % 3 == b), path, b)
    CO.stage_batch(log.where(F.col("id") % 3 == 2), path, 2)  # died before its manifest
    seen = [r["id"] for r in CO.read_committed(spark, path, schema).collect()]
    assert sorted(seen) == [i for i in range(260) if i % 3 != 2]
    CO.commit_batch(log.where(F.col("id") % 3 == 2), path, 2)
    assert CO.read_committed(spark, path, schema).count() == 260
    # an attempt that wrote other days: its partitions aren't in the manifest
    CO.stage_batch(log.where(F.col("id") % 3 == 2).withColumn("date", F.lit(dt.date(2020, 1, 1))), path, 2)
    assert CO.read_committed(spark, path, schema).count() == 260


def test_look_backs_open_the_files_of_their_days(spark):
    log, _ = frames(spark, *events())
    log = written(log.withColumn("date", F.to_date("timestamp")), "rows")
    path = shared_dir(spark, "log")
    CO.commit_batch(log, path, 0)
    two = CO.read_committed(spark, path, "id long", dt.date(2024, 1, 5))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["d"] for r in two.select(F.col("date").cast("string").alias("d")).collect()} == {"2024-01-05", "2024-01-06"}
    scan = two._jdf.queryExecution().executedPlan().toString()
    assert "batch_id" in scan.split("PartitionFilters: [")[1].split("]")[0]  # uncommitted batches are pruned too
    opened = spark.read.parquet(f"{path}/data").where("date >= '2024-01-05'").select(F.input_file_name()).distinct().count()
    assert opened == 2  # one file a day and batch


@pytest.mark.parametrize("horizon", [None, 6])
def test_unaligned_batches_give_the_full_recompute(spark, horizon):
    """Predictions and feedback of any time in any batch, one batch run twice, a label that moves to earlier feedback."""
    rnd = random.Random(7)
    log, fb = events()
    log += [(900, "mover", T0, 0.9, 1, 5.0)]
    fb += [(901, T0 + dt.timedelta(days=4), "mover", 0), (902, T0 + dt.timedelta(days=1), "mover", 1)]
    at = {("p", r[0]): rnd.randrange(4) for r in log} | {("f", r[0]): rnd.randrange(4) for r in fb}
    at |= {("p", 900): 0, ("f", 901): 1, ("f", 902): 3}
    store = SS.MetricStore(spark, shared_dir(spark, "store"), horizon)
    changed = {}
    for b in (0, 1, 1, 2, 3):
        d, f = frames(spark, [r for r in log if at["p", r[0]] == b], [r for r in fb if at["f", r[0]] == b])
        changed[b] = store.ingest(d, f, b)
    d, f = frames(spark, log, fb)
    whole = attach_outcomes(d, f)
    assert as_set(store.daily()) == as_set(monitor.daily_snapshot(whole))
    assert as_set(SS.merged(store.counts())) == as_set(SS.day_counts(whole))
    assert T0.date() in changed[3]


def test_a_late_label_rewrites_its_day_only(spark):
    log = [(i, f"c{i}", T0 + dt.timedelta(days=i), 0.6, 1, 1.0) for i in range(4)]
    store = SS.MetricStore(spark, shared_dir(spark, "store"))
    d, f = frames(spark, log, [(0, T0, "nobody", 1)])
    store.ingest(d, f, 0)
    path = store._at("daily").removeprefix("file://").removeprefix("file:")

    def stamps():
        return {day: sorted(os.listdir(f"{path}/{day}")) for day in os.listdir(path) if day.startswith("date=")}

    before = stamps()
    d, f = d.limit(0), frames(spark, log, [(1, T0 + dt.timedelta(days=30), "c2", 1)])[1]
    assert store.ingest(d, f, 1) == [dt.date(2024, 1, 3)]
    after = stamps()
    assert {k for k in after if after[k] != before[k]} == {"date=2024-01-03"}
    got = {r["date"]: r["precision_score"] for r in store.daily().collect()}
    assert got[dt.date(2024, 1, 3)] == 1.0 and got[dt.date(2024, 1, 2)] == 0.0


def test_window_kpis_from_counts_equal_those_of_the_log(spark):
    d, f = frames(spark, *events())
    lab = written(attach_outcomes(d, f), "lab")
    now = F.to_timestamp_ntz(F.lit("2024-01-07 00:00:00"))
    want = monitor.performance_metrics(lab, 3, now).first().asDict()
    got = SS.window_kpis(SS.day_counts(lab).where("date >= '2024-01-04'"), 3).first().asDict()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v)


def test_window_kpis_of_nothing(spark):
    row = SS.window_kpis(spark.createDataFrame([], f"date date, {SS.COUNTS}"), 7).first()
    assert row["total_predictions"] == 0 and row["approval_rate"] is None and row["roc_auc"] is None


def sk_corners(points):
    """(score, y) rows to the kept scores: second differences of either count, and both ends."""
    scores = sorted({s for s, _ in points}, reverse=True)
    tps = [sum(y for s, y in points if s >= t) for t in scores]
    fps = [sum(1 - y for s, y in points if s >= t) for t in scores]
    n = len(scores)
    return {scores[i] for i in range(n) if i in (0, n - 1) or tps[i + 1] - 2 * tps[i] + tps[i - 1] or fps[i + 1] - 2 * fps[i] + fps[i - 1]}


@pytest.mark.parametrize("kind", ["mixed", "flat", "ones", "ties", "two"])
def test_roc_corners(spark, kind):
    rnd = random.Random(1)
    pts = {"mixed": [(round(rnd.random(), 2), rnd.randrange(2)) for _ in range(400)], "flat": [(0.5, rnd.randrange(2)) for _ in range(9)],
           "ones": [(i / 50, 1) for i in range(50)], "ties": [(i / 100, int(i > 40)) for i in range(100) for _ in range(2)],
           "two": [(0.1, 0), (0.9, 1)]}[kind]
    df = spark.createDataFrame(pts, "score double, y int").repartition(3)
    got = {r["threshold"] for r in metrics.roc_curve(df, corners_only=True).collect()}
    assert got == sk_corners(pts) | {float("inf")}
