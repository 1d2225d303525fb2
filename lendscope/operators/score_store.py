"""Score counts per day: the additive form of the monitoring metrics.

One row per (date, metric, value, prediction, decision, outcome) with a
signed count ``n``.  Counts of batches add up, so AUC, KS, threshold sweep,
risk mix and the daily table of any span of days are sums over this table,
and the log isn't read again.  A label that arrives or changes later is a
pair of corrections (-1 old, +1 new) on the day of its prediction.

``MetricStore`` keeps log, feedback, labels and counts as committed batches
(``sources.committed``) and a published table of daily metrics of which a
batch rewrites only the days that it changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import RISK_LOW_MAX, RISK_MEDIUM_MAX, try_div
from ..session import written
from ..sources.committed import commit_batch, read_committed
from .labels import attach_outcomes
from .metrics import auc_of_counts

PROBABILITY, LATENCY = "probability", "processing_time_ms"
COUNTS = "metric string, value double, prediction int, decision string, outcome int, n long"
KEYS = ["date", "metric", "value", "prediction", "decision", "outcome"]


def day_counts(log: DataFrame, outcome: str = "actual_outcome", sign: Column | int = 1) -> DataFrame:
    """The counts of a (labelled) log; missing values are kept as null, so row counts are sums too."""
    s = sign if isinstance(sign, Column) else F.lit(sign)
    none = F.lit(None)
    both = F.array(
        F.struct(F.lit(PROBABILITY).alias("metric"), F.col(PROBABILITY).cast("double").alias("value"), F.col("prediction").cast("int").alias("prediction"),
                 F.col("decision").alias("decision"), F.col(outcome).cast("int").alias("outcome")),
        F.struct(F.lit(LATENCY).alias("metric"), F.col(LATENCY).cast("double").alias("value"), none.cast("int").alias("prediction"),
                 none.cast("string").alias("decision"), none.cast("int").alias("outcome")))
    rows = log.select(F.to_date("timestamp").alias("date"), s.cast("long").alias("s"), F.inline(both))
    return rows.groupBy(*KEYS).agg(F.sum("s").alias("n")).where("n <> 0")


def merged(counts: DataFrame) -> DataFrame:
    """Counts of several batches as one: signed corrections cancel."""
    return counts.groupBy(*KEYS).agg(F.sum("n").alias("n")).where("n <> 0")


def sample_counts(counts: DataFrame, recent: Column) -> DataFrame:
    """(metric, value, c1, c0): rows of the recent days and of the earlier ones, for the two-sample test."""
    return counts.groupBy("metric", "value").agg(F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("c1"),
                                                 F.sum(F.when(recent, 0).otherwise(F.col("n"))).alias("c0"))


def window_kpis(counts: DataFrame, days: int) -> DataFrame:
    """The KPI row of ``monitor.performance_metrics`` from the counts of the window's days."""
    c = written(counts.select(*KEYS, "n"), "window-counts")
    n, p = F.col("n"), F.col("value")
    of_p = F.col("metric") == PROBABILITY
    level = X.confidence("value")

    def total(cond: Column, value: Column = F.lit(1)) -> Column:
        return F.coalesce(F.sum(F.when(cond, n * value)), F.lit(0))

    def cell(pred: int, y: int) -> Column:
        return total(of_p & (F.col("outcome") == y) & (F.col("prediction") == pred))

    ms = (F.col("metric") == LATENCY) & p.isNotNull()
    a = c.agg(
        total(of_p).alias("n"), F.sum(F.when(of_p, p * n)).alias("sum_p"), total(of_p & p.isNotNull()).alias("n_p"),
        F.sum(F.when(ms, p * n)).alias("sum_ms"), total(ms).alias("n_ms"),
        *[total(of_p & (F.col("decision") == d)).alias(d.lower()) for d in ("APPROVE", "REJECT", "REVIEW")],
        total(of_p & (p <= RISK_LOW_MAX)).alias("low"), total(of_p & (p > RISK_LOW_MAX) & (p <= RISK_MEDIUM_MAX)).alias("medium"),
        total(of_p & (p > RISK_MEDIUM_MAX)).alias("high"),
        *[total(of_p & (level == v)).alias(f"conf_{v.lower()}") for v in ("HIGH", "MEDIUM", "LOW")],
        total(of_p & F.col("outcome").isNotNull()).alias("labeled"),
        cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    scores = c.where(of_p & F.col("outcome").isNotNull()).groupBy(F.col("value").alias("score")).agg(
        total(F.col("outcome") == 1).alias("pos"), total(F.col("outcome") == 0).alias("neg"))
    one = a.crossJoin(auc_of_counts(scores).select("auc"))
    has = F.col("labeled") > 0

    def rate(x: str) -> Column:
        return try_div(F.col(x), F.col("n"))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select(
        F.lit(days).alias("period_days"), F.col("n").cast("bigint").alias("total_predictions"), try_div("sum_p", "n_p").alias("avg_probability"),
        try_div("sum_ms", "n_ms").alias("avg_processing_time_ms"), rate("approve").alias("approval_rate"), rate("reject").alias("rejection_rate"),
        rate("review").alias("review_rate"), rate("low").alias("low_risk"), rate("medium").alias("medium_risk"), rate("high").alias("high_risk"),
        rate("conf_high").alias("conf_high"), rate("conf_medium").alias("conf_medium"), rate("conf_low").alias("conf_low"),
        F.when(has, F.coalesce(try_div(tp, tp + fp), F.lit(0.0))).alias("precision"),
        F.when(has, F.coalesce(try_div(tp, tp + fn), F.lit(0.0))).alias("recall"),
        F.when(has, F.coalesce(try_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0))).alias("f1_score"),
        F.when(has, F.col("auc")).alias("roc_auc"), F.col("labeled").cast("bigint").alias("labeled_samples"))


def daily_table(counts: DataFrame) -> DataFrame:
    """SNK-6 from counts: the columns of ``monitor.daily_snapshot``, one row per day."""
    n, p = F.col("n"), F.col("value")

    def cell(pred: int, y: int) -> Column:
        return F.sum(F.when((F.col("outcome") == y) & (F.col("prediction") == pred), n).otherwise(0))

    g = counts.where(F.col("metric") == PROBABILITY).groupBy("date").agg(
        F.sum("n").alias("total"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"),
        F.sum(F.when(F.col("decision") == "APPROVE", n).otherwise(0)).alias("approved"),
        F.sum(F.greatest(p, 1 - p) * n).alias("sure"), F.sum(F.when(p.isNotNull(), n)).alias("scored"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.where("total > 0").select(
        "date", F.col("total").cast("bigint").alias("total_predictions"),
        F.coalesce(try_div(tp, tp + fp), F.lit(0.0)).alias("precision_score"), F.coalesce(try_div(tp, tp + fn), F.lit(0.0)).alias("recall_score"),
        F.coalesce(try_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"), try_div("approved", "total").alias("approval_rate"),
        try_div("sure", "scored").alias("avg_confidence"))


LOG = ("id long, customer_id string, timestamp timestamp_ntz, probability double, prediction int, decision string, "
       "processing_time_ms double")
FEEDBACK = "feedback_id long, feedback_ts timestamp_ntz, customer_id string, actual_outcome int"
LABELS = "id long, feedback_id long, outcome int"


class MetricStore:
    """Log, feedback, labels, counts and daily metrics under one folder, kept by batches in any order.

    A prediction's label is the earliest feedback of its customer at or after
    it.  A batch may bring predictions and feedback of any time: the customers
    it names are labelled anew against the stored rows of those customers, and
    what changed is written as corrections.  Running a batch again changes
    nothing.  Without a ``date``-bounded history the customers' rows are looked
    up in the whole log (four columns); ``horizon_days`` bounds how long before
    a feedback a prediction can lie, and so the days that are read.
    """

    def __init__(self, spark: SparkSession, path: str, horizon_days: int | None = None) -> None:
        self.spark, self.path, self.horizon = spark, path.rstrip("/"), horizon_days

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def log(self, since=None, until=None) -> DataFrame:
        return read_committed(self.spark, self._at("log"), LOG, since, until)

    def feedback(self, since=None, until=None) -> DataFrame:
        return read_committed(self.spark, self._at("feedback"), FEEDBACK, since, until)

    def counts(self, since=None, until=None) -> DataFrame:
        return read_committed(self.spark, self._at("counts"), COUNTS, since, until).select(*KEYS, "n")

    def labels(self, before: int | None = None) -> DataFrame:
        """The last label of each prediction, of the batches below ``before``."""
        rows = read_committed(self.spark, self._at("labels"), LABELS)
        rows = rows if before is None else rows.where(F.col("batch_id") < before)
        return rows.groupBy("id").agg(F.max_by(F.struct("feedback_id", "outcome"), "batch_id").alias("l")).select("id", "l.*")

    def ingest(self, predictions: DataFrame, feedback: DataFrame, batch_id: int) -> list:
        """Add a batch; returns the dates whose metrics changed.  Batch ids rise; a batch may be run again before the next."""
        mine = F.col("batch_id") < batch_id  # a batch that is run again sees what it saw the first time
        new_log = written(predictions.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in LOG.split(", ")])
                          .withColumn("date", F.to_date("timestamp")), "store-log")
        new_fb = written(feedback.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in FEEDBACK.split(", ")])
                         .withColumn("date", F.to_date("feedback_ts")), "store-feedback")
        touched = new_log.select("customer_id").unionByName(new_fb.select("customer_id")).where("customer_id is not null").distinct()
        since = None
        if self.horizon is not None:
            # one row: the first day that this batch can label
            first = new_fb.select("date").unionByName(new_log.select("date")).agg(F.min("date")).first()[0]
            since = None if first is None else F.date_sub(F.lit(first), self.horizon)
        old_log = self.log(since).where(mine).join(touched, "customer_id", "left_semi").select(new_log.columns)
        old_fb = self.feedback(since).where(mine).join(touched, "customer_id", "left_semi").select(new_fb.columns)
        log, fb = new_log.unionByName(old_log), new_fb.unionByName(old_fb)
        now = attach_outcomes(log.withColumn("_new", F.lit(False)), fb.drop("date")).drop("feedback_date")
        fresh = new_log.select("id", F.lit(True).alias("fresh"))
        known = self.labels(batch_id).withColumnsRenamed({"feedback_id": "had", "outcome": "had_outcome"})
        state = written(now.join(known, "id", "left").join(fresh, "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
                        .where("fresh or not (feedback_id <=> had)").drop("_new"), "store-changes")
        changed = state.where("not (feedback_id <=> had)")
        # New predictions count once; a label that came or changed moves its prediction from the old outcome to the new.
        added = day_counts(state.where("fresh"))
        moved = changed.where("not fresh").select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("s")).withColumn(
            "actual_outcome", F.when(F.col("s") < 0, F.col("had_outcome")).otherwise(F.col("actual_outcome")))
        delta = written(merged(added.unionByName(day_counts(moved, sign=F.col("s")))), "store-delta")
        commit_batch(new_log, self._at("log"), batch_id)
        commit_batch(new_fb, self._at("feedback"), batch_id)
        commit_batch(written(changed.select("id", "feedback_id", F.col("actual_outcome").cast("int").alias("outcome"), "date"), "store-labels"),
                     self._at("labels"), batch_id)
        commit_batch(delta, self._at("counts"), batch_id)
        # one row per changed day
        days = [r["date"] for r in delta.select("date").distinct().collect()]
        if days:
            self._publish(days)
        return sorted(days, key=str)

    def _publish(self, days: list) -> None:
        """Rewrite the daily metrics of these days; the partitions of all others stay as they are."""
        counts = self.counts(min(d for d in days if d), max(d for d in days if d)).where(F.col("date").isin(days))
        (daily_table(counts).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(self._at("daily")))

    def daily(self) -> DataFrame:
        """The published daily metrics."""
        d = self.spark.read.parquet(self._at("daily"))
        return d.select("date", *[c for c in d.columns if c != "date"])
