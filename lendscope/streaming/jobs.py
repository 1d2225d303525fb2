"""Structured Streaming jobs (STR-1..7).

The reference serves one request at a time and polls its log from a
thread; here the same work runs as streaming queries over append-only
files (any file or message source works the same way):

* STR-1 ``score_stream``: validate, score, append to the log, quarantine.
* STR-2 ``daily_kpis_stream``: daily tumbling KPIs with a watermark.
* STR-3 ``sliding_kpis``: 7-day sliding KPIs from additive daily partials.
* STR-4 ``cooldown_stream``: alert cooldown with per-type state.
* STR-5 ``label_stream``: each prediction's outcome, emitted once, however late.
* STR-6 the watermark delay argument; late rows are dropped and counted.
* STR-7 ``monitoring_stream``: scheduled checks of the look-back in ``foreachBatch``.

Event times in the tables are TIMESTAMP_NTZ; watermarks need TIMESTAMP,
so they are read as UTC instants (``utc_instant``), independent of the
session time zone.
"""

from __future__ import annotations

import bisect
import datetime as dt
import time
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.exprs import try_div
from ..operators import validate as V
from ..operators.cooldown import COOLDOWN_MINUTES
from ..operators.scoring import apply_decisions
from ..session import written
from ..sources.committed import commit_batch, read_committed


def utc_instant(c) -> Column:
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant, read as UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_timestamp(F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX")


def utc_day(instant) -> Column:
    """Calendar day (UTC) of an instant, as DATE, independent of the session zone."""
    c = F.col(instant) if isinstance(instant, str) else instant
    return F.date_from_unix_date(F.floor(F.unix_seconds(c) / 86400).cast("int"))


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


# ---------------------------------------------------------------- STR-1

# Columns of the prediction log, as the monitor reads it.
LOG_SCHEMA = ("id long, customer_id string, timestamp timestamp_ntz, features string, probability double, "
              "prediction int, decision string, confidence_level string, processing_time_ms double")


def score_stream(apps: DataFrame, score_fn: Callable[[DataFrame], DataFrame], log_path: str,
                 quarantine_path: str, checkpoint: str, trigger: dict | None = None,
                 latency_path: str | None = None, id_col: str = "ID", time_col: str = "received_at"):
    """Validate each micro-batch, score the valid rows, write them to the
    prediction log and the invalid ones (with reasons) to quarantine.

    ``score_fn`` maps valid applications to rows with probability,
    prediction, decision and confidence level (``scoring.score`` of a loaded
    package, ``ladder_scores`` for replays).  Log rows carry the row's own
    id and arrival time; a missing customer id is made from both, so two
    applications never become one customer.

    The log is partitioned by date and batch (``sources.committed``): look-backs
    open the files of their days only, a batch is seen when it is whole, and one
    that is run again after a failure leaves the same rows, not twice as many.
    Quarantine and latency are partitioned by batch.

    SCO-4: ``processing_time_ms`` of a log row is its share of the time that
    scoring and writing its batch took; with ``latency_path`` each batch also
    writes (batch_id, rows, elapsed_ms, ms_per_row).
    """
    def overwrite(df: DataFrame, path: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        t0 = time.time()
        spark = batch.sparkSession
        arrived = F.col(time_col).cast("timestamp_ntz")
        own = F.concat_ws("_", F.lit("customer"), F.date_format(arrived, "yyyyMMddHHmmss"), F.col(id_col).cast("string"))
        given = F.when(F.col("customer_id") != "", F.col("customer_id"))
        v = V.validate(batch.withColumn("customer_id", F.coalesce(given, own)), V.APPLICATION_RULES)
        v = written(v, "stream-batch")  # both outputs come from one evaluation of the batch
        ok, refused = V.split_valid(v)
        overwrite(refused, quarantine_path, batch_id)
        scored = written(score_fn(ok).withColumn("features", F.to_json(F.struct(*V.SELECTED_FEATURES))), "stream-scored")
        rows = scored.count()
        ms = (time.time() - t0) * 1000.0
        log = scored.select(
            F.col(id_col).cast("long").alias("id"), "customer_id", arrived.alias("timestamp"),
            F.to_date(arrived).alias("date"), "features", "probability", F.col("prediction").cast("int").alias("prediction"),
            "decision", "confidence_level", F.lit(ms / rows if rows else None).cast("double").alias("processing_time_ms"))
        commit_batch(written(log, "stream-log"), log_path, batch_id)
        if latency_path:
            overwrite(spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(ms).alias("elapsed_ms"),
                                            F.lit(ms / rows if rows else None).cast("double").alias("ms_per_row")),
                      latency_path, batch_id)

    w = apps.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, log_path: str, since=None, until=None) -> DataFrame:
    """The prediction log written by ``score_stream``, of the days from ``since`` to ``until``."""
    return read_committed(spark, log_path, LOG_SCHEMA, since, until)


def ladder_scores(threshold: float) -> Callable[[DataFrame], DataFrame]:
    """A score_fn for rows that already carry a probability (e.g. replayed logs)."""
    def fn(df: DataFrame) -> DataFrame:
        return apply_decisions(df, threshold)
    return fn


# ---------------------------------------------------------------- STR-2 / STR-6

def daily_kpis_stream(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Daily tumbling KPIs of a (streaming) scored log; append mode emits a day
    once the watermark (max event time - ``delay``) passes its end, update
    mode (``run_daily_kpis``) also the days that are still open.  Rows later
    than the watermark are dropped and counted by the engine
    (``numRowsDroppedByWatermark``, counted after map-side partial
    aggregation)."""
    s = log.withColumn("event_time", utc_instant("timestamp")).withWatermark("event_time", delay)
    g = s.groupBy(F.window("event_time", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("decision") == "APPROVE").alias("approved"),
        F.count_if(F.col("decision") == "REJECT").alias("rejected"),
        F.count_if(F.col("decision") == "REVIEW").alias("reviews"),
        F.sum("probability").alias("sum_probability"),
        F.sum("processing_time_ms").alias("sum_latency"),
        F.count("processing_time_ms").alias("n_latency"))
    return g.select(utc_day(F.col("w.start")).alias("day"), "total_predictions", "approved", "rejected", "reviews",
                    "sum_probability", "sum_latency", "n_latency")


def run_daily_kpis(log: DataFrame, out: str, checkpoint: str, delay: str = "0 seconds") -> None:
    """Drain the log in update mode; every batch writes the days it changed to its own partition."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (daily_kpis_stream(log, delay).writeStream.foreachBatch(run).outputMode("update")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_days(spark: SparkSession, out: str) -> DataFrame:
    """Each day's partials as of the last batch that changed it; ``closed`` once a later day has begun."""
    d = spark.read.parquet(out)
    last = d.groupBy("day").agg(F.max_by(F.struct(*[c for c in d.columns if c not in ("day", "batch_id")]),
                                         F.col("batch_id")).alias("p")).select("day", "p.*")
    newest = last.agg(F.max("day").alias("_newest"))  # one row
    return last.crossJoin(F.broadcast(newest)).withColumn("closed", F.col("day") < F.col("_newest")).drop("_newest")


def finish_daily(partials: DataFrame) -> DataFrame:
    """Rates from the additive daily partials."""
    n = F.col("total_predictions")
    closed = ["closed"] if "closed" in partials.columns else []
    return partials.select("day", *closed, n.cast("bigint").alias("total_predictions"),
                           try_div("approved", n).alias("approval_rate"),
                           try_div("rejected", n).alias("rejection_rate"),
                           try_div("reviews", n).alias("review_rate"),
                           try_div("sum_probability", n).alias("avg_probability"),
                           try_div("sum_latency", "n_latency").alias("avg_processing_time_ms"))


# ---------------------------------------------------------------- STR-3

def sliding_kpis(partials: DataFrame, days: int = 7) -> DataFrame:
    """7-day sliding KPIs ending on each day, summed from daily partials.

    The partials hold one row per day, so the ordered window is bounded
    by the number of days; no event row is copied per slide.
    """
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    cols = ["total_predictions", "approved", "rejected", "reviews", "sum_probability", "sum_latency", "n_latency"]
    s = partials.select("day", *[F.sum(c).over(w).alias(c) for c in cols])
    return finish_daily(s)


# ---------------------------------------------------------------- STR-4

COOLDOWN_OUT = "alert_id long, type string, timestamp timestamp, sent boolean"
COOLDOWN_STATE = "last_sent timestamp"


def _cooldown_fn(minutes: int):
    gap = np.timedelta64(minutes, "m")

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["timestamp", "alert_id"])
        at = rows["timestamp"].to_numpy(dtype="datetime64[us]")
        sent = np.zeros(len(at), dtype=bool)
        last = np.datetime64(pd.Timestamp(state.get[0])) if state.exists else None
        # From one sent alert straight to the first alert a cooldown later.
        i = 0 if last is None else int(np.searchsorted(at, last + gap))
        while i < len(at):
            sent[i], last = True, at[i]
            i = int(np.searchsorted(at, last + gap))
        if last is not None:
            state.update((pd.Timestamp(last).to_pydatetime(),))
        yield rows.assign(sent=sent)[["alert_id", "type", "timestamp", "sent"]]

    return fn


def cooldown_stream(alerts: DataFrame, minutes: int = COOLDOWN_MINUTES, delay: str = "0 seconds") -> DataFrame:
    """Alert cooldown with state = last sent event time per type.

    Within a micro-batch a type's alerts are handled in event-time order,
    one step per sent alert; across batches the state carries the last sent
    time, so the result equals the batch operator when alerts arrive in time
    order.  One task holds one type's rows of one micro-batch: bound that
    with the source's ``maxFilesPerTrigger`` (a history replayed as one
    batch is better run by the batch operator, which splits types).
    """
    s = alerts.withColumn("timestamp", utc_instant("timestamp")).withWatermark("timestamp", delay)
    return s.groupBy("type").applyInPandasWithState(
        _cooldown_fn(minutes), COOLDOWN_OUT, COOLDOWN_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- STR-5

LABEL_OUT = "id long, outcome int, feedback_at long, feedback_id long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Labeller(StatefulProcessor):
    """State of one customer: open predictions (id, time), and feedback (time, id, outcome), both as lists on disk.

    A batch appends to a list, or reads and writes it, in one call each, not one
    per row.  Of rows that share a key the last one counts.  With a watermark
    timers drop feedback once no prediction before it can arrive.  ``final``: a
    label waits for the timer of its feedback, so that earlier feedback that
    comes later still wins; else it is emitted as soon as there is one, and the
    feedback of a batch has one timer, that of its newest.
    """

    def __init__(self, timed: bool, final: bool) -> None:
        self.timed, self.final = timed, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id long, at long")
        self.feedback = handle.getListState("feedback", "at long, id long, outcome int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        fresh: list[tuple[int, int]] = []
        told: list[tuple[int, int, int]] = []
        for pdf in rows:
            for at, is_feedback, event, outcome in zip(pdf["at"].tolist(), pdf["is_feedback"].tolist(), pdf["event_id"].tolist(),
                                                       pdf["outcome"].tolist(), strict=True):
                if is_feedback:
                    told.append((at, event, outcome))
                else:
                    fresh.append((event, at))
        if told:
            self.feedback.appendList(told)
            if self.timed:
                until = {at // 1000 + 1 for at, _, _ in told}
                for t in sorted(until) if self.final else [max(until)]:
                    self.handle.registerTimer(t)
        if self.final:
            if fresh:
                self.open.appendList(fresh)
            return
        known = self._known()
        out, wait = [], []
        for event, at in fresh:  # feedback may have come before its prediction
            i = bisect.bisect_left(known, (at,))
            if i < len(known):
                out.append((event, *known[i]))
            else:
                wait.append((event, at))
        if wait:
            self.open.appendList(wait)
        if told:
            out += self._settle(known, max(told)[0])
        if out:
            yield _labels(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        until = 1000 * timerValues.getCurrentWatermarkInMs()
        known = self._known()
        past = [f for f in known if f[0] < until]
        if not past:
            return
        if self.final:
            out = self._settle(known, past[-1][0])
            if out:
                yield _labels(out)
        _put(self.feedback, [f for f in known if f[0] >= until])  # no prediction before the watermark comes any more

    def _known(self) -> list[tuple[int, int, int]]:
        return sorted((at, event, outcome) for (at, event), outcome in {(f[0], f[1]): f[2] for f in self.feedback.get()}.items())

    def _settle(self, known: list[tuple[int, int, int]], newest: int) -> list[tuple[int, int, int, int]]:
        """Open predictions up to ``newest`` take their earliest feedback and leave the state."""
        waiting = {o[0]: o[1] for o in self.open.get()}
        out = [(event, *known[bisect.bisect_left(known, (at,))]) for event, at in waiting.items() if at <= newest]
        if out:
            _put(self.open, [o for o in waiting.items() if o[1] > newest])
        return out

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


def _labels(rows: list[tuple[int, int, int, int]]) -> pd.DataFrame:
    event, at, feedback, outcome = zip(*rows, strict=True)
    return pd.DataFrame({"id": event, "outcome": pd.Series(outcome, dtype="int32"), "feedback_at": at, "feedback_id": feedback})


def label_stream(predictions: DataFrame, feedback: DataFrame, delay: str | None = None, final: bool = False) -> DataFrame:
    """(id, actual_outcome, feedback_date, feedback_id), once per labelled prediction.

    State per customer: the predictions without an outcome, which never expire,
    so feedback that comes months later still labels; and the feedback, so
    either source may run ahead of the other.  With a ``delay`` (no source is
    later than that against its own newest row) timers drop feedback that the
    watermark of both has passed.  The result equals the batch as-of join when a
    customer's feedback arrives in time order (any order within a batch), in
    whatever order the predictions come; with ``final`` (which needs a
    ``delay``) also when feedback is out of order within the delay, as a label
    is given when the watermark has passed its feedback.  A customer's rows of a
    micro-batch are handled in one task: bound batches at the sources.  Rows
    without customer are left out: they have no feedback.
    """
    if final and delay is None:
        raise ValueError("final labels need a delay")
    spark = predictions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # map states and timers live there

    def side(df: DataFrame, is_feedback: bool, event: str, outcome: Column, time_col: str) -> DataFrame:
        e = df.where(F.col("customer_id").isNotNull()).select(
            "customer_id", F.lit(is_feedback).alias("is_feedback"), F.col(event).cast("long").alias("event_id"), outcome.alias("outcome"),
            utc_instant(time_col).alias("event_time"))
        e = e.withColumn("at", F.unix_micros("event_time"))
        return e if delay is None else e.withWatermark("event_time", delay)

    both = side(predictions, False, "id", F.lit(0), "timestamp").unionByName(
        side(feedback, True, "feedback_id", F.coalesce(F.col("actual_outcome"), F.lit(0)).cast("int"), "feedback_ts"))
    out = both.groupBy("customer_id").transformWithStateInPandas(
        Labeller(delay is not None, final), LABEL_OUT, "append", "None" if delay is None else "EventTime")
    return out.select("id", F.col("outcome").alias("actual_outcome"), F.timestamp_micros("feedback_at").alias("feedback_date"), "feedback_id")


# ---------------------------------------------------------------- STR-7

REPORT_HOUR = 8  # fixed value: the hour of the daily report


def monitoring_stream(log_stream: DataFrame, read_log_fn: Callable[[], DataFrame], checkpoint: str,
                      health: Callable[[DataFrame], DataFrame], on_health: Callable[[DataFrame, int], None],
                      on_report: Callable[[DataFrame], None] | None = None,
                      on_dashboard: Callable[[DataFrame], None] | None = None,
                      clock: Callable[[], "dt.datetime"] | None = None, every: str | None = None):
    """Scheduled checks over the look-back, not over the micro-batch.

    New rows of the log only start a tick.  Each tick reads the log table
    (``read_log_fn``), writes the status that ``health`` computes from it
    (one row with ``active_alerts``) through ``on_health``, runs the report
    at REPORT_HOUR and the dashboard when there are no alerts.
    ``every='30 minutes'`` polls; without it the query handles what is there
    and stops (availableNow).
    """
    now = clock or (lambda: dt.datetime.now(dt.timezone.utc))

    def tick(_: DataFrame, batch_id: int) -> None:
        log = read_log_fn()
        status = written(health(log), "monitor-status")
        on_health(status, batch_id)
        if on_report and now().hour == REPORT_HOUR:
            on_report(log)
        if on_dashboard and status.first()["active_alerts"] == 0:  # one row
            on_dashboard(log)

    w = log_stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def daily_partials(log: DataFrame) -> DataFrame:
    """Batch form of the daily partials (same columns as the stream)."""
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("decision") == "APPROVE").alias("approved"),
        F.count_if(F.col("decision") == "REJECT").alias("rejected"),
        F.count_if(F.col("decision") == "REVIEW").alias("reviews"),
        F.sum("probability").alias("sum_probability"),
        F.sum("processing_time_ms").alias("sum_latency"),
        F.count("processing_time_ms").alias("n_latency"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drain a streaming query into parquet with availableNow and wait for it."""
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
