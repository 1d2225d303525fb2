"""Physical test tables and the logical tables derived from them.

The reference works on a loan CSV, a prediction log, a feedback stream and
an alert log.  None of them ship with it, so each logical table is derived
deterministically from the driver's parquet tables (see FIXTURES.md); the
derivations below are plain projections the optimizer prunes and pushes
down like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed value: the monitoring clock of the fixtures ("now").
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of_lit(as_of: str = AS_OF):
    """Event times are TIMESTAMP_NTZ; keep the clock NTZ too (no zone shift)."""
    return F.to_timestamp_ntz(F.lit(as_of))


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw loan rows: dirty text income, missing values in most columns."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("double")

    def null_when(cond, v):
        return F.when(~cond, v)

    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(
                k.alias("ID"),
                F.when(k % 13 == 0, F.lit("$"))
                .when(k % 17 == 0, F.lit(None).cast("string"))
                .otherwise((5 * (F.floor("c_acctbal") + 900)).cast("bigint").cast("string"))
                .alias("Client_Income"),
                null_when(k % 19 == 0, price).alias("Credit_Amount"),
                null_when(k % 23 == 0, price / 20).alias("Loan_Annuity"),
                null_when(k % 29 == 0, -(5000 + (F.col("o_custkey") * 37 + k * 11) % 33000).cast("double"))
                .alias("Age_Days"),
                null_when(k % 31 == 0, ((k * 53) % 20000).cast("double")).alias("Employed_Days"),
                null_when(k % 7 == 0, (k % 2).cast("double")).alias("Car_Owned"),
                (k % 3 == 0).cast("int").alias("Bike_Owned"),
                (k % 5 < 3).cast("int").alias("House_Own"),
                F.lit(1).alias("Mobile_Tag"),
                (k % 4 == 0).cast("int").alias("Homephone_Tag"),
                (k % 6 < 2).cast("int").alias("Workphone_Working"),
                null_when(k % 3 == 1, ((k * 7919) % 1000) / 1000.0).alias("Score_Source_1"),
                (((k * 104729) % 1000) / 1000.0).alias("Score_Source_2"),
                null_when(k % 9 == 1, ((k * 1299709) % 1000) / 1000.0).alias("Score_Source_3"),
                null_when(k % 37 == 0, (k % 7).cast("int")).alias("Application_Process_Day"),
                null_when(k % 10 == 3, (k % 2).cast("int")).alias("Active_Loan"),
                (k % 5).cast("int").alias("Child_Count"),
                null_when(k % 11 == 0, F.col("c_mktsegment")).alias("Client_Income_Type"),
                F.col("o_orderpriority").alias("Client_Education"),
                (((k * 7919 + F.col("o_custkey") * 31) % 100)
                 < F.when(price > 350000, 14).otherwise(5)).cast("int").alias("Default"),
            ))


def _customer(user_id):
    return F.concat(F.lit("customer_"), F.col(user_id).cast("string"))


def raw_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored applications as the service logs them, before any feedback."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "signup"))
    p = F.least(F.col("value") / 200.0, F.lit(1.0))
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        _customer("user_id").alias("customer_id"),
        p.alias("probability"),
        (p >= 0.5).cast("int").alias("prediction"),
        F.when(~k.isin("7", "77"), k.cast("double") * 6).alias("processing_time_ms"),
    )


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log with the decision ladder applied (no outcomes yet)."""
    p = raw_predictions(spark, sf_dir)
    return p.select("*", X.decision("probability").alias("decision"),
                    X.confidence("probability").alias("confidence_level"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    return e.select(
        F.col("event_id").alias("feedback_id"),
        F.col("ts").alias("feedback_ts"),
        _customer("user_id").alias("customer_id"),
        (F.col("event_type") == "error").cast("int").alias("actual_outcome"),
    )


def prediction_log(spark: SparkSession, sf_dir: str, since_days: int | None = None, as_of=None) -> DataFrame:
    """The prediction log: ladder plus outcomes attached by feedback.

    With ``since_days`` only predictions of the look-back window are
    labelled.  A prediction's label comes from feedback at or after it, so
    both sides are cut at the window start *before* the as-of join: the
    time filter reaches the Parquet scan (pushed filter, and partition
    pruning on a date-partitioned log) instead of running after the join.
    """
    from ..operators.labels import attach_outcomes
    log, fb = scored_log(spark, sf_dir), feedback(spark, sf_dir)
    if since_days is not None:
        start = (as_of if as_of is not None else as_of_lit()) - F.make_dt_interval(days=F.lit(since_days))
        log, fb = log.where(F.col("timestamp") >= start), fb.where(F.col("feedback_ts") >= start)
    return attach_outcomes(log, fb)


def shifted_log(spark: SparkSession, sf_dir: str, since_days: int | None = None) -> DataFrame:
    """A labelled log in which the last week differs from the weeks before.

    Scores and latencies are higher, three of four earlier predictions are
    moved into the last week (to the same time of another day) and few outcomes
    are defaults, so every alert has cause.
    """
    from ..operators.labels import attach_outcomes
    raw = raw_predictions(spark, sf_dir)
    start = as_of_lit() - F.make_dt_interval(days=F.lit(7))
    time_of_day = F.col("timestamp") - F.to_date("timestamp").cast("timestamp_ntz")
    moved = start + F.make_dt_interval(days=(F.col("id") % 7).cast("int")) + time_of_day
    raw = raw.withColumn("timestamp", F.when((F.col("timestamp") >= start) | (F.col("id") % 4 == 0), F.col("timestamp")).otherwise(moved))
    recent = F.col("timestamp") >= start
    p = F.when(recent, F.least(F.col("probability") * 1.5 + 0.2, F.lit(1.0))).otherwise(F.col("probability"))
    raw = (raw.withColumn("probability", p)
           .withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
           .withColumn("processing_time_ms", F.when(recent, F.col("processing_time_ms") * 20).otherwise(F.col("processing_time_ms"))))
    log = raw.select("*", X.decision("probability").alias("decision"), X.confidence("probability").alias("confidence_level"))
    fb = feedback(spark, sf_dir).withColumn(
        "actual_outcome", F.when(F.col("feedback_id") % 10 == 0, F.col("actual_outcome")).otherwise(F.lit(0)))
    if since_days is not None:
        since = as_of_lit() - F.make_dt_interval(days=F.lit(since_days))
        log, fb = log.where(F.col("timestamp") >= since), fb.where(F.col("feedback_ts") >= since)
    return attach_outcomes(log, fb)


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate alerts: every error event raises one of three alert types."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return e.select(
        F.col("event_id").alias("alert_id"),
        F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string")).alias("type"),
        F.col("ts").alias("timestamp"),
    )


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan applications in the scoring schema, derived from the loan rows.

    Some values fall outside the schema ranges or are missing on purpose,
    which feeds the quarantine path; ``received_at`` is the order date.
    """
    from ..functions.features import add_features, repair_types
    f = add_features(repair_types(loans(spark, sf_dir))[0])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderdate").alias("received_at"))
    k = F.col("ID")
    return f.join(o, "ID").select(
        "ID", "received_at",
        F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 10 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("cust_"), k.cast("string"))).alias("customer_id"),
        "Credit_Amount",
        (k % 12).cast("int").alias("Client_Income_Type"),
        (k % 11).cast("int").alias("Client_Education"),
        (k % 3).cast("int").alias("Client_Gender"),
        F.abs(F.col("Age_Days")).cast("int").alias("Age_Days"),
        F.col("Employed_Days").cast("int").alias("Employed_Days"),
        ((k * 7) % 10500).cast("int").alias("Registration_Days"),
        ((k * 3) % 10000).cast("int").alias("ID_Days"),
        (k % 6).cast("int").alias("Cleint_City_Rating"),
        (k % 2).cast("int").alias("Client_Permanent_Match_Tag"),
        (k % 21).cast("int").alias("Type_Organization"),
        "Score_Source_1", "Score_Source_2", "Score_Source_3",
        (k % 11).cast("int").alias("Phone_Change"),
        F.col("Age_Years").cast("int").alias("Age_Years"),
        F.col("Employment_Years").cast("int").alias("Employment_Years"),
        "Average_External_Score", "Max_External_Score", "Min_External_Score",
    )
