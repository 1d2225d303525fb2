"""Date-partitioned tables written batch by batch, each batch once.

Rows lie under ``data/date=.../batch_id=...``; a batch replaces its own
partitions and no other (dynamic partition overwrite).  When its rows are
written, its manifest (one row per date: date, rows) is put under
``commits/batch_id=...``.  Readers take only partitions that a manifest
names, so a batch that died half-way is not seen, one that is run again
leaves one copy, and partitions of an earlier attempt with other dates stay
unseen.  Filters on the date and on the committed batches are partition
filters: a look-back opens the files of its own days only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "date date, n_rows long, batch_id long"


def stage_batch(df: DataFrame, path: str, batch_id: int, date: str = "date") -> None:
    """Write the batch's rows (partitioned by ``date`` and the batch) without committing them."""
    (df.withColumn("date", F.col(date)).withColumn("batch_id", F.lit(int(batch_id)).cast("long")).repartition("date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(f"{path}/data"))


def commit_batch(df: DataFrame, path: str, batch_id: int, date: str = "date") -> None:
    """Write the batch and then its manifest.  ``df`` has to give the same rows at both readings (a written table)."""
    stage_batch(df, path, batch_id, date)
    (df.groupBy(F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("n_rows")).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/commits/batch_id={int(batch_id)}"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(date, n_rows, batch_id) of all committed batches; one row per batch and date."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], COMMITS)
        raise


def read_committed(spark: SparkSession, path: str, schema: str, since: dt.date | Column | None = None,
                   until: dt.date | Column | None = None) -> DataFrame:
    """Committed rows of the days from ``since`` to ``until`` (both included); ``schema`` without date and batch_id.

    The manifest's (date, batch) pairs are the small side of the join, a row per
    file group: Spark broadcasts them while they are measured to be small and
    prunes the batches at run time.
    """
    found = commits(spark, path)
    if found.isEmpty():
        return spark.createDataFrame([], f"{schema}, date date, batch_id long")
    rows = spark.read.schema(f"{schema}, date date, batch_id long").parquet(f"{path}/data")
    for bound, keep in ((since, lambda c, b: c >= b), (until, lambda c, b: c <= b)):
        if bound is not None:
            b = bound if isinstance(bound, Column) else F.lit(bound)
            rows, found = rows.where(keep(F.col("date"), b)), found.where(keep(F.col("date"), b))
    seen = found.select(F.col("date").alias("_date"), F.col("batch_id").alias("_batch"))
    return rows.join(seen, F.col("date").eqNullSafe(F.col("_date")) & (F.col("batch_id") == F.col("_batch")), "left_semi")
