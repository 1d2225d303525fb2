"""File sources and sinks: CSV loan files, JSON-lines alert logs, the
date-partitioned prediction log, and the features-as-JSON column.

Readers always pass an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Text the CSV loader treats as missing (pandas defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

ALERT_SCHEMA = ("timestamp string, alert struct<type: string, severity: string, message: string, "
                "value: double, threshold: double, timestamp: string>")


def read_loans_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC-1: header CSV read as text, NA tokens -> null; typing is left to ``repair_types``."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.csv(path, header=True, schema=schema, nullValue=None, emptyValue="")
    return raw.select(*[F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)).alias(c) for c in columns])


def type_like(df: DataFrame, template: DataFrame, text_columns: list[str]) -> DataFrame:
    """Cast text columns to the template's types, except the ones left as text for repair."""
    types = {f.name: f.dataType for f in template.schema.fields}
    return df.select(*[F.col(c) if c in text_columns else F.col(c).try_cast(types[c]).alias(c)
                       for c in df.columns])


def write_processed(df: DataFrame, path: str, target: str = "Default", fmt: str = "parquet") -> None:
    """SNK-1: processed table, target last, no index."""
    cols = [c for c in df.columns if c != target] + [target]
    w = df.select(*cols).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


SEVERE_IMBALANCE = 20  # fixed value: non-defaults per default above which training warns


def read_processed(spark: SparkSession, path: str, target: str = "Default") -> DataFrame:
    """SRC-2: processed table; the target column is required."""
    df = spark.read.parquet(path)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} missing from {path}")
    return df


def processed_summary(df: DataFrame, target: str = "Default") -> DataFrame:
    """SRC-2: rows, columns, rows per class, imbalance ratio and its warning as one row; no ratio without defaults."""
    y = F.col(target)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y == 0).alias("n_0"), F.count_if(y == 1).alias("n_1"))
    ratio = F.when(F.col("n_1") > 0, F.col("n_0") / F.col("n_1"))
    return one.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_0", "n_1", ratio.alias("imbalance_ratio"),
                      F.coalesce(ratio > SEVERE_IMBALANCE, F.col("n_0") > 0).alias("severe_imbalance"))


def encode_features(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """SNK-3: the feature record as JSON text (customer id excluded)."""
    return df.withColumn(out, F.to_json(F.struct(*features)))


def decode_features(df: DataFrame, schema: StructType, col: str = "features") -> DataFrame:
    return df.withColumn("_f", F.from_json(col, schema)).select("*", "_f.*").drop("_f")


def write_alerts(alerts: DataFrame, path: str, written_at) -> None:
    """SNK-4: alert log as JSON lines {timestamp, alert{...}}."""
    alerts.select(written_at.alias("timestamp"), F.struct(*alerts.columns).alias("alert")) \
        .write.mode("append").json(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: alert log with a fixed schema, nested alert flattened."""
    return spark.read.schema(ALERT_SCHEMA).json(path).select(
        F.col("timestamp").alias("logged_at"), "alert.*")
