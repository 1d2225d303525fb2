"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

# Fixed value: the white space that separates words, \x20 and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key with more than 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE
# keys are, whatever the size of the data: the bound of every hot-key broadcast.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared checkpoint folder and reread it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_in_small_batches(df: DataFrame, name: str, rows: int = 500) -> DataFrame:
    """``materialize`` with Arrow batches of so many rows, where several Python steps stand in one stage.

    Spark's default of 10,000 texts a batch is held once in the JVM and once in
    each step's worker.  The setting is put back when the table is written.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(rows))
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


ROWS_OF_FILE = 1 << 40  # row numbers of a file; with 2 ** 22 files they stay below 2 ** 62


def _is_table(df: DataFrame) -> bool:
    """Whether each row of ``df`` is one row of a Parquet table (a scan with projections and filters, no more)."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def with_row_key(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, the same at every reading, and that column's name.

    A Parquet table's rows are numbered by file and place in it; anything else is written first.
    """
    key = next(f"_row{i}" for i in range(len(docs.columns) + 1) if f"_row{i}" not in docs.columns)
    if not _is_table(docs):
        return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name), key
    placed = docs.select(F.struct("*").alias("_doc"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    # One row per file.
    files = materialize(placed.select("_file").distinct().select(
        "_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_no")), name)
    return placed.join(F.broadcast(files), "_file").select(
        "_doc.*", (F.col("_no") * ROWS_OF_FILE + F.col("_place")).alias(key)), key


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_array(c: Column) -> Column:
    """Words of a text (null: none), without the empty strings that split leaves at both ends."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS), "")


def n_words(c: Column) -> Column:
    """Number of words: the splits' pieces less the empty ones at both ends."""
    t = F.coalesce(c, F.lit(""))
    return F.size(F.array_remove(F.split(t, SPACE_CLASS), "")).cast("long")


def join_hot_split(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, safe when one key holds a third of all rows.

    ``groups[size]`` is the number of rows of the key.  Keys with more than
    total / HOT_SHARE rows (at most HOT_SHARE of them) are broadcast; the
    others are joined by a shuffle in which no key has more rows than that.
    """
    is_hot = F.col(size) * F.lit(HOT_SHARE) > F.lit(total)
    hot = groups.where(is_hot)
    warm = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(~is_hot), key)
    return warm.unionByName(cold)


BUCKET_ROWS = 50_000
MIN_DIGITS = 3


def hash_digits(total: int) -> int:
    """Hex digits of a bucket key: 4,096 buckets, more when they would hold over BUCKET_ROWS rows each."""
    d = MIN_DIGITS
    while total > BUCKET_ROWS * 16 ** d:
        d += 1
    return d


def seeded_key(seed: str, doc_id: str = "doc_id") -> Column:
    """Seeded shuffle order of documents: an md5 hex string (a null id counts as empty)."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def running_total(rows: DataFrame, stratum: str, key: str, value: Column, digits: int, ties: list[str]) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the rows ahead in the order of ``key``, and ``whole``.

    Per stratum (null is one too).  Counted in two levels: windows inside a
    bucket of the first ``digits`` hex digits of ``key``, plus running totals
    over at most 16 ** digits bucket sums of the stratum.  So no stratum,
    however large, is sorted in one task.
    """
    b = rows.withColumn("_bucket", F.substring(key, 1, digits)).withColumn("_value", value)
    sums = b.groupBy(stratum, "_bucket").agg(F.sum("_value").alias("_sum"))
    run = Window.partitionBy(stratum).orderBy("_bucket")
    starts = sums.select(
        F.col(stratum).alias("_s"), F.col("_bucket").alias("_b"),
        (F.sum("_sum").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_start"),
        F.sum("_sum").over(Window.partitionBy(stratum)).alias("whole"))
    inner = (Window.partitionBy(stratum, "_bucket").orderBy(key, *ties)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = b.join(starts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return (j.withColumn("before", F.sum("_value").over(inner) - F.col("_value") + F.col("_start"))
            .drop("_bucket", "_s", "_b", "_sum", "_start", "_value"))
