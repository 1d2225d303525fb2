"""Proportional stratified interleaving into shards.

Every source's rows are put in a seeded random order; the row with rank r of n
gets the fractional rank (2r - 1) / 2n.  All rows sorted by fractional rank
are an even interleaving of the sources, so equal cuts of it hold every source
in the mixture's proportion (within two rows), and shard sizes differ by one
row at most.

Scale: both ranks are counted in two levels.  Rows fall into buckets of the
order (a prefix of the md5 of the id; sampled ranges of fraction, source and
md5), windows number the rows inside a bucket, and running totals over the
bucket counts give the bucket's start.  A source with a third of all rows is
spread over all buckets like the others, and so are very many sources of one
row, whose fractions are all one half.  Only id, source, size and checksum are shuffled, not texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_digits, materialize, running_total, seeded_key, table

def interleave(docs: DataFrame, shards: int = 16, seed: str = "shard-1", text: str = "text",
               source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, rank.

    Law ``rows``: shard sizes differ by one row at most, whatever the sizes of
    texts and whichever texts are equal.  Null texts have no bytes (size 1,
    checksum 0), a null source is a source of its own, rows with equal ids
    (or none) are ordered by size and checksum.  Fewer rows than shards leave
    shards empty; an empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32")), "shard-rows")
    total = rows.count()
    digits = hash_digits(total)
    ties = ["doc_id", "size", "text_crc32"]
    ranked = (running_total(rows.withColumn("_key", seeded_key(seed)), "source", "_key", F.lit(1), digits, ties)
              .withColumn("rank", F.col("before") + 1))
    frac = ranked.withColumn("_frac", (2 * F.col("rank") - 1) / (2 * F.col("whole")))
    order = ["_frac", "source", "_key", *ties]
    # Ranges of the whole order, so that rows of one fraction (as many as there are small sources) spread too.
    # Written: counts and places have to see the same ranges.
    cut = materialize(frac.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shard-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = cut.join(starts, "_range").withColumn("_place", F.row_number().over(inside) - 1 + F.col("_start"))
    # The first place of shard s is the least p with floor(p * k / n) = s; whole numbers only.
    exact = F.expr(f"cast((_place * {shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(cast(shard as long) * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", exact).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "source", "rank")


def op4_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards."""
    return interleave(table(spark, sf_dir, "documents")).drop("source", "rank")
