"""Mixing sources to target weights by capped water-filling.

All words of all sources are shared out by weight.  A source cannot give more
than ``max_epochs`` times its words, so sources above that are clamped there
and what they leave is shared out among the others by weight, until no source
is above its cap.  A source's target is then filled with whole repetitions of
every document and, for the fractional rest, with documents taken in a seeded
order until the rest is reached; one document of fitting size is exchanged at
the end so that the taken words come as near to the target as one exchange can.

Scale: only id, source and word count leave the scan.  The level of the water
is found by rounds over the table of sources, one aggregate each; running
totals are taken in two levels (``running_total``), so a source with a third
of all rows is spread over 4,096 buckets or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_digits, join_hot_split, materialize, n_words, running_total, seeded_key, table, with_row_key

# Fixed values of the mix: weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def weighted_sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: source_size, n_docs and the weight of its place in code-point order, null last."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    null_last = [F.col("source").isNull(), F.col("source")]
    # Ranged parts are written first: their ids have to be the same for counts and rows.
    parts = materialize(sums.repartitionByRange(*null_last).withColumn("_part", F.spark_partition_id()), "mix-sources")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*null_last)) - 1 + F.col("_start")
    w = F.array(*[F.lit(float(x)) for x in weights])
    return parts.join(starts, "_part").select(
        "source", "source_size", "n_docs", F.get(w, (place % len(weights)).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``target``: weight times the level, or max_epochs times the source's size where that is less."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        above = cap < F.col("weight") * F.lit(level)
        total, fixed, open_weight, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))),
            F.sum(above.cast("long"))).first()
        if n is None or n == clamped or not open_weight:
            break
        # The level only rises, so sources that are clamped stay so, and the rounds end.
        level, clamped = (total - (fixed or 0.0)) / open_weight, n
    target = F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1",
        text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, source.

    ``copies`` says how often the mix repeats the document (0 to max_epochs),
    ``taken`` is copies times size.  Null texts have no words; documents
    without words are taken by whole repetitions only, and a source without
    words has target 0.  A null source is one source, the last.  Rows with equal
    ids (or none) are ordered by size and then by a number of their own, so the
    exchange at the end moves one row, however many are equal to it.  An empty
    table gives an empty result.
    ``row`` names a column that tells rows apart; it is given back as ``_row``.
    """
    keys = ["_row"] if row else []
    if not row:
        docs, row = with_row_key(docs, "mix-docs")
    rows = materialize(docs.select(
        F.col(row).alias("_row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size")), "mix-rows")
    total = rows.count()
    src = materialize(water_fill(materialize(weighted_sources(rows, weights), "mix-weights"), max_epochs)
                      .withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
                      .drop("source"), "mix-targets")
    keyed = rows.withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    order = running_total(keyed.withColumn("_key", seeded_key(seed)), "_src", "_key", F.col("size"),
                          hash_digits(total), ["doc_id", "size", "_row"])
    plan = join_hot_split(order, src, "_src", "n_docs", total)
    size = F.col("size")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    extra = ((size > 0) & (rest > 0) & (F.col("before") + size / 2 <= rest)).cast("long")
    first = materialize(plan.withColumn("_whole", whole).withColumn("_rest", rest).withColumn("_extra", extra), "mix-first")
    # What is still missing (or too much) of each source, and the document whose exchange mends most of it.
    gap = (first.groupBy("_src").agg(F.max("_rest").alias("_r"), F.sum(F.col("_extra") * size).alias("_got"),
                                     F.count(F.lit(1)).alias("_docs"))
           .withColumn("_gap", F.col("_r") - F.col("_got")))
    near = join_hot_split(first.select("_src", "doc_id", "size", "_extra", "_key", "_rest", "_row"), gap, "_src", "_docs", total)
    fits = (((F.col("_gap") > 0) & (F.col("_extra") == 0) | (F.col("_gap") < 0) & (F.col("_extra") == 1))
            & (size > 0) & (F.col("_rest") > 0) & (F.abs(F.abs("_gap") - size) < F.abs("_gap")))
    swap = (near.where(fits).groupBy("_src")
            .agg(F.min(F.struct(F.abs(F.abs("_gap") - size).alias("off"), "_key", "doc_id", "size", "_row")).alias("s"))
            .select("_src", F.col("s._row").alias("_swap")))
    every = (src.select("_src", F.col("n_docs").alias("_docs"))
             .join(swap, "_src", "left"))
    done = join_hot_split(first, every, "_src", "_docs", total)
    copies = F.col("_whole") + F.when(F.col("_row") == F.col("_swap"), 1 - F.col("_extra")).otherwise(F.col("_extra"))
    return done.withColumn("copies", copies.cast("int")).select(
        *keys, "doc_id", "size", "source_size", "target", (size * F.col("copies")).alias("taken"), "copies", "source")


def op6_capped_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, weights 5, 2, 1 repeating, three epochs at most."""
    return mix(table(spark, sf_dir, "documents")).drop("copies", "source")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it."""
    keyed, key = with_row_key(docs, "mix-keys")
    copies = mix(keyed, row=key).where("copies > 0").select(F.col("_row").alias(key), F.col("copies").alias("_copies"))
    turn = next(f"turn{i}" for i in range(len(docs.columns) + 1) if f"turn{i}" not in docs.columns)
    j = keyed.join(copies, key)
    return j.select(*[keyed[c] for c in docs.columns],
                    F.explode(F.sequence(F.lit(1), copies["_copies"])).alias(turn)).drop(turn)
