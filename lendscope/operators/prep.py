"""Preparation for learning: fill, encode, split, scale, select, resample.

Fitted statistics (medians, modes, codes, means, F scores) are small
tables keyed by column name; they are computed in one distributed pass
over the unpivoted data and applied with a broadcast join whose size is
the number of columns (or, for codes, the number of distinct categories,
which is checked before it is broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.exprs import try_div
from .profile import ID, TARGET, column_name, split_agg
from ..session import written
from .ranking import as_doubles, exact_quantiles, first_of_class, narrow, rank_in_class

UNKNOWN = "Unknown"
MAP_CODES = 100_000  # codes that are broadcast as maps


def median_fill_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, median) over non-missing values, exact."""
    q = exact_quantiles(df, cols, [0.5])
    return q.select(column_name("column", cols).alias("column"), F.col("quantile").alias("fill"))


def mode_fill_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mode): most frequent value, smallest on a tie, 'Unknown' if none."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    g = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    # two hash aggregations instead of a window per column: a column with
    # many distinct values is never sorted in one task
    top = g.groupBy("column").agg(F.max("n").alias("n"))
    best = g.join(top, ["column", "n"]).groupBy("column").agg(F.min("value").alias("value"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(best, "column", "left").select(
        "column", F.coalesce(F.col("value"), F.lit(UNKNOWN)).alias("fill"))


def _one_row(stats: DataFrame, cols: list[str], value: str = "fill") -> DataFrame:
    """Pivot a (column, value) table with known column names into one row."""
    return stats.groupBy().pivot("column", cols).agg(F.first(value))


def fill_missing(df: DataFrame, keep_types=(ID, TARGET)) -> tuple[DataFrame, dict]:
    """PREP-1 / PREP-2: median fill of numeric columns, mode fill of text columns.

    Numeric columns come out as double (the reference's all-float matrix),
    except ``keep_types`` (id and target), which keep their type.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in df.columns if isinstance(types[c], NumericType)]
    cat = [c for c in df.columns if c not in num]
    # Only columns with a missing value need a fitted fill: one cheap pass
    # counts them (one number per column reaches the driver).
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    num_fit = [c for c in num if nulls[c] > 0]
    cat_fit = [c for c in cat if nulls[c] > 0]
    parts = []
    if num_fit:
        parts.append(median_fill_values(df, num_fit))
    if cat_fit:
        parts.append(mode_fill_values(df, cat_fit).select("column", F.col("fill").cast("string").alias("fill")))
    if parts:
        long = parts[0].select("column", F.col("fill").cast("string").alias("fill"))
        for p in parts[1:]:
            long = long.unionByName(p)
        stats = long.groupBy().pivot("column", num + cat).agg(F.first("fill"))
    else:
        stats = df.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in num + cat])
    # numbers are read from their text here, once, not for every row
    renamed = stats.select(*[F.col(c).cast("double").alias(f"_fill_{c}") for c in num], *[F.col(c).alias(f"_fill_{c}") for c in cat])
    # the fitted fill values are one row: write them once so that later
    # actions (codes, the final scan) do not refit them
    renamed = written(renamed, "fill-values")
    # one row: a bounded broadcast
    j = df.crossJoin(F.broadcast(renamed))
    out = j.select(*[F.coalesce(F.col(c), F.col(f"_fill_{c}").cast("double").cast(types[c])).alias(c)
                     if c in keep_types and c in num
                     else F.coalesce(F.col(c), F.col(f"_fill_{c}")).alias(c) if c in keep_types
                     else F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}").cast("double")).alias(c)
                     if c in num
                     else F.coalesce(F.col(c).cast("string"), F.col(f"_fill_{c}")).alias(c)
                     for c in df.columns])
    return out, {"numeric": num, "categorical": cat}


def label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """PREP-3: (column, value, code) with codes 0.. over sorted distinct values.

    The distinct values are sorted by ranges of (column, value), whose
    bounds Spark takes from the values' distribution; each range is numbered
    on its own and shifted by what its column has in earlier ranges.  So a
    vocabulary is split evenly whatever its values begin with.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    ranges = (long.where(F.col("value").isNotNull()).distinct().repartitionByRange("column", "value")
              .withColumn("_p", F.spark_partition_id()))
    # written once: counts and rows have to see the same ranges
    d = written(ranges, "label-ranges")
    cnt = d.groupBy("column", "_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per column and range
    w_off = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("column", "_p", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w = Window.partitionBy("column", "_p").orderBy("value")
    r = d.withColumn("_r", F.row_number().over(w)).join(off, ["column", "_p"])
    return r.select("column", "value", (F.col("_off") + F.col("_r") - 1).cast("int").alias("code"))


def encode(df: DataFrame, cols: list[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace each text column by its integer code.

    Up to MAP_CODES codes go to every task as one map per column, in one
    broadcast row; a larger table is joined column by column without a hint.
    """
    if not cols:
        return df
    codes = codes if codes is not None else written(label_codes(df, cols), "label-codes")
    if codes.count() <= MAP_CODES:
        maps = codes.groupBy().pivot("column", cols).agg(F.map_from_entries(F.collect_list(F.struct("value", "code"))))
        one = maps.select(*[F.col(c).alias(f"_m_{c}") for c in cols])  # at most MAP_CODES entries in all
        return df.crossJoin(F.broadcast(one)).select(*[F.try_element_at(F.col(f"_m_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                                                       for c in df.columns])
    out = df
    for c in cols:
        cc = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(cc, out[c] == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
        out = out.withColumn(c, F.col(f"_c_{c}")).drop(f"_c_{c}")
    return out


def ml_table(features: DataFrame, target: str = TARGET, id_col: str = ID, keep_id: bool = False, stored: bool = False) -> DataFrame:
    """PREP-1..3 + PRJ-3 / SNK-1 layout: filled, encoded, ID dropped, target last.

    ``features`` is evaluated once and written (unless it is a ``stored`` table): fills, codes and rows read that.
    """
    filled, kinds = fill_missing(features if stored else written(features, "features"))
    cat = [c for c in kinds["categorical"] if c != target]
    enc = encode(filled, cat)
    feats = [c for c in features.columns if c not in (target, id_col)]
    lead = [id_col] if keep_id and id_col in features.columns else []
    return enc.select(*lead, *feats, target)


def stratified_split(df: DataFrame, target: str = TARGET, id_col: str = ID, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """PREP-4: per class, the first round(test_size * n_c) rows by md5(seed|id) are test."""
    return first_of_class(df, target, id_col, test_size, seed, "is_test")


def scaler_stats(train: DataFrame, cols: list[str], stored: bool = False) -> DataFrame:
    """PREP-5: (column, mean, std) with the population std, fitted on train rows (``stored``: rows of a written table)."""
    values = as_doubles(train, cols) if stored else narrow(train, cols)
    one = split_agg(values, [F.struct(F.avg(f"v{i}").alias("mean"), F.stddev_pop(f"v{i}").alias("std")).alias(f"s{i}")
                             for i in range(len(cols))], 5)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}.mean").alias("mean"),
                                                  F.col(f"s{i}.std").alias("std")) for i, c in enumerate(cols)])))


def standardize(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Apply (x - mean) / std; constant columns become 0."""
    one = stats.groupBy().pivot("column", cols).agg(F.first(F.struct("mean", "std")))
    one = one.select(*[F.col(c).alias(f"_s_{c}") for c in cols])
    # one row: a bounded broadcast
    j = df.crossJoin(F.broadcast(one))
    return j.select(*[F.coalesce(try_div(F.col(c) - F.col(f"_s_{c}.mean"), F.col(f"_s_{c}.std")), F.lit(0.0))
                      .alias(c) if c in cols else F.col(c) for c in df.columns])


def anova_f(train: DataFrame, cols: list[str], target: str = TARGET, k: int = 20, stored: bool = False) -> DataFrame:
    """PREP-6: one-way ANOVA F of every column against the target; top k selected.

    One aggregate of count, mean and variance per class and column; the sums
    of squares around the class means don't cancel, however large the values
    are.  A column whose classes are constant but differ separates them
    perfectly (infinite F, ranked first); one that is constant altogether has
    no F and is not selected.  ``stored``: ``train`` are rows of a written table.
    """
    values = (as_doubles if stored else narrow)(train.where(F.col(target).isNotNull()), cols, target)
    g = split_agg(values, [F.struct(F.count(f"v{i}").alias("n"), F.avg(f"v{i}").alias("m"), F.var_pop(f"v{i}").alias("v")).alias(f"s{i}")
                           for i in range(len(cols))], 6, target)
    per = g.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}.n").alias("n"), F.col(f"s{i}.m").alias("m"),
                                               F.col(f"s{i}.v").alias("v")) for i, c in enumerate(cols)]))).where("n > 0")
    # one row per class and column from here on
    mean = per.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_all"))
    a = per.join(F.broadcast(mean), "column").groupBy("column").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * (F.col("m") - F.col("_all")) * (F.col("m") - F.col("_all"))).alias("ssb"))
    f = F.when(F.col("ssw") > 0, try_div(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))) \
        .when(F.col("ssb") > 0, F.lit(float("inf")))
    out = a.select("column", F.when(F.col("k") > 1, f).alias("f_score"))
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("column"))
    r = out.withColumn("rank", F.row_number().over(w))
    return r.withColumn("selected", F.col("f_score").isNotNull() & (F.col("rank") <= k))


def undersample(train: DataFrame, target: str = TARGET, id_col: str = ID, ratio: float = 0.3,
                seed: int = 42) -> DataFrame:
    """PREP-9: keep every minority row and int(n1 / ratio) majority rows, seeded, exact."""
    n1 = train.agg(F.count_if(F.col(target) == 1).alias("_n1"))
    r = rank_in_class(train, target, id_col, seed, rank_col="_rank")
    # one row: a bounded broadcast
    r = r.crossJoin(F.broadcast(n1))
    keep = (F.col(target) == 1) | (F.col("_rank") <= F.floor(F.col("_n1") / ratio))
    return r.where(keep).drop("_rank", "_n1")


def class_weights(train: DataFrame, target: str = TARGET) -> DataFrame:
    """PREP-10: balanced weights n / (2 n_c) per class."""
    g = train.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    tot = train.agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(tot)).select(
        target, F.col("n_c").cast("bigint").alias("n_c"),
        (F.col("n") / (F.lit(2.0) * F.col("n_c"))).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, target: str = TARGET, col: str = "weight") -> DataFrame:
    # one row per class: a bounded broadcast
    return df.join(F.broadcast(weights.select(target, F.col("weight").alias(col))), target, "left")
