"""Data profiling: shape, missing values, target balance, duplicates,
IQR outliers, consistency checks, correlations, cross-tabs, histograms.

Wide statistics never run one job per column: the table is unpivoted to
(column index, value) and aggregated by column in one pass.  Aggregates
with a map-side combine (count, sums, covariance) shrink every partition
to one row per column before the shuffle, so a column holding all rows is
not a hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.exprs import try_div
from .ranking import narrow, quantile_rows

TARGET = "Default"
ID = "ID"
# Profiling limits of the reference.
MIN_VALID_SHARE = 0.1
IQR_K = 1.5
AGE_MIN_YEARS, AGE_MAX_YEARS = 18, 100
IMBALANCE_EDA, IMBALANCE_SEVERE = 3, 20


def numeric_columns(df: DataFrame, exclude=(ID,)) -> list[str]:
    """PRJ-5: numeric columns by type, minus the excluded ones."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def unpivot_numeric(df: DataFrame, cols: list[str], key: str = "column", value: str = "value",
                    keep: list[str] | None = None) -> DataFrame:
    """Long form (keep..., key, value) with ``key`` the 0-based column index.

    An integer key hashes and compares much faster than the name in the
    per-column aggregations; ``column_name`` maps it back at the end.
    """
    keep = keep or []
    pairs = F.array(*[F.struct(F.lit(i).alias(key), F.col(c).cast("double").alias(value))
                      for i, c in enumerate(cols)])
    return df.select(*keep, F.inline(pairs))


def column_name(idx, cols: list[str]):
    """Column index -> name (the inverse of ``unpivot_numeric``'s key)."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.element_at(F.array(*[F.lit(c) for c in cols]), i + 1)


def split_agg(df: DataFrame, aggs: list[Column], fields: int, by: str | None = None) -> DataFrame:
    """One aggregate, computed as several of so few buffer fields (``fields`` each) that Spark generates code for them.

    Above spark.sql.codegen.maxFields (100) an aggregate is interpreted.  ``df``
    should be a narrow written table, as each part scans its own columns.
    Without ``by`` the parts are one row each; with it one per (non-null) value
    of ``by``, a handful.
    """
    step = max(1, 90 // fields)
    parts = [df.groupBy(*([by] if by else [])).agg(*aggs[i:i + step]) for i in range(0, len(aggs), step)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), by) if by else out.crossJoin(F.broadcast(p))
    return out


def shape(df: DataFrame) -> DataFrame:
    """AGG-1: rows, columns and the type histogram as one row."""
    kinds = {"numeric": len(numeric_columns(df, exclude=())), "text": len(text_columns(df))}
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(kinds["numeric"]).alias("n_numeric"), F.lit(kinds["text"]).alias("n_text"))


def missing_profile(df: DataFrame, top: int | None = 10) -> DataFrame:
    """AGG-2 / SORT-1: missing count and percent per column, > 0 only, largest first."""
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[(F.count(F.lit(1)) - F.count(F.col(c))).alias(c) for c in df.columns])
    long = one.unpivot(["_n"], list(df.columns), "column", "missing_count")
    out = long.where(F.col("missing_count") > 0).select(
        "column", F.col("missing_count").cast("bigint").alias("missing_count"),
        (F.col("missing_count") / F.col("_n") * 100).alias("missing_percentage"))
    return _ranked(out, "missing_count", top)


def _ranked(df: DataFrame, by: str, top: int | None, name: str = "column") -> DataFrame:
    """Rank by ``by`` desc then name; the table is one row per column (tiny)."""
    from pyspark.sql import Window
    w = Window.orderBy(F.col(by).desc(), F.col(name))
    r = df.withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= top) if top else r


def target_balance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """AGG-3 / AGG-10: class counts, shares, imbalance ratio n0/n1 and flags."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 0).alias("n0"),
               F.count_if(F.col(target) == 1).alias("n1"))
    ratio = try_div(F.col("n0"), F.col("n1"))
    return a.select(F.col("n0").cast("bigint").alias("n_no_default"),
                    F.col("n1").cast("bigint").alias("n_default"),
                    (try_div("n0", "n") * 100).alias("pct_no_default"),
                    (try_div("n1", "n") * 100).alias("pct_default"),
                    ratio.alias("imbalance_ratio"),
                    F.coalesce(ratio > IMBALANCE_EDA, F.lit(False)).alias("needs_balancing"),
                    F.coalesce(ratio > IMBALANCE_SEVERE, F.lit(False)).alias("severe_imbalance"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG-10: counts per value (missing values not counted)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """AGG-4: rows equal to an earlier row (missing equals missing)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def iqr_outliers(df: DataFrame, cols: list[str] | None = None, top: int | None = 10) -> DataFrame:
    """AGG-5: IQR outliers per numeric column.

    Columns with fewer than 10 % non-missing values, IQR 0 or no outlier
    are left out; the percentage is over all rows.
    """
    cols = cols if cols is not None else numeric_columns(df)
    values = narrow(df, cols)
    found: dict[int, dict[float, float | None]] = {}
    valid: dict[int, int] = {}
    for i, q, x, n in quantile_rows(values, len(cols), [0.25, 0.75]):
        found.setdefault(i, {})[q], valid[i] = x, n
    fences = [(i, c[0.25], c[0.75], valid[i]) for i, c in found.items() if valid[i] and c[0.75] > c[0.25]]
    # the fences are literals of one more scan; the answer has one row per column
    counts = values.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if((F.col(f"v{i}") < q1 - IQR_K * (q3 - q1)) | (F.col(f"v{i}") > q3 + IQR_K * (q3 - q1))).alias(f"o{i}")
        for i, q1, q3, _ in fences]).first()
    rows = [(cols[i], q1, q3, counts[f"o{i}"], counts[f"o{i}"] / counts["n_rows"] * 100) for i, q1, q3, n in fences
            if n >= counts["n_rows"] * MIN_VALID_SHARE and counts[f"o{i}"]]
    out = df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double, outliers long, percentage double")
    return _ranked(out, "outliers", top)


def consistency(df: DataFrame) -> DataFrame:
    """AGG-6 / AGG-7: unrealistic ages (missing counted as age 0) and non-positive incomes."""
    aggs = []
    if "Age_Days" in df.columns:
        years = F.abs(F.coalesce(F.col("Age_Days").cast("double"), F.lit(0.0))) / 365.25
        aggs += [F.count_if((years < AGE_MIN_YEARS) | (years > AGE_MAX_YEARS)).cast("bigint").alias("unrealistic_age"),
                 F.count_if(F.col("Age_Days").isNull()).cast("bigint").alias("missing_age")]
    if "Client_Income" in df.columns:
        inc = F.col("Client_Income").cast("double")
        aggs += [F.count_if(inc <= 0).cast("bigint").alias("non_positive_income"),
                 F.count_if(inc.isNull()).cast("bigint").alias("missing_income")]
    return df.agg(*aggs)


def target_correlation(df: DataFrame, target: str = TARGET, top: int | None = 10) -> DataFrame:
    """AGG-8: |Pearson r| of each numeric column with the target, pairwise complete.

    Constant columns (zero variance) give no correlation and are left out.
    """
    cols = numeric_columns(df, exclude=(ID, target))
    pairs = narrow(df, [*cols, target])
    y = F.col(f"v{len(cols)}")
    one = split_agg(pairs, [F.struct(F.covar_pop(x, yy).alias("cov"), F.stddev_pop(x).alias("sx"), F.stddev_pop(yy).alias("sy"))
                            .alias(f"s{i}") for i in range(len(cols))
                            for x, yy in [(F.when(y.isNotNull(), F.col(f"v{i}")), F.when(F.col(f"v{i}").isNotNull(), y))]], 10)
    g = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"s{i}.cov").alias("cov"),
                                               F.col(f"s{i}.sx").alias("sx"), F.col(f"s{i}.sy").alias("sy"))
                                      for i in range(len(cols))])))
    r = g.select(column_name("column", cols).alias("column"),
                 F.abs(try_div(F.col("cov"), F.col("sx") * F.col("sy"))).alias("abs_corr")) \
        .where(F.col("abs_corr").isNotNull())
    return _ranked(r, "abs_corr", top)


def crosstab_share(df: DataFrame, row: str = "Asset_Score", col: str = TARGET) -> DataFrame:
    """AGG-9: row-normalised cross-tab in percent, for target values 0 and 1."""
    d = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    g = d.groupBy(row).agg(F.count_if(F.col(col) == 0).alias("c0"), F.count_if(F.col(col) == 1).alias("c1"),
                           F.count(F.lit(1)).alias("n"))
    return g.select(row, (F.col("c0") / F.col("n") * 100).alias("pct_0"),
                    (F.col("c1") / F.col("n") * 100).alias("pct_1"))


def histogram(df: DataFrame, col: str, bins: int, positive_only: bool = False) -> DataFrame:
    """AGG-11 / AGG-12 (and PRJ-13): equal-width bins over [min, max], last bin closed.

    Every bin is returned, empty ones with count 0.
    """
    v = F.col(col).cast("double")
    d = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if positive_only:
        d = d.where(F.col("v") > 0)
    rng = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                       F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    # one-row range: a bounded broadcast
    counts = d.crossJoin(F.broadcast(rng)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width)
        .alias("bin_end"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
