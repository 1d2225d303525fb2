"""Classification quality: confusion counts, rates, ROC-AUC, ROC curve, KS.

All are exact.  Rank statistics group by score first (one row per distinct
score) and then use the bucketed prefix sums of ``ranking``, so no
operator sorts the whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ks_pvalue, try_div
from ..session import written
from .ranking import prefix_sums, ranged


def confusion_aggs(y: str = "y", pred: str = "pred") -> list[Column]:
    yc, pc = F.col(y), F.col(pred)
    return [
        F.count_if((yc == 1) & (pc == 1)).alias("tp"),
        F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"),
        F.count_if((yc == 0) & (pc == 0)).alias("tn"),
    ]


def rates(tp="tp", fp="fp", fn="fn", tn="tn") -> list[Column]:
    """accuracy, precision, recall, f1 with 0 where undefined (zero_division=0)."""
    tp, fp, fn, tn = (F.col(c) for c in (tp, fp, fn, tn))
    prec = F.coalesce(try_div(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(try_div(tp, tp + fn), F.lit(0.0))
    return [
        F.coalesce(try_div(tp + tn, tp + fp + fn + tn), F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(try_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
    ]


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """ML-6: one row of counts and rates."""
    c = df.agg(*confusion_aggs(y, pred))
    return c.select("*", *rates())


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """ML-7: exact ROC-AUC with ties counted half (Mann-Whitney).

    One row ``(auc, n_pos, n_neg)``; auc is null when a class is absent.
    """
    return auc_of_counts(score_counts(df, y, score))


def auc_of_counts(counts: DataFrame) -> DataFrame:
    """``roc_auc`` of (score, pos, neg), one row per distinct score."""
    g = prefix_sums(counts, "score", ["neg"])
    part = g.select((F.col("pos") * (F.col("neg_cum") - F.col("neg") + F.col("neg") / 2.0)).alias("u"),
                    "pos", "neg")
    a = part.agg(F.sum("u").alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select(
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
        F.coalesce(F.col("n_pos"), F.lit(0)).cast("bigint").alias("n_pos"),
        F.coalesce(F.col("n_neg"), F.lit(0)).cast("bigint").alias("n_neg"))


def _corners(counts: DataFrame) -> DataFrame:
    """The (score, pos, neg, ...) rows at which the ROC curve turns, and its two ends.

    Going down the scores, a point lies on a straight line where the next
    score adds the same positives and negatives; of such a run the last stays,
    and of all points the first and the last.  Neighbours are looked up inside
    a range of scores; a range's least row comes from the table of ranges.
    """
    d = ranged(counts, ["score"])
    step = F.struct("pos", "neg")
    last = Window.orderBy("_b")  # one row per range
    border = d.groupBy("_b").agg(F.max_by(step, "score").alias("_top"), F.max("score").alias("_max"))
    border = border.select("_b", F.lag("_top").over(last).alias("_below"), F.max("_max").over(Window.partitionBy()).alias("_highest"))
    below = F.coalesce(F.lag(step).over(Window.partitionBy("_b").orderBy("score")), F.col("_below"))
    return (d.join(F.broadcast(border), "_b").withColumn("_next", below)
            .where(F.col("_next").isNull() | (F.col("_next") != step) | (F.col("score") == F.col("_highest")))
            .drop("_b", "_below", "_highest", "_next"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", corners_only: bool = False) -> DataFrame:
    """ML-11: (threshold, fpr, tpr) at every distinct score, plus the (0, 0) point.

    A point at threshold t counts rows with score >= t as positive.  With
    ``corners_only`` points on a straight line between their neighbours are left out.
    """
    g = prefix_sums(score_counts(df, y, score).where("pos + neg > 0"), "score", ["pos", "neg"])
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    g = (_corners(g) if corners_only else g).crossJoin(F.broadcast(tot))  # one row
    pts = g.select(
        F.col("score").cast("double").alias("threshold"),
        try_div(F.col("N") - F.col("neg_cum") + F.col("neg"), F.col("N")).alias("fpr"),
        try_div(F.col("P") - F.col("pos_cum") + F.col("pos"), F.col("P")).alias("tpr"))
    origin = tot.select(F.lit(float("inf")).alias("threshold"),
                        F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                        F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    return pts.unionByName(origin)


def ks_two_sample(df: DataFrame, value: str, flag: str) -> DataFrame:
    """MON-2: two-sample KS between rows with flag 1 and flag 0.

    One row ``(n1, n0, ks_statistic, p_value)``; the p-value is exact up to
    10,000 rows a sample and the Kolmogorov series above (``ks_pvalue``).
    """
    g = df.where(F.col(value).isNotNull()).groupBy(F.lit("").alias("metric"), F.col(value).alias("value")).agg(
        F.count_if(F.col(flag) == 1).alias("c1"), F.count_if(F.col(flag) == 0).alias("c0"))
    one = df.sparkSession.createDataFrame([("",)], "metric string")
    return one.join(ks_of_counts(g), "metric", "left").select(
        F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n0", F.lit(0)).alias("n0"), "ks_statistic", "p_value")


def ks_of_counts(counts: DataFrame) -> DataFrame:
    """(metric, n1, n0, ks_statistic, p_value) of (metric, value, c1, c0), one row per distinct value; all metrics in one pass."""
    g = written(prefix_sums(counts, "value", ["c1", "c0"], by=["metric"]), "ks-sums")
    tot = g.groupBy("metric").agg(F.sum("c1").cast("bigint").alias("n1"), F.sum("c0").cast("bigint").alias("n0"))
    # one row per metric
    d = g.join(F.broadcast(tot), "metric").groupBy("metric", "n1", "n0").agg(
        F.max(F.abs(try_div(F.col("c1_cum"), F.col("n1")) - try_div(F.col("c0_cum"), F.col("n0")))).alias("ks_statistic"))
    return d.withColumn("p_value", ks_pvalue("n1", "n0", "ks_statistic"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """ML-12: 2 x 2 counts as rows (actual, predicted, n), zeros filled."""
    c = df.agg(*confusion_aggs(y, pred))
    def cell(a, p, n):
        return F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(n).alias("n"))

    return c.select(F.inline(F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """ML-10: per-class precision/recall/F1/support, accuracy, macro and weighted avg."""
    c = df.agg(*confusion_aggs(y, pred))

    def cls(label, tp, fp, fn):
        tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
        p = F.coalesce(try_div(tp, tp + fp), F.lit(0.0))
        r = F.coalesce(try_div(tp, tp + fn), F.lit(0.0))
        f = F.coalesce(try_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), (tp + fn).cast("double").alias("support"))

    per = c.select(F.inline(F.array(cls("0", "tn", "fn", "fp"), cls("1", "tp", "fp", "fn"))))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    acc = c.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   F.coalesce(try_div(F.col("tp") + F.col("tn"), n), F.lit(0.0)).alias("f1_score"),
                   n.cast("double").alias("support"))
    tot = per.agg(F.sum("support").alias("s"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("s").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"),
                          F.coalesce(try_div("wp", "s"), F.lit(0.0)).alias("precision"),
                          F.coalesce(try_div("wr", "s"), F.lit(0.0)).alias("recall"),
                          F.coalesce(try_div("wf", "s"), F.lit(0.0)).alias("f1_score"),
                          F.col("s").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


# Threshold sweep of the optimiser, 0.10 to 0.85 by 0.05.
# Steps are start + i * ((start + step) - start), the float grid of an
# arange, so step 11 is 0.6500000000000001.
SWEEP_START, SWEEP_STEP, SWEEP_N = 0.1, 0.05, 16


def sweep_thresholds() -> list[float]:
    delta = (SWEEP_START + SWEEP_STEP) - SWEEP_START
    return [SWEEP_START + i * delta for i in range(SWEEP_N)]


def threshold_sweep(df: DataFrame, y: str = "y", score: str = "score",
                    thresholds: list[float] | None = None) -> DataFrame:
    """ML-14: precision/recall/F1 of ``score >= t`` for every threshold.

    Each row is bucketed once by the highest threshold it passes, so the
    table is aggregated to at most len(thresholds)+1 rows before the
    reverse running sum; no row is copied per threshold.
    """
    ts = sorted(thresholds or sweep_thresholds())
    s = F.col(score)
    k = F.lit(0)
    for t in ts:
        k = k + (s >= F.lit(t)).cast("int")
    g = df.groupBy(k.alias("k")).agg(F.count_if(F.col(y) == 1).alias("pos"),
                                    F.count_if(F.col(y) == 0).alias("neg"))
    spark = df.sparkSession
    tdf = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(ts)], "k int, threshold double")
    # k >= i means the row passes threshold i; <= 17 aggregated rows each side
    j = tdf.join(F.broadcast(g.withColumnRenamed("k", "gk")), F.col("gk") >= F.col("k"), "left")
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = j.groupBy("k", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"),
                                        F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    c = c.crossJoin(F.broadcast(tot))
    c = c.select("threshold", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                 (F.col("P") - F.col("tp")).cast("bigint").alias("fn"),
                 (F.col("N") - F.col("fp")).cast("bigint").alias("tn"))
    return c.select("*", *rates())


# Business score weights and the optimiser's precision goals.
BUSINESS_W_PRECISION, BUSINESS_W_F1 = 0.7, 0.3
TARGET_PRECISION = 0.25
BALANCED_MIN_PRECISION = 0.20


def business_score(precision="precision", f1="f1_score") -> Column:
    """ML-19: 0.7 precision + 0.3 F1."""
    return BUSINESS_W_PRECISION * F.col(precision) + BUSINESS_W_F1 * F.col(f1)


def choose_thresholds(sweep: DataFrame, target_precision: float = TARGET_PRECISION,
                      balanced_min: float = BALANCED_MIN_PRECISION) -> DataFrame:
    """ML-15 / ML-16: pick a threshold per strategy from a sweep (<= 16 rows).

    precision_first: among precision >= target the best F1, else the best
    precision.  balanced: among precision >= balanced_min the best F1, else
    the best F1.  Ties keep the lowest threshold.
    """
    from pyspark.sql import Window
    p, f1 = F.col("precision"), F.col("f1_score")
    meets = p >= target_precision
    pf = sweep.select("*", F.lit("precision_first").alias("strategy"), meets.cast("int").alias("_m"),
                      F.when(meets, f1).otherwise(p).alias("_s"))
    bmeets = p >= balanced_min
    bal = sweep.select("*", F.lit("balanced").alias("strategy"), bmeets.cast("int").alias("_m"),
                       f1.alias("_s"))
    u = pf.unionByName(bal)
    # a sweep has one row per threshold: the window per strategy is tiny
    w = Window.partitionBy("strategy").orderBy(F.col("_m").desc(), F.col("_s").desc(), F.col("threshold"))
    best = u.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select("strategy", "threshold", "precision", "recall", "f1_score",
                       (F.col("_m") == 1).alias("meets_target"))
