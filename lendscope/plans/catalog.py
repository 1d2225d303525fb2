"""Registered queries: one function (spark, sf_dir) -> DataFrame per operator.

Each reads the driver's tables through ``sources.tables`` and calls the
library operators; ``finish`` rounds doubles to 6 digits so results hash
the same in Spark and in the SQL oracle.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import labels, metrics, monitor
from ..sources import tables as T

QUERIES: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


# ---------------------------------------------------------------- monitoring

@query("monitor_kpis_7d")
def monitor_kpis_7d(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.performance_metrics(T.prediction_log(spark, sf, 7), 7))


@query("monitor_kpis_30d")
def monitor_kpis_30d(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.performance_metrics(T.prediction_log(spark, sf, 30), 30))


@query("label_join")
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    lab = T.prediction_log(spark, sf)
    return finish(lab.select("id", "customer_id", "actual_outcome", "feedback_date", "feedback_id"))


@query("unmatched_feedback")
def unmatched_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return labels.unmatched_feedback(T.scored_log(spark, sf), T.feedback(spark, sf))


@query("roc_auc")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    lab = T.prediction_log(spark, sf).where(F.col("actual_outcome").isNotNull())
    return finish(metrics.roc_auc(lab, "actual_outcome", "probability"))


@query("roc_curve")
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    lab = T.prediction_log(spark, sf).where(F.col("actual_outcome").isNotNull())
    return finish(metrics.roc_curve(lab, "actual_outcome", "probability"))


@query("roc_points")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11 without the points on a straight line."""
    lab = T.prediction_log(spark, sf).where(F.col("actual_outcome").isNotNull())
    return finish(metrics.roc_curve(lab, "actual_outcome", "probability", corners_only=True))


@query("confidence_mix_7d")
def confidence_mix_7d(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.confidence_distribution(T.prediction_log(spark, sf, 7), 7))


@query("lifetime_stats")
def lifetime_stats(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.lifetime_stats(T.prediction_log(spark, sf)))


@query("roi_30d")
def roi_30d(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.roi_metrics(T.prediction_log(spark, sf, 30), 30))


@query("daily_series_30d")
def daily_series_30d(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.daily_series(T.prediction_log(spark, sf, 30), 30))


@query("daily_snapshot")
def daily_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return finish(monitor.daily_snapshot(T.prediction_log(spark, sf)))


# ---------------------------------------------------------------- profiling and features

from ..functions import features as FE  # noqa: E402
from ..operators import prep, profile  # noqa: E402


def typed_loans(spark: SparkSession, sf: str) -> DataFrame:
    return FE.repair_types(T.loans(spark, sf))[0]


def featured_loans(spark: SparkSession, sf: str) -> DataFrame:
    return FE.add_features(typed_loans(spark, sf))


@query("loans_typed")
def loans_typed(spark, sf):
    return finish(typed_loans(spark, sf))


@query("loan_features")
def loan_features(spark, sf):
    return finish(featured_loans(spark, sf).select("ID", *FE.FEATURE_NAMES))


@query("profile_shape")
def profile_shape(spark, sf):
    return profile.shape(typed_loans(spark, sf))


@query("missing_top10")
def missing_top10(spark, sf):
    return finish(profile.missing_profile(typed_loans(spark, sf), 10))


@query("target_balance")
def target_balance(spark, sf):
    return finish(profile.target_balance(typed_loans(spark, sf)))


@query("target_counts")
def target_counts(spark, sf):
    return profile.value_counts(typed_loans(spark, sf), "Default")


@query("duplicate_rows")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(typed_loans(spark, sf))


@query("iqr_outliers_top10")
def iqr_outliers_top10(spark, sf):
    return finish(profile.iqr_outliers(typed_loans(spark, sf), top=10))


@query("consistency_checks")
def consistency_checks(spark, sf):
    return profile.consistency(typed_loans(spark, sf))


@query("target_corr_top10")
def target_corr_top10(spark, sf):
    return finish(profile.target_correlation(featured_loans(spark, sf), top=10))


@query("asset_default_crosstab")
def asset_default_crosstab(spark, sf):
    return finish(profile.crosstab_share(featured_loans(spark, sf)))


@query("hist_age_years")
def hist_age_years(spark, sf):
    return finish(profile.histogram(featured_loans(spark, sf), "Age_Years", 30))


@query("hist_income_positive")
def hist_income_positive(spark, sf):
    return finish(profile.histogram(featured_loans(spark, sf), "Client_Income", 50, positive_only=True))


# ---------------------------------------------------------------- preparation

def ml_with_id(spark, sf):
    """The encoded table with ids, written once: split, scaler, scores and fits read it."""
    return written(prep.ml_table(featured_loans(spark, sf), keep_id=True), "ml-table")


def split_ml(spark, sf):
    return prep.stratified_split(ml_with_id(spark, sf))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("ID", "Default", "is_test")]


@query("ml_table")
def ml_table(spark, sf):
    return finish(prep.ml_table(featured_loans(spark, sf)))


@query("median_fill_values")
def median_fill_values(spark, sf):
    f = featured_loans(spark, sf)
    return finish(prep.median_fill_values(f, profile.numeric_columns(f, exclude=())))


@query("mode_fill_values")
def mode_fill_values(spark, sf):
    f = featured_loans(spark, sf)
    return prep.mode_fill_values(f, profile.text_columns(f))


@query("label_codes")
def label_codes(spark, sf):
    filled, kinds = prep.fill_missing(featured_loans(spark, sf))
    return prep.label_codes(filled, kinds["categorical"])


@query("stratified_split")
def stratified_split(spark, sf):
    return prep.stratified_split(T.loans(spark, sf).select("ID", "Default"))


@query("scaler_stats")
def scaler_stats(spark, sf):
    s = split_ml(spark, sf)
    return finish(prep.scaler_stats(s.where(~F.col("is_test")), feature_columns(s)))


@query("anova_f_top20")
def anova_f_top20(spark, sf):
    s = split_ml(spark, sf)
    return finish(prep.anova_f(s.where(~F.col("is_test")), feature_columns(s), k=20))


@query("undersample_train")
def undersample_train(spark, sf):
    s = prep.stratified_split(T.loans(spark, sf).select("ID", "Default")).where(~F.col("is_test"))
    return prep.undersample(s.select("ID", "Default"))


@query("class_weights")
def class_weights(spark, sf):
    s = prep.stratified_split(T.loans(spark, sf).select("ID", "Default")).where(~F.col("is_test"))
    return finish(prep.class_weights(s))


# ---------------------------------------------------------------- evaluation on the labelled log

def labelled(spark, sf):
    return T.prediction_log(spark, sf).where(F.col("actual_outcome").isNotNull())


@query("classification_metrics")
def classification_metrics(spark, sf):
    return finish(metrics.classification_metrics(labelled(spark, sf), "actual_outcome", "prediction"))


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(labelled(spark, sf), "actual_outcome", "prediction")


@query("classification_report")
def classification_report(spark, sf):
    return finish(metrics.classification_report(labelled(spark, sf), "actual_outcome", "prediction"))


@query("threshold_sweep")
def threshold_sweep(spark, sf):
    s = metrics.threshold_sweep(labelled(spark, sf), "actual_outcome", "probability")
    return finish(s.withColumn("business_score", metrics.business_score()))


@query("threshold_choice")
def threshold_choice(spark, sf):
    s = metrics.threshold_sweep(labelled(spark, sf), "actual_outcome", "probability")
    return finish(metrics.choose_thresholds(s))


# ---------------------------------------------------------------- drift, alerts, health

from ..operators import alerts as AL  # noqa: E402
from ..operators import score_store as SS  # noqa: E402
from ..sources import committed as CO  # noqa: E402
from ..session import shared_dir, written  # noqa: E402


# The longest look-back of a monitoring cycle (ROI, volume history, drift baseline).
CYCLE_DAYS = 30


def cycle_log(spark, sf, log=T.prediction_log):
    """The labelled log of one monitoring cycle, written once to the shared
    folder: every metric of the cycle then scans that table instead of
    repeating the as-of join."""
    return written(log(spark, sf, CYCLE_DAYS), "cycle-log")


def days_before(n: int):
    """The day ``n`` days before the fixtures' clock, which is a midnight: windows are whole days."""
    return F.date_sub(F.to_date(T.as_of_lit()), n)


def monitoring_frames(spark, sf, source=T.prediction_log):
    """The cycle's frames; KPIs and drift are sums over one table of score counts per day."""
    log = cycle_log(spark, sf, source)
    counts = written(SS.day_counts(log), "cycle-counts")
    week = F.col("date") >= days_before(7)
    k7 = written(SS.window_kpis(counts.where(week), 7), "cycle-kpis")
    drift = written(AL.drift_of_counts(SS.sample_counts(counts, week)), "cycle-drift")
    al = AL.generate_alerts(k7, AL.history_total(log)).unionByName(AL.drift_alerts(drift))
    roi = written(monitor.roi_metrics(log, 30), "cycle-roi")
    return log, k7, drift, written(al, "cycle-alerts"), roi


@query("monitor_kpis_7d_counts")
def monitor_kpis_7d_counts(spark, sf):
    """MON-1 / AGG-13..16 from the stored score counts."""
    counts = written(SS.day_counts(T.prediction_log(spark, sf, 7)), "week-counts")
    return finish(SS.window_kpis(counts.where(F.col("date") >= days_before(7)), 7))


@query("daily_snapshot_batches")
def daily_snapshot_batches(spark, sf):
    """SNK-6 / STR-2 / JOIN-1: the stored daily metrics after predictions and feedback came in four unaligned batches."""
    log, fb = T.scored_log(spark, sf), T.feedback(spark, sf)
    store = SS.MetricStore(spark, shared_dir(spark, "metric-store"))
    for b in range(4):
        store.ingest(log.where(F.pmod(F.xxhash64("id"), F.lit(4)) == b), fb.where(F.pmod(F.xxhash64("feedback_id"), F.lit(4)) == 3 - b), b)
    return finish(store.daily(), 9).withColumns({c: F.round(c, 6) for c in ("precision_score", "recall_score", "f1_score", "approval_rate")})


@query("committed_log_7d")
def committed_log_7d(spark, sf):
    """SNK-2 / SRC-3: the log in three batches, one of them written twice and a fourth never committed; a week of it."""
    log = written(T.scored_log(spark, sf).withColumn("date", F.to_date("timestamp")), "log-rows")
    path = shared_dir(spark, "committed-log")
    for b in (0, 1, 2, 1):
        CO.commit_batch(log.where(F.col("id") % 3 == b), path, b)
    CO.stage_batch(log, path, 3)
    schema = "id long, customer_id string, timestamp timestamp_ntz, probability double"
    week = CO.read_committed(spark, path, schema, days_before(7)).where(F.col("timestamp") >= T.as_of_lit() - F.make_dt_interval(days=F.lit(7)))
    return week.groupBy("date", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("drift_shifted")
def drift_shifted(spark, sf):
    return finish(AL.detect_drift(T.shifted_log(spark, sf, 30)))


@query("alerts_shifted")
def alerts_shifted(spark, sf):
    return finish(monitoring_frames(spark, sf, T.shifted_log)[3])


@query("health_check_shifted")
def health_check_shifted(spark, sf):
    _, k7, drift, al, roi = monitoring_frames(spark, sf, T.shifted_log)
    return AL.health_status(k7, al, drift, roi)


@query("model_status_shifted")
def model_status_shifted(spark, sf):
    log = cycle_log(spark, sf, T.shifted_log)
    return finish(AL.model_status(written(monitor.performance_metrics(log, 7), "cycle-kpis"), AL.detect_drift(log)))


@query("drift_7d_vs_30d")
def drift_7d_vs_30d(spark, sf):
    return finish(AL.detect_drift(T.prediction_log(spark, sf, 30)))


@query("alerts_7d")
def alerts_7d(spark, sf):
    _, _, _, al, _ = monitoring_frames(spark, sf)
    return finish(al)


@query("health_check")
def health_check(spark, sf):
    _, k7, drift, al, roi = monitoring_frames(spark, sf)
    return AL.health_status(k7, al, drift, roi)


@query("model_status")
def model_status(spark, sf):
    log = cycle_log(spark, sf)
    return finish(AL.model_status(written(monitor.performance_metrics(log, 7), "cycle-kpis"), AL.detect_drift(log)))


@query("alert_cooldown")
def alert_cooldown(spark, sf):
    from ..operators.cooldown import cooldown
    return cooldown(T.alert_events(spark, sf)).select("alert_id", "type", "sent")


# ---------------------------------------------------------------- reports

from ..operators import report as RP  # noqa: E402


@query("executive_summary_30d")
def executive_summary_30d(spark, sf):
    return finish(RP.executive_summary(monitor.roi_metrics(T.prediction_log(spark, sf, 30), 30)))


@query("daily_report")
def daily_report(spark, sf):
    log = cycle_log(spark, sf)
    return finish(RP.daily_report(monitor.performance_metrics(log, 1), monitor.roi_metrics(log, 1),
                                  AL.detect_drift(log)))


@query("dashboard_7d")
def dashboard_7d(spark, sf):
    return finish(RP.dashboard_data(monitor.performance_metrics(T.prediction_log(spark, sf, 7), 7), 7))


@query("monitoring_summary")
def monitoring_summary(spark, sf):
    _, k7, drift, al, roi = monitoring_frames(spark, sf)
    return finish(RP.monitoring_summary(AL.health_status(k7, al, drift, roi), k7, roi))


@query("alert_history")
def alert_history(spark, sf):
    from ..operators.cooldown import cooldown
    sent = cooldown(T.alert_events(spark, sf)).where(F.col("sent")).drop("sent")
    return RP.alert_history(sent)


# ---------------------------------------------------------------- validation and scoring

from ..operators import logistic as LO  # noqa: E402
from ..operators import scoring as SC  # noqa: E402
from ..operators import validate as V  # noqa: E402

# Fixed value: the tuned decision threshold of the optimised model.
TUNED_THRESHOLD = 0.6500000000000001


def validated_applications(spark, sf, stored: bool = False):
    """``stored``: the applications are written, so the rules test columns, not the expressions that made them."""
    a = T.applications(spark, sf)
    a = a.withColumn("customer_id", V.default_customer_id(F.col("customer_id"), F.col("received_at")))
    return V.validate(written(a, "applications") if stored else a, V.APPLICATION_RULES)


@query("application_validation")
def application_validation(spark, sf):
    v = validated_applications(spark, sf)
    return v.select("ID", "customer_id", "is_valid", F.size("errors").alias("n_errors"),
                    F.array_join("errors", "; ").alias("errors"))


@query("aligned_applications")
def aligned_applications(spark, sf):
    feats = [c for c in featured_loans(spark, sf).columns if c not in ("ID", "Default")]
    ok = validated_applications(spark, sf).where("is_valid")
    return finish(SC.align_features(ok.select("ID", *V.SELECTED_FEATURES), feats, keep=["ID"]))


@query("score_decisions")
def score_decisions(spark, sf):
    p = T.raw_predictions(spark, sf).select("id", "customer_id", "probability")
    d = SC.apply_decisions(p, TUNED_THRESHOLD)
    v = V.validate(d, V.PREDICTION_RULES)
    return finish(v.select("id", "probability", "prediction", "decision", "confidence_level", "is_valid"))


@query("feedback_validation")
def feedback_validation(spark, sf):
    v = V.validate(T.feedback(spark, sf), V.FEEDBACK_RULES)
    return v.select("feedback_id", "is_valid", F.size("errors").alias("n_errors"))


@query("feedback_breaches")
def feedback_breaches(spark, sf):
    """PRJ-9 on feedback of which some has no customer, an unknown outcome or none."""
    k = F.col("feedback_id")
    f = T.feedback(spark, sf).withColumns({
        "customer_id": F.when(k % 7 != 0, F.col("customer_id")),
        "actual_outcome": F.when(k % 5 == 0, F.lit(2)).when(k % 11 != 0, F.col("actual_outcome"))})
    return V.validate(f, V.FEEDBACK_RULES).select("feedback_id", "is_valid", F.size("errors").alias("n_errors"))


@query("prediction_breaches")
def prediction_breaches(spark, sf):
    """PRJ-10 on predictions of which some have a score outside [0, 1], no score, no customer or an unknown decision."""
    k = F.col("id")
    p = T.raw_predictions(spark, sf).select("id", F.when(k % 7 != 0, F.col("customer_id")).alias("customer_id"),
                                            F.when(k % 9 == 0, -F.col("probability") - 0.5).when(k % 10 == 0, F.col("probability") + 1.5)
                                            .when(k % 11 != 0, F.col("probability")).alias("probability"))
    d = SC.apply_decisions(p, TUNED_THRESHOLD).withColumn("decision", F.when(k % 13 == 0, F.lit("HOLD")).otherwise(F.col("decision")))
    return V.validate(d, V.PREDICTION_RULES).select("id", "is_valid", F.size("errors").alias("n_errors"))


@query("health_check_silent")
def health_check_silent(spark, sf):
    """MON-10: the status sixty days after the last prediction, when the look-back is empty."""
    later = T.as_of_lit() + F.make_dt_interval(days=F.lit(60))
    log = written(T.prediction_log(spark, sf), "silent-log")
    k7 = written(monitor.performance_metrics(log, 7, later), "silent-kpis")
    drift = AL.detect_drift(log, as_of=later)
    al = AL.generate_alerts(k7, AL.history_total(log, later)).unionByName(AL.drift_alerts(drift))
    return AL.health_status(k7, al, drift, monitor.roi_metrics(log, 30, later))


@query("features_json_roundtrip")
def features_json_roundtrip(spark, sf):
    from ..sources.files import decode_features, encode_features
    ok = validated_applications(spark, sf).where("is_valid")
    enc = encode_features(ok, V.SELECTED_FEATURES)
    schema = ok.select(*V.SELECTED_FEATURES).schema
    return finish(decode_features(enc.select("ID", "features"), schema).select("ID", *V.SELECTED_FEATURES))


# ---------------------------------------------------------------- oversampling

from ..operators import sampling as SM  # noqa: E402

# The oversampling setting of the training run.
SMOTE_RATIO = 3.0
SMOTE_K = 3


@query("knn_minority_embeddings")
def knn_minority_embeddings(spark, sf):
    e = T.table(spark, sf, "embeddings").where(F.col("label") == 0)
    return finish(SM.knn_within(e, "vec_id", "embedding", SMOTE_K))


@query("smote_embeddings")
def smote_embeddings(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") != 0).cast("int").alias("y"))
    n_major = e.where(F.col("y") == 1).count()
    s = SM.smote(e, "vec_id", "embedding", "y", 0, SM.smote_target(n_major, SMOTE_RATIO), SMOTE_K)
    return finish(s.select("syn_id", F.posexplode("vec").alias("dim", "value")))


# ---------------------------------------------------------------- training (rows-only checks)

from ..operators import logistic as LO  # noqa: E402
from ..operators import scoring as SC  # noqa: E402
from ..operators import trees as trees_  # noqa: E402
from . import training as TR  # noqa: E402


def prepared(spark, sf):
    return TR.prepare(ml_with_id(spark, sf))


@query("model_comparison")
def model_comparison(spark, sf):
    p = prepared(spark, sf)
    cfg = TR.DEFAULT_CONFIG
    res, _ = TR.train_and_compare(p, cfg, TR.balance(p.train, p.features, "smote", cfg["smote_ratio"]))
    return res


@query("sampling_comparison")
def sampling_comparison(spark, sf):
    return TR.sampling_comparison(prepared(spark, sf))


@query("score_applications")
def score_applications(spark, sf):
    """SNK-5 / SRC-6 / SCO-1: fit, save the package, load it, score raw applications."""
    # evaluated once: the ML table and the package's statistics read it
    source = written(featured_loans(spark, sf), "features")
    p = TR.prepare(prep.ml_table(source, keep_id=True, stored=True))
    model = TR.logistic_of_all(p.train, p.features, "moderate")
    path = shared_dir(spark, "package")
    TR.save_model(TR.package(source, p.features, model, p.train.select("ID")), p.features, path, threshold=None)
    pm, features, threshold = TR.load_model(path)
    apps = validated_applications(spark, sf, stored=True).where("is_valid")
    # what the package reads, written: its expressions are not put on top of those of the applications
    apps = written(apps.select("ID", *[c for c in features if c in apps.columns]), "valid-applications")
    return finish(SC.score(pm, TR.raw_rows(apps, features, source), threshold).select("ID", "probability", "prediction", "decision", "confidence_level"))


def _train_rows(spark, sf):
    s = split_ml(spark, sf)
    return written(s.where(~F.col("is_test")).drop("is_test"), "train-rows"), feature_columns(s)


def _boosted_rows(spark, sf, rounds: int, depth: int):
    """ML-4: the nodes of boosted trees over the unscaled training rows."""
    train, feats = _train_rows(spark, sf)
    table, edges = TR.tree_table(train, feats)
    p = replace(TR.boost_params("moderate"), rounds=rounds, depth=depth)
    trees, = trees_.grow_boosted(table, [-1], len(feats), p)
    values = [[trees_.leaf_weight(x, p) for x in t.stats] for t in trees]
    return finish(spark.createDataFrame(trees_.tree_rows(trees, edges, feats, values), trees_.TREE_SCHEMA))


@query("boosted_stumps")
def boosted_stumps(spark, sf):
    return _boosted_rows(spark, sf, 3, 1)


@query("boosted_trees")
def boosted_trees(spark, sf):
    return _boosted_rows(spark, sf, 2, 2)


@query("forest_tree")
def forest_tree(spark, sf):
    """ML-3: one balanced tree over all rows and features, leaf >= 10, split >= 20."""
    train, feats = _train_rows(spark, sf)
    table, edges = TR.tree_table(train, feats)
    w = trees_.balanced_weights(trees_.training_counts(trees_.fold_counts(table), -1))
    spec = trees_.TreeSpec("one", 0, 2, bootstrap=False, min_leaf=TR.MIN_LEAF, min_split=TR.MIN_SPLIT, weights=w)
    trees = trees_.grow_forest(table, [spec], len(feats))
    return finish(spark.createDataFrame(trees_.tree_rows(trees, edges, feats, [trees_.class_shares(t, w) for t in trees]), trees_.TREE_SCHEMA))


@query("logistic_steps")
def logistic_steps(spark, sf):
    """ML-2: three Newton steps of a balanced model of two columns, C 0.1."""
    train, _ = _train_rows(spark, sf)
    rows = train.select("Default", F.lit(0).alias("fold"), (F.col("Age_Years") / 10).alias("age"), F.col("Score_Source_2").alias("score"))
    w = trees_.balanced_weights(trees_.training_counts(trees_.fold_counts(rows.select("fold", F.col("Default").alias("y"))), -1))
    beta, = LO.newton(rows, ["age", "score"], "Default", [-1], [w], 0.1, steps=3)
    return finish(spark.createDataFrame([(n, float(b)) for n, b in zip(("constant", "age", "score"), beta)], "name string, coefficient double"))


@query("hyperparameter_scores")
def hyperparameter_scores(spark, sf):
    """ML-18: 20 of 72 grid points, three folds; the business score of each."""
    return TR.search_scores(prepared(spark, sf))


OPT_THRESHOLDS = {"base": 0.5, "tuned": 0.65, "No Sampling": 0.3, "Conservative SMOTE (4:1)": 0.45, "SMOTE (2:1)": 0.6,
                  "Random Undersampling": 0.75, "search": 0.7}


@query("tuning_report")
def tuning_report(spark, sf):
    """ML-20 / ML-21 / ML-17's choice: every configuration is the labelled log's score at a cutoff of its own."""
    lab = T.prediction_log(spark, sf).where(F.col("actual_outcome").isNotNull())
    sweep = metrics.threshold_sweep(lab, "actual_outcome", "probability", list(OPT_THRESHOLDS.values()))
    # one row per configuration
    at = {round(r["threshold"], 6): r for r in sweep.collect()}
    row = {n: {"precision": at[t]["precision"], "recall": at[t]["recall"], "f1": at[t]["f1_score"]} for n, t in OPT_THRESHOLDS.items()}
    tried = spark.createDataFrame([(i, n, *row[n].values()) for i, (n, _, _) in enumerate(TR.SAMPLING_STRATEGIES)],
                                  "_i int, strategy string, precision double, recall double, f1_score double")
    sampling = tried.withColumn("rank", F.row_number().over(Window.orderBy(F.col("precision").desc(), "_i")))
    hyper = spark.createDataFrame([tuple(row["search"].values())], "test_precision double, test_recall double, test_f1 double")
    return finish(TR.optimisation_report(row["base"], row["tuned"], sampling, hyper))


@query("processed_summary")
def processed_summary(spark, sf):
    """SRC-2: the written ML table read back, with its class counts."""
    path = shared_dir(spark, "processed")
    prep.ml_table(featured_loans(spark, sf)).write.parquet(path)
    return finish(FI.processed_summary(FI.read_processed(spark, path)))


@query("rank_models")
def rank_models(spark, sf):
    """ML-8 / ML-9 / SORT-2 on a metrics table made from the labelled loans: one "model" per education level."""
    d = T.loans(spark, sf)
    g = d.groupBy(F.col("Client_Education").alias("Model")).agg(
        F.avg("Default").alias("Test_Precision"), F.avg("House_Own").alias("Test_ROC_AUC"),
        F.avg("Bike_Owned").alias("Test_F1"), (F.avg("Car_Owned") - F.avg("House_Own")).alias("Overfitting_Gap"))
    return finish(TR.rank_models(g.where(F.col("Model").isNotNull())))


@query("anova_f_edges")
def anova_f_edges(spark, sf):
    """PREP-6 on columns with large means, perfect separation and no variance."""
    d = T.loans(spark, sf).select(
        "Default", (F.col("ID") % 7 + 100_000_000).cast("double").alias("large_mean"), (F.col("ID") % 7).cast("double").alias("small_mean"),
        (F.col("Default") * 3.0).alias("separator"), F.lit(5.0).alias("constant"))
    return finish(prep.anova_f(d, ["large_mean", "small_mean", "separator", "constant"], k=2))


@query("label_join_null_keys")
def label_join_null_keys(spark, sf):
    """JOIN-1 where every fifth customer is unknown on both sides."""
    from ..operators.labels import attach_outcomes
    known = F.when(F.substring_index("customer_id", "_", -1).cast("long") % 5 != 0, F.col("customer_id"))
    log = T.scored_log(spark, sf).withColumn("customer_id", known)
    fb = T.feedback(spark, sf).withColumn("customer_id", known)
    return attach_outcomes(log, fb).select("id", "customer_id", "actual_outcome", "feedback_date", "feedback_id")


@query("duplicate_rows_coarse")
def duplicate_rows_coarse(spark, sf):
    """AGG-4 on columns that do repeat."""
    return finish(profile.duplicate_rows(T.loans(spark, sf).select("Default", "Bike_Owned", "Child_Count", "Client_Income_Type")))


# ---------------------------------------------------------------- streaming

from ..streaming import jobs as ST  # noqa: E402


REPLAY_BATCHES, REPLAY_FILES = 4, 2
REPLAY_DELAY = "60 days"  # the unaligned replays mix all days of the fixtures, which span a month


def _replay(spark, df: DataFrame, name: str, key: str, time: str | None = None):
    """Write a derived table in slices and return a file stream that takes one slice a micro-batch.

    Slices mix all times by a hash of ``key``, or follow each other in ``time``.
    """
    src, df = shared_dir(spark, f"{name}-src"), written(df, f"{name}-rows")
    part = F.pmod(F.xxhash64(key), F.lit(REPLAY_BATCHES))
    if time:
        lo, hi = df.agg(F.min(F.unix_date(F.to_date(time))), F.max(F.unix_date(F.to_date(time)))).first()  # one row
        part = F.floor((F.unix_date(F.to_date(time)) - F.lit(lo or 0)) * REPLAY_BATCHES / ((hi or 0) - (lo or 0) + 1))
    for b in range(REPLAY_BATCHES):  # the source takes files in the order of their writing
        df.where(part == b).repartition(REPLAY_FILES).write.mode("append").parquet(src)
    return ST.file_stream(spark, src, spark.read.parquet(src).schema, REPLAY_FILES)


def _daily_days(spark, sf):
    s = _replay(spark, T.scored_log(spark, sf), "scored-log", "id")
    out, ck = shared_dir(spark, "daily-kpis"), shared_dir(spark, "daily-kpis-ck")
    ST.run_daily_kpis(s, out, ck, REPLAY_DELAY)
    return ST.latest_days(spark, out)


@query("stream_daily_kpis")
def stream_daily_kpis(spark, sf):
    return finish(ST.finish_daily(_daily_days(spark, sf)))


@query("stream_sliding_7d_kpis")
def stream_sliding_7d_kpis(spark, sf):
    """STR-3 on what the daily stream wrote."""
    return finish(ST.sliding_kpis(_daily_days(spark, sf)))


@query("stream_labels")
def stream_labels(spark, sf):
    """STR-5: outcomes attached by the stream, one row per labelled prediction."""
    p = _replay(spark, T.scored_log(spark, sf).select("id", "customer_id", "timestamp"), "predictions", "id")
    f = _replay(spark, T.feedback(spark, sf), "feedback", "feedback_id", "feedback_ts")
    out, ck = shared_dir(spark, "labels"), shared_dir(spark, "labels-ck")
    ST.run_to_table(ST.label_stream(p, f, REPLAY_DELAY), out, ck)
    return spark.read.parquet(out).select("id", "actual_outcome", "feedback_id")


@query("sliding_7d_kpis")
def sliding_7d_kpis(spark, sf):
    return finish(ST.sliding_kpis(ST.daily_partials(T.scored_log(spark, sf))))


@query("stream_alert_cooldown")
def stream_alert_cooldown(spark, sf):
    s = _replay(spark, T.alert_events(spark, sf), "alerts", "alert_id", "timestamp")
    out, ck = shared_dir(spark, "cooldown"), shared_dir(spark, "cooldown-ck")
    ST.run_to_table(ST.cooldown_stream(s), out, ck)
    return spark.read.parquet(out).select("alert_id", "type", "sent")


# ---------------------------------------------------------------- file sources and sinks

from ..sources import files as FI  # noqa: E402


@query("loans_csv_roundtrip")
def loans_csv_roundtrip(spark, sf):
    """SNK-1 / SRC-1: loans written as CSV with pandas-style NA text, read back typed."""
    raw = T.loans(spark, sf)
    path = shared_dir(spark, "loans-csv")
    # missing values written as 'NA' text, the way many exports do
    raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in raw.columns]) \
        .write.option("header", True).csv(path)
    back = FI.type_like(FI.read_loans_csv(spark, path, raw.columns), raw, ["Client_Income"])
    return finish(FE.repair_types(back)[0])


@query("alert_log_roundtrip")
def alert_log_roundtrip(spark, sf):
    """SNK-4 / SRC-5: alerts appended as JSON lines, read back with a fixed schema."""
    _, _, _, al, _ = monitoring_frames(spark, sf)
    path = shared_dir(spark, "alert-log")
    FI.write_alerts(al.withColumn("timestamp", F.lit(T.AS_OF)), path, F.lit(T.AS_OF))
    return finish(FI.read_alerts(spark, path).select(*AL.ALERT_FIELDS))
