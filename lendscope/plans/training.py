"""Training, comparison and optimisation of default classifiers (ML-1..21).

Driver-side code only composes DataFrame operators and ``pyspark.ml``
estimators; every fit and every metric runs distributed.  What reaches the
driver is bounded by the number of columns or candidates: the selected
feature names, fitted class counts and one metric row per model.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..operators import logistic as LO
from ..operators import metrics as M
from ..operators import prep
from ..operators import trees as TR
from ..operators.profile import ID, TARGET
from ..operators.ranking import rank_in_class
from ..operators.sampling import knn_within, smote, smote_target
from ..session import written

# Regularisation presets, model settings and scoring weights.
PRESETS = {
    "light": {"C": 1.0, "max_depth": 10, "n_estimators": 100},
    "moderate": {"C": 0.1, "max_depth": 8, "n_estimators": 50},
    "heavy": {"C": 0.01, "max_depth": 6, "n_estimators": 30},
}
DEFAULT_CONFIG = {"test_size": 0.2, "random_state": 42, "n_features": 20, "cv_folds": 3, "smote_ratio": 3.0,
                  "regularization": "moderate"}
MIN_LEAF = 10
MIN_SPLIT = 20
BOOST_RATE, BOOST_POS_WEIGHT, BOOST_L1, BOOST_L2 = 0.05, 3.0, 0.1, 1.0
FIXED_CLASS_WEIGHT = {0: 1.0, 1: 3.0}
COMPOSITE = {"auc": 0.4, "f1": 0.3, "precision": 0.2, "gap": -0.1}
GAP_GREEN, GAP_AMBER = 0.05, 0.15
SAMPLING_STRATEGIES = [("No Sampling", None, None), ("Conservative SMOTE (4:1)", "smote", 4.0),
                       ("SMOTE (2:1)", "smote", 2.0), ("Random Undersampling", "undersample", 0.3)]
SAMPLING_TREES, SAMPLING_DEPTH = 30, 8
SEARCH_GRID = {"n_estimators": [30, 50, 100], "max_depth": [6, 8, 10], "min_samples_split": [10, 20],
               "min_samples_leaf": [5, 10], "class_weight": ["balanced", "fixed_1_3"]}
SEARCH_ITER = 20
MODEL_VERSION = "1.0.0"


@dataclass
class Prepared:
    train: DataFrame          # ID, selected features (scaled), Default
    test: DataFrame
    features: list[str]
    f_scores: DataFrame = field(default=None)


def prepare(ml: DataFrame, config: dict = DEFAULT_CONFIG) -> Prepared:
    """PREP-4..6: split, standardise (fit on train), keep the top-k ANOVA features."""
    feats = [c for c in ml.columns if c not in (ID, TARGET)]
    # The split is evaluated once and written; scaler, scores and rows read that.
    s = written(prep.stratified_split(ml, test_size=config["test_size"], seed=config["random_state"]), "split")
    train, test = s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")
    stats = written(prep.scaler_stats(train, feats, stored=True), "scaler")
    train, test = prep.standardize(train, stats, feats), prep.standardize(test, stats, feats)
    f = written(prep.anova_f(train, feats, k=config["n_features"], stored=True), "f-scores")
    # one name per column: a bounded collect
    selected = [r["column"] for r in f.where("selected").orderBy("rank").select("column").collect()]
    keep = [ID, *selected, TARGET]
    # Model fitting passes over the rows many times: written once into the shared folder.
    return Prepared(written(train.select(*keep), "train"), written(test.select(*keep), "test"), selected, f)


def with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


SMOTE_K = 3


def searched_once() -> Callable[[DataFrame], DataFrame]:
    """A neighbour search for strategies that oversample the same rows: the first call searches and writes, the others read."""
    found: list[DataFrame] = []

    def neighbours(minority: DataFrame) -> DataFrame:
        if not found:
            found.append(written(knn_within(minority, "id", "vec", SMOTE_K), "neighbours"))
        return found[0]

    return neighbours


def balance(train: DataFrame, features: list[str], method: str | None, ratio: float | None,
            seed: int = 42, neighbours: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """PREP-7..9 (UDF-3 dispatch): SMOTE the defaults up to int(n0 / ratio), or
    undersample the non-defaults to int(n1 / ratio); no change when SMOTE's
    target is below the current default count.  Rows that changed are written."""
    if method is None:
        return train
    if method == "undersample":
        return written(prep.undersample(train, ratio=ratio, seed=seed), "balanced-train")
    if method != "smote":
        raise ValueError(f"unknown sampling method {method!r}")
    counts = {r[TARGET]: r["n"] for r in train.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    target = smote_target(counts.get(0, 0), ratio)
    if target <= counts.get(1, 0):
        return train
    v = train.select(ID, F.array(*[F.col(c) for c in features]).alias("vec"), TARGET)
    syn = smote(v, ID, "vec", TARGET, 1, target, SMOTE_K, seed, neighbours)
    syn = syn.select((-1 - F.col("syn_id")).alias(ID),
                     *[F.col("vec")[i].alias(c) for i, c in enumerate(features)], F.col("label").alias(TARGET))
    # every fold and fit reads these rows: the neighbour search runs once
    return written(train.unionByName(syn), "balanced-train")


def logistic(rows: DataFrame, features: list[str], preset: str, outs: list[int]) -> list[LO.LogisticModel]:
    """ML-2: L2 with C of the preset and balanced classes (PREP-10); one model per left-out fold (-1: none)."""
    folds_ = TR.fold_counts(rows.select("fold", F.col(TARGET).alias("y")))
    weights = [TR.balanced_weights(TR.training_counts(folds_, o)) for o in outs]
    return [LO.LogisticModel.of(b) for b in LO.newton(rows, features, TARGET, outs, weights, PRESETS[preset]["C"])]


def logistic_of_all(rows: DataFrame, features: list[str], preset: str) -> LO.LogisticModel:
    """``logistic`` of all rows."""
    return logistic(rows.withColumn("fold", F.lit(0)), features, preset, [-1])[0]


def boost_params(preset: str) -> TR.BoostParams:
    """ML-4: trees and depth (less 2) of the preset, learning rate, L1, L2 and positive weight."""
    p = PRESETS[preset]
    return TR.BoostParams(p["n_estimators"], p["max_depth"] - 2, BOOST_RATE, BOOST_L1, BOOST_L2, BOOST_POS_WEIGHT)


def tree_table(rows: DataFrame, features: list[str], fold: str | None = None) -> tuple[DataFrame, list[list[float]]]:
    """The rows as bins of their features' exact quantiles, and the edges of the bins."""
    edges = TR.bin_edges(rows, features)
    return TR.binned(rows, features, edges, TARGET, ID, fold), edges


def widths(edges: list[list[float]]) -> list[int]:
    """Bins of each feature."""
    return [len(e) + 1 for e in edges]


def balanced_forest(table: DataFrame, edges: list[list[float]], outs: list[int], n_trees: int, depth: int, min_leaf: int, min_split: int,
                    seed: int) -> list[TR.TreesModel]:
    """ML-3: one balanced forest per left-out fold (-1: none), all trees grown in the same scans."""
    folds_ = TR.fold_counts(table)
    weights = [TR.balanced_weights(TR.training_counts(folds_, o)) for o in outs]
    specs = [t for o, w in zip(outs, weights, strict=True)
             for t in TR.forest_specs(f"without {o}", n_trees, depth, len(edges), o, w, min_leaf, min_split, seed)]
    grown = TR.grow_forest(table, specs, len(edges), widths=widths(edges))
    return [TR.forest_model(grown[i * n_trees:(i + 1) * n_trees], w, edges) for i, w in enumerate(weights)]


def boosted(table: DataFrame, edges: list[list[float]], outs: list[int], p: TR.BoostParams) -> list[TR.TreesModel]:
    """ML-4: one boosted model per left-out fold (-1: none)."""
    return [TR.boosted_model(t, p, edges) for t in TR.grow_boosted(table, outs, len(edges), p, widths=widths(edges))]


def p1(df: DataFrame) -> DataFrame:
    return df.withColumn("p1", vector_to_array("probability")[1])


def test_metrics(model, test: DataFrame) -> dict:
    """ML-6 / ML-7 on the test rows: one metric row, returned as a dict."""
    pred = p1(model.transform(test))
    c = M.classification_metrics(pred, TARGET, "prediction")
    a = M.roc_auc(pred, TARGET, "p1")
    row = c.crossJoin(a).first()
    return {"accuracy": row["accuracy"], "precision": row["precision"], "recall": row["recall"],
            "f1": row["f1_score"], "auc": row["auc"] if row["auc"] is not None else row["accuracy"]}


def folds(train: DataFrame, k: int, seed: int) -> DataFrame:
    """Stratified folds: rank by md5 within class, modulo k."""
    r = rank_in_class(train, TARGET, ID, seed, rank_col="_fold_rank")
    return r.withColumn("fold", ((F.col("_fold_rank") - 1) % k).cast("int")).drop("_fold_rank")


def folded(train: DataFrame, features: list[str], k: int, seed: int) -> DataFrame:
    """Rows with fold number and feature vector, kept in executor memory while models are fitted."""
    f = spread(written(folds(train, k, seed), "folds"))
    return with_vector(f, features).select(TARGET, "fold", "features").persist()


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: small tables are written as few files, and fits pass over them many times."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def auc_of(model, rows: DataFrame) -> float:
    a = M.roc_auc(p1(model.transform(rows)), TARGET, "p1").first()["auc"]
    return a if a is not None else 0.0


def fitted_models(rows: DataFrame, features: list[str], config: dict) -> dict[str, list]:
    """ML-1..4: of each kind the models without fold 0, 1, ... and the one of all rows, last.

    ``rows`` are the written rows with their ``fold``.  The trees of all folds
    grow together; bins are those of all rows.
    """
    k, seed, preset = config["cv_folds"], config["random_state"], PRESETS[config["regularization"]]
    outs = [*range(k), -1]
    lr = logistic(rows, features, config["regularization"], outs)
    table, edges = tree_table(rows, features, "fold")
    table = spread(table).persist()
    rf = balanced_forest(table, edges, outs, preset["n_estimators"], preset["max_depth"], MIN_LEAF, MIN_SPLIT, seed)
    gb = boosted(table, edges, outs, boost_params(config["regularization"]))
    table.unpersist()
    return {"Logistic Regression": lr, "Random Forest": rf, "Gradient Boosting": gb}


def train_and_compare(prepared: Prepared, config: dict = DEFAULT_CONFIG, resampled: DataFrame | None = None):
    """ML-5..9: CV on the (resampled) training rows, refit, test metrics, composite rank.

    Returns (results DataFrame, {model name: fitted model}).
    """
    spark = prepared.train.sparkSession
    tr = resampled if resampled is not None else prepared.train
    rows_ = spread(written(folds(tr, config["cv_folds"], config["random_state"]), "folds"))
    f = with_vector(rows_, prepared.features).select(TARGET, "fold", "features").persist()
    test = with_vector(prepared.test, prepared.features).select(TARGET, "features").persist()
    rows, fitted = [], {}
    for name, models in fitted_models(rows_, prepared.features, config).items():
        scores = [auc_of(m, f.where(F.col("fold") == i)) for i, m in enumerate(models[:-1])]
        fitted[name] = models[-1]
        m = test_metrics(models[-1], test)
        mean = sum(scores) / len(scores)
        std = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
        rows.append((name, mean, std, m["auc"], mean - m["auc"], m["precision"], m["recall"], m["f1"],
                     m["accuracy"]))
    f.unpersist()
    test.unpersist()
    res = spark.createDataFrame(rows, "Model string, CV_ROC_AUC double, CV_STD double, Test_ROC_AUC double, "
                                      "Overfitting_Gap double, Test_Precision double, Test_Recall double, "
                                      "Test_F1 double, Test_Accuracy double")
    return rank_models(res), fitted


def rank_models(res: DataFrame) -> DataFrame:
    """ML-8 / ML-9: gap status, composite score, rank (best first, ties by name)."""
    g = F.col("Overfitting_Gap")
    comp = (COMPOSITE["auc"] * F.col("Test_ROC_AUC") + COMPOSITE["f1"] * F.col("Test_F1")
            + COMPOSITE["precision"] * F.col("Test_Precision") + COMPOSITE["gap"] * g)
    # one row per model: the window is tiny
    w = Window.orderBy(F.col("Composite_Score").desc(), F.col("Model"))
    return res.withColumn("Gap_Status", F.when(g < GAP_GREEN, "green").when(g < GAP_AMBER, "amber")
                          .otherwise("red")) \
        .withColumn("Composite_Score", comp).withColumn("Rank", F.row_number().over(w))


class BusinessEvaluator(Evaluator):
    """ML-19 / UDF-1: 0.7 precision + 0.3 F1 of the ``prediction`` column."""

    def __init__(self, label: str = TARGET):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset):
        r = M.classification_metrics(dataset, self.label, "prediction") \
            .select(M.business_score().alias("s")).first()
        return float(r["s"])

    def isLargerBetter(self):
        return True


def sampling_comparison(prepared: Prepared, seed: int = 42) -> DataFrame:
    """ML-17: a 30-tree depth-8 balanced forest per sampling strategy; best precision first.

    A strategy that fails (e.g. too few defaults for its neighbours) is
    reported with ``error`` and left out of the ranking, the others go on.
    """
    spark = prepared.train.sparkSession
    test = with_vector(prepared.test, prepared.features).select(TARGET, "features").persist()
    rows, neighbours = [], searched_once()
    for i, (name, method, ratio) in enumerate(SAMPLING_STRATEGIES):
        try:
            tr = balance(prepared.train, prepared.features, method, ratio, seed, neighbours)
            table, edges = tree_table(tr, prepared.features)
            model, = balanced_forest(spread(table), edges, [-1], SAMPLING_TREES, SAMPLING_DEPTH, MIN_LEAF, MIN_SPLIT, seed)
            m = test_metrics(model, test)
            rows.append((i, name, method, ratio, m["precision"], m["recall"], m["f1"], None))
        except Exception as e:  # noqa: BLE001 - the comparison goes on without this strategy
            rows.append((i, name, method, ratio, None, None, None, f"{type(e).__name__}: {e}"[:500]))
    test.unpersist()
    df = spark.createDataFrame(rows, "_i int, strategy string, method string, ratio double, precision double, "
                                     "recall double, f1_score double, error string")
    # first strategy wins a tie
    w = Window.orderBy(F.col("precision").desc_nulls_last(), F.col("_i"))
    return df.withColumn("rank", F.when(F.col("error").isNull(), F.row_number().over(w))).drop("_i")


def search_candidates(seed: int = 42, n_iter: int = SEARCH_ITER) -> list[dict]:
    """ML-18: n_iter grid points without replacement, chosen by a seeded hash of their index."""
    import hashlib
    import itertools
    keys = list(SEARCH_GRID)
    grid = [dict(zip(keys, v)) for v in itertools.product(*[SEARCH_GRID[k] for k in keys])]
    order = sorted(range(len(grid)), key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
    return [grid[i] for i in order[:n_iter]]


Kind = tuple[str, int, int]  # class weight, min_samples_leaf, min_samples_split


def _kind(c: dict) -> Kind:
    return c["class_weight"], c["min_samples_leaf"], c["min_samples_split"]


def _weights(scheme: str, counts: dict[int, int]) -> tuple[float, float]:
    return TR.balanced_weights(counts) if scheme == "balanced" else (FIXED_CLASS_WEIGHT[0], FIXED_CLASS_WEIGHT[1])


def search_scores(prepared: Prepared, seed: int = 42, n_iter: int = SEARCH_ITER, k: int = 3) -> DataFrame:
    """ML-18: one row per candidate with the mean business score of its k folds.

    Candidates of one kind (class weight, leaf and split limit) share their
    trees: a forest of 30 is the first 30 trees of the one of 100, and a tree of
    depth 6 is the upper part of the one of depth 10.  So at most 8 kinds x k
    folds x 100 trees grow, all in the same scans, one a level, and one more
    scan counts the hits of every candidate in its held-out folds.
    """
    spark = prepared.train.sparkSession
    rows = written(folds(prepared.train, k, seed), "folds")
    table, edges = tree_table(rows, prepared.features, "fold")
    table = spread(table).persist()
    folds_, d = TR.fold_counts(table), len(edges)
    candidates = search_candidates(seed, n_iter)
    kinds: dict[Kind, list[dict]] = {}
    for c in candidates:
        kinds.setdefault(_kind(c), []).append(c)
    plan, specs = [], []
    for kind, members in kinds.items():
        n_trees, depth = max(c["n_estimators"] for c in members), max(c["max_depth"] for c in members)
        for out in range(k):
            w = _weights(kind[0], TR.training_counts(folds_, out))
            plan.append((kind, out, w, len(specs), n_trees))
            specs += TR.forest_specs(f"{kind} without {out}", n_trees, depth, d, out, w, kind[1], kind[2], seed)
    trees = TR.grow_forest(table, specs, d, widths=widths(edges))
    asked = [(out, [(i, c["n_estimators"], c["max_depth"]) for i, c in enumerate(candidates) if _kind(c) == kind], trees[a:a + n], w)
             for kind, out, w, a, n in plan]
    hits = {(r["candidate"], r["fold"]): r for r in TR.held_out_hits(table, asked).collect()}  # candidates x folds rows
    table.unpersist()

    def score(i: int, out: int) -> float:
        r = hits.get((i, out))
        if r is None:
            return 0.0
        precision = r["tp"] / (r["tp"] + r["fp"]) if r["tp"] + r["fp"] else 0.0
        f1 = 2 * r["tp"] / (2 * r["tp"] + r["fp"] + r["fn"]) if r["tp"] else 0.0
        return M.BUSINESS_W_PRECISION * precision + M.BUSINESS_W_F1 * f1

    out_rows = [(i, json.dumps(c, sort_keys=True), sum(score(i, o) for o in range(k)) / k) for i, c in enumerate(candidates)]
    return spark.createDataFrame(out_rows, "candidate int, params string, cv_score double")


def best_forest(prepared: Prepared, scores: DataFrame, seed: int = 42):
    """The model of the best candidate (the first of equals), refitted on all training rows: (model, params, score)."""
    # one row per candidate
    best = scores.orderBy(F.col("cv_score").desc(), "candidate").first()
    c = json.loads(best["params"])
    table, edges = tree_table(prepared.train, prepared.features)
    w = _weights(c["class_weight"], TR.training_counts(TR.fold_counts(table), -1))
    specs = TR.forest_specs("best", c["n_estimators"], c["max_depth"], len(edges), -1, w, c["min_samples_leaf"], c["min_samples_split"], seed)
    model = TR.forest_model(TR.grow_forest(spread(table), specs, len(edges), widths=widths(edges)), w, edges)
    return model, best["params"], best["cv_score"]


def hyperparameter_search(prepared: Prepared, seed: int = 42, n_iter: int = SEARCH_ITER, k: int = 3) -> DataFrame:
    """ML-18: random search over stratified folds, refit, test metrics; one row."""
    return tuned(prepared, seed, n_iter, k)[0]


def tuned(prepared: Prepared, seed: int = 42, n_iter: int = SEARCH_ITER, k: int = 3):
    """(the search's result row, the refitted model)."""
    model, params, score_ = best_forest(prepared, search_scores(prepared, seed, n_iter, k), seed)
    m = test_metrics(model, with_vector(prepared.test, prepared.features))
    row = prepared.train.sparkSession.createDataFrame(
        [(params, score_, m["precision"], m["recall"], m["f1"], m["auc"])],
        "best_params string, best_cv_score double, test_precision double, test_recall double, "
        "test_f1 double, test_roc_auc double")
    return row, model


def optimisation_report(base: dict, threshold: dict, sampling: DataFrame, hyper: DataFrame) -> DataFrame:
    """ML-20 / ML-21: comparison table and the overall best by precision.

    Sampling is listed but not a candidate for the overall best; a later
    configuration must be strictly better to replace an earlier one.
    """
    spark = sampling.sparkSession
    rows = [("Base Model", 0, base["precision"], base["recall"], base["f1"]),
            ("Threshold Optimized", 1, threshold["precision"], threshold["recall"], threshold["f1"])]
    t = spark.createDataFrame(rows, "configuration string, ord int, precision double, recall double, f1_score double")
    s = sampling.where("rank = 1").select(F.concat(F.lit("Sampling: "), "strategy").alias("configuration"),
                                          F.lit(2).alias("ord"), "precision", "recall", "f1_score")
    h = hyper.select(F.lit("Hyperparameter Tuned").alias("configuration"), F.lit(3).alias("ord"),
                     F.col("test_precision").alias("precision"), F.col("test_recall").alias("recall"),
                     F.col("test_f1").alias("f1_score"))
    allr = t.unionByName(s).unionByName(h)
    cand = allr.where(F.col("ord") != 2)
    # strict '>' keeps the earlier configuration on a tie: order by precision desc, then ord
    w = Window.orderBy(F.col("precision").desc(), F.col("ord"))
    best = cand.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        F.col("configuration").alias("best_configuration"), F.col("precision").alias("best_precision"))
    base_p = F.lit(float(base["precision"]))
    return allr.crossJoin(best).withColumn("is_best", F.col("configuration") == F.col("best_configuration")) \
        .withColumn("precision_gain", F.col("best_precision") - base_p) \
        .withColumn("relative_gain", F.try_divide(F.col("best_precision") - base_p, base_p)) \
        .withColumn("target_met", F.col("best_precision") >= M.TARGET_PRECISION).drop("ord")


def package(source: DataFrame, features: list[str], model, train_ids: DataFrame | None = None) -> PipelineModel:
    """Fills, codes, scaler, selection and model as one persistable pipeline over raw feature rows.

    ``source`` is the engineered table the model's ML table was made from;
    the fitted fills and codes are those of ``prep.ml_table``, the scaler is
    fitted on ``train_ids`` (all rows without it).  The statistics are
    written into SQL expressions, so the package needs no code to load it:
    a few numbers per selected feature and the categories of selected text
    features.
    """
    text = [c for c in features if not isinstance(source.schema[c].dataType, NumericType)]
    numeric = [c for c in features if c not in text]
    fill = {r["column"]: r["fill"] for r in prep.median_fill_values(source, numeric).collect()} if numeric else {}
    fill |= {r["column"]: r["fill"] for r in prep.mode_fill_values(source, text).collect()} if text else {}

    def lit(v) -> str:
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"CAST('{float(v)!r}' AS DOUBLE)"

    parts = [f"COALESCE(CAST(`{c}` AS DOUBLE), {lit(fill.get(c))}) AS `_x_{c}`" for c in numeric]
    if text:
        filled = source.select(*[F.coalesce(F.col(c), F.lit(fill[c])).alias(c) for c in text])
        codes: dict[str, list] = {}
        for r in prep.label_codes(filled, text).collect():
            codes.setdefault(r["column"], []).append((r["value"], r["code"]))
        for c in text:
            table = ", ".join(f"{lit(v)}, {k}" for v, k in sorted(codes[c], key=lambda x: x[1]))
            # element_at gives null for a category that training hasn't seen; the handler skips nothing
            parts.append(f"CAST(MAP({table})[COALESCE(`{c}`, {lit(fill[c])})] AS DOUBLE) AS `_x_{c}`")
    keep = source if train_ids is None else source.join(train_ids, ID, "left_semi")
    encoded = keep.selectExpr(*parts)
    stats = {r["column"]: r for r in prep.scaler_stats(encoded, [f"_x_{c}" for c in features]).collect()}
    scaled = []
    for c in features:
        r = stats[f"_x_{c}"]
        scaled.append(f"COALESCE(TRY_DIVIDE(`_x_{c}` - {lit(r['mean'])}, {lit(r['std'])}), CAST(0 AS DOUBLE)) AS `_z_{c}`")
    return PipelineModel(stages=[
        SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__"),
        SQLTransformer(statement="SELECT *, " + ", ".join(scaled) + " FROM __THIS__"),
        VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="features"), model])


def raw_rows(df: DataFrame, features: list[str], source: DataFrame) -> DataFrame:
    """Rows with every feature the package reads: those a row doesn't have are missing, and filled like missing ones."""
    have = set(df.columns)
    return df.select("*", *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in features if c not in have])


def save_model(model, features: list[str], path: str, threshold: float | None, extra: dict | None = None) -> None:
    """SNK-5: the package (``package``; a bare model reads prepared rows) plus a one-row metadata table."""
    pm = model if isinstance(model, PipelineModel) else PipelineModel(stages=[
        VectorAssembler(inputCols=features, outputCol="features"), model])
    pm.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = {"threshold": threshold, "features": features, "version": MODEL_VERSION,
            "saved_at": dt.datetime.now(dt.timezone.utc).isoformat(), **(extra or {})}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string") \
        .write.mode("overwrite").json(f"{path}/meta")


def load_model(path: str):
    """SRC-6: (pipeline model, features, threshold defaulting to 0.5)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
    thr = meta.get("threshold")
    return PipelineModel.load(f"{path}/model"), meta.get("features", []), 0.5 if thr is None else thr


def run_pipeline(features: DataFrame, model_dir: str, config: dict = DEFAULT_CONFIG) -> DataFrame:
    """ML-13: prepare, balance, fit and compare, save the best model with all it needs to score raw rows.

    ``features`` is the engineered loan table; returns the results table.
    """
    p = prepare(prep.ml_table(features, keep_id=True), config)
    tr = balance(p.train, p.features, "smote", config["smote_ratio"], config["random_state"])
    res, fitted = train_and_compare(p, config, tr)
    # one row per model: a bounded collect
    best = res.where("Rank = 1").select("Model", "Test_Precision", "Test_Recall", "Test_F1", "Test_ROC_AUC").first()
    save_model(package(features, p.features, fitted[best["Model"]], p.train.select(ID)), p.features, model_dir,
               threshold=None, extra={"model_name": best["Model"], "config": config,
                                      "metrics": {k: v for k, v in best.asDict().items() if k != "Model"}})
    return res


def run_optimisation(features: DataFrame, model_dir: str, out_dir: str, seed: int = 42, n_iter: int = SEARCH_ITER,
                     k: int = 3) -> DataFrame:
    """ML-20 / ML-21: reload the saved model, tune its threshold, compare samplings, search, report, save the best.

    Returns the report; the tuned model and its threshold are saved under ``out_dir``.
    """
    p = prepare(prep.ml_table(features, keep_id=True))
    pm, _, thr = load_model(model_dir)
    test_raw = features.join(p.test.select(ID), ID, "left_semi")
    scored = written(p1(pm.transform(test_raw)).select(F.col(TARGET).alias("y"), F.col("p1").alias("score")), "test-scores")

    def at(t: float) -> dict:
        r = M.classification_metrics(scored.withColumn("pred", (F.col("score") >= F.lit(t)).cast("int")), "y", "pred").first()
        return {"precision": r["precision"], "recall": r["recall"], "f1": r["f1_score"]}

    sweep = M.threshold_sweep(scored, "y", "score")
    choice = M.choose_thresholds(sweep).where("strategy = 'precision_first'").first()  # one row
    tuned_thr = float(choice["threshold"])
    hyper, model = tuned(p, seed, n_iter, k)
    report = written(optimisation_report(at(thr), at(tuned_thr), sampling_comparison(p, seed), hyper), "optimisation")
    save_model(package(features, p.features, model, p.train.select(ID)), p.features, out_dir, threshold=tuned_thr,
               extra={"optimised": True})
    return report
