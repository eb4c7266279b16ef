"""Model pipelines on Spark ML.

Training is Spark ML (``treeAggregate`` on the executors, the driver only
holds coefficients / trees).  Every pipeline returns a score table
``case_id, score, predicted_label, actual_label`` so the metrics in
``operators.metrics`` apply unchanged.  Learners the original used that
Spark lacks (LightGBM, CatBoost, keras) are re-aimed at ``GBTClassifier``,
``LinearSVC`` and ``MultilayerPerceptronClassifier``; the differences are
stated per pipeline.  Boosted trees with patience are in ``operators.boosting``.
Fits that don't depend on one another (folds, bases, draws) run at once: their
jobs are short and would otherwise wait for the driver, not for executors.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskroll.operators import boosting, classes, metrics, neighbours, sampling
from riskroll.operators.boosting import GBTParams

# Fixed values of the original pipelines
LASSO_ALPHA = 0.005
LASSO_KEEP = 1e-5
SVM_UNDERSAMPLE = 0.4
MLP_UNDERSAMPLE = 0.2
MLP_OVERSAMPLE = 0.5
MLP_THRESHOLD = 0.518


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns -> one vector column (nulls become NaN, never an error)."""
    cast = df.select("*", *[F.col(c).cast("double").alias(f"_f_{c}") for c in features])
    va = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out, handleInvalid="keep")
    return va.transform(cast).drop(*[f"_f_{c}" for c in features])


def positive_probability(col: str = "probability"):
    return vector_to_array(F.col(col))[1]


def score_table(pred: DataFrame, score, threshold: float, strict: bool = False, key: str = "case_id",
                label: str = "target") -> DataFrame:
    hit = score > F.lit(threshold) if strict else score >= F.lit(threshold)
    return pred.select(key, score.alias("score"), hit.cast("int").alias("predicted_label"),
                       F.col(label).cast("int").alias("actual_label"))


# --------------------------------------------------------------------------
# Undersample -> scale -> lasso selection -> linear SVM
# --------------------------------------------------------------------------

@dataclass
class LassoResult:
    coefficients: dict[str, float]
    selected: list[str]
    intercept: float

    def score(self) -> Column:
        """The prediction, over standardised feature columns."""
        terms = [F.lit(w) * F.col(f"`{f}`") for f, w in self.coefficients.items() if w]
        return sum(terms, F.lit(self.intercept))


#: Most features of a Gram matrix (its square is held on the driver).
MAX_GRAM = 8192
LASSO_TOLERANCE = 1e-12


def gram(train: DataFrame, features: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X / n and X'y / n of the standardised features (population std, 0 for constant ones), and the label's mean.

    Sufficient statistics from one pass of ``Correlation`` (its Gram matrix is summed on the executors) beside the
    label's mean and deviation: further passes over the rows are not needed, whatever the penalty.
    """
    if len(features) > MAX_GRAM:
        raise ValueError(f"{len(features)} features; a Gram matrix holds at most {MAX_GRAM}")
    y = F.col(label).cast("double")
    both = assemble(train.select(*features, y.alias("_y")), [*features, "_y"]).select("features")
    corr = np.nan_to_num(Correlation.corr(both, "features").first()[0].toArray())
    mean, std = train.agg(F.avg(y), F.stddev_pop(y)).first()
    return corr[:-1, :-1], corr[:-1, -1] * float(std or 0.0), float(mean or 0.0)


def coordinate_descent(xx: np.ndarray, xy: np.ndarray, alpha: float, max_sweeps: int = 100_000) -> np.ndarray:
    """The minimum of w'(X'X/n)w / 2 - w'(X'y/n) + alpha |w|, one coordinate at a time until none moves."""
    w = np.zeros(len(xy))
    for _ in range(max_sweeps):
        moved = 0.0
        for j in range(len(w)):
            if xx[j, j] <= 0:
                continue
            rest = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / xx[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < LASSO_TOLERANCE:
            break
    return w


def fit_lasso(train: DataFrame, features: Sequence[str], label: str = "target", alpha: float = LASSO_ALPHA) -> LassoResult:
    """L4: L1-penalised least squares on standardised features (population std, as the
    original scaler); features whose |coefficient| >= 1e-5 are kept, all of them when none is."""
    xx, xy, mean = gram(train, features, label)
    coefs = dict(zip(features, map(float, coordinate_descent(xx, xy, alpha))))
    selected = [f for f in features if abs(coefs[f]) >= LASSO_KEEP] or list(features)
    return LassoResult(coefs, selected, mean)


def lasso_scores(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "target", threshold: float = 0.5) -> DataFrame:
    """The lasso fitted on ``train`` as a scorer of ``valid``."""
    st = classes.fit_standardizer(train, features)
    return score_table(st.apply(valid), fit_lasso(train, features, label).score(), threshold, label=label)


def lasso_table(res: LassoResult, spark) -> DataFrame:
    return spark.createDataFrame([(f, c, int(f in res.selected)) for f, c in res.coefficients.items()],
                                 "feature string, coefficient double, selected int")


def svm_pipeline(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "target",
                 max_iter: int = 1000) -> tuple[DataFrame, LassoResult]:
    """Undersample (0.4) -> standardise -> lasso selection -> class-balanced LinearSVC.

    Score = margin (``rawPrediction[1]``), label = margin > 0.  Spark's
    LinearSVC minimises the hinge loss (the original used squared hinge).
    """
    under = sampling.undersample(train, SVM_UNDERSAMPLE, label)
    lasso = fit_lasso(under, features, label)
    st = classes.fit_standardizer(under, features)
    weighted = classes.with_class_weight(st.apply(under), label, "weight_balanced")
    svc = LinearSVC(featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, regParam=0.0)
    model = svc.fit(assemble(weighted, lasso.selected).withColumn(label, F.col(label).cast("double")))
    pred = model.transform(assemble(st.apply(valid), lasso.selected))
    return score_table(pred, vector_to_array("rawPrediction")[1], 0.0, strict=True, label=label), lasso


# --------------------------------------------------------------------------
# Boosted trees
# --------------------------------------------------------------------------

def fit_gbt(train: DataFrame, features: Sequence[str], params: GBTParams, label: str = "target",
            categorical: Sequence[str] = (), key: str = "case_id") -> PipelineModel:
    """Class-weighted boosted trees, all ``max_iter`` rounds, as a PipelineModel (indexers + assembler + trees)."""
    weighted = classes.with_class_weight(train, label, params.weighting)
    made = boosting.matrix(weighted, features, [label, "weight"], categorical)
    est = boosting.boosted_estimator(params, params.max_iter, made.max_bins, label, "weight")
    return PipelineModel(stages=[*made.stages, est.fit(made.rows.withColumn(label, F.col(label).cast("double")))])


def gbt_importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """``feature, importance`` (number of splits in all trees), descending; ``features`` lists
    the numeric features and then the categorical ones, in assembler order."""
    return boosting.split_counts(model.stages[-1], features, spark).orderBy(F.col("importance").desc(), "feature")


def boosted_scores(train: DataFrame, test: DataFrame, features: Sequence[str], categorical: Sequence[str], params: GBTParams,
                   label: str = "target", key: str = "case_id") -> DataFrame:
    """Grow on 80 % of ``train``, stop and choose the F1-optimal threshold on the rest, score ``test``.

    The score table has ``trees_built`` (rounds fitted) and ``best_round`` (trees kept) beside it.
    """
    split = sampling.stratified_split(train.select(key, label, *features, *categorical), label=label, key=key)
    grown = boosting.fit_boosted(split, features, params, label, categorical=categorical, key=key)
    model = grown.pipeline()
    valid = model.transform(split.where("is_valid = 1")).select(positive_probability().alias("score"), F.col(label).alias("actual_label"))
    best = metrics.best_f1_threshold(valid).first()["threshold"]
    scores = score_table(model.transform(test), positive_probability(), best if best is not None else 0.5, label=label, key=key)
    return scores.withColumn("trees_built", F.lit(grown.trees_built)).withColumn("best_round", F.lit(grown.best_round))


# --------------------------------------------------------------------------
# T4: MLP
# --------------------------------------------------------------------------

def mlp_pipeline(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str = "target",
                 hidden: Sequence[int] = (64, 32), max_iter: int = 200, seed: int = 42, key: str = "case_id") -> DataFrame:
    """T4: undersample (0.2) -> ADASYN (0.5) -> standardise -> MLP [n, 64, 32, 2]; label = p > 0.518.

    Spark's MLP has sigmoid hidden units, no batch norm / dropout / focal
    loss and no ``weightCol``: the class balance comes from resampling."""
    under = sampling.undersample(train, MLP_UNDERSAMPLE, label, key)
    balanced = neighbours.adasyn(under.select(key, label, *features), features, MLP_OVERSAMPLE, label, key)
    st = classes.fit_standardizer(balanced, features)
    rows = boosting.matrix(st.apply(balanced).withColumn(label, F.col(label).cast("double")), features, [label]).rows
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                         layers=[len(features), *hidden, 2], maxIter=max_iter, seed=seed)
    pred = mlp.fit(rows).transform(assemble(st.apply(valid), features))
    return score_table(pred, positive_probability(), MLP_THRESHOLD, strict=True, label=label)


@dataclass(frozen=True)
class MLPParams:
    hidden: tuple = (32, 16)
    max_iter: int = 200
    seed: int = 42


def fit_mlp(rows: DataFrame, params: MLPParams, label: str = "target") -> PipelineModel:
    """T5: the stack's MLP base over a ``features`` column as a PipelineModel (scaler -> MLP).

    Spark's MLP takes no class weights; the stack's meta learner is the
    class-weighted part."""
    rows = rows.withColumn(label, F.col(label).cast("double"))
    sc = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    width = len(rows.select("features").first()[0])
    mlp = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol=label, layers=[width, *params.hidden, 2],
                                         maxIter=params.max_iter, seed=params.seed)
    return Pipeline(stages=[sc, mlp]).fit(rows)


def fit_base(rows: DataFrame, params, max_bins: int, label: str = "target"):
    """A stack base learner over a ``features`` column: boosted trees (``GBTParams``; grown on the rows with
    ``is_valid`` 0 and stopped on the others) or an MLP (``MLPParams``)."""
    if isinstance(params, MLPParams):
        return fit_mlp(rows, params, label)
    return boosting.grow(rows.where("is_valid = 0"), rows.where("is_valid = 1"), params, max_bins, label).model


# --------------------------------------------------------------------------
# Stacking with out-of-fold predictions
# --------------------------------------------------------------------------

def _scored(rows: DataFrame, models: dict) -> DataFrame:
    """``p_<name>`` of every model beside the rows, one after the other: no join."""
    for name, model in models.items():
        kept = rows.columns
        rows = model.transform(rows).select(*kept, positive_probability().alias(f"p_{name}"))
    return rows


def _stack(train: DataFrame, features: Sequence[str], base_params: dict, k: int, label: str, key: str, threads: int, full: bool):
    """The matrix of ``train`` with folds, and the fitted bases by fold (-1: all folds)."""
    folded = sampling.stratified_kfold(sampling.stratified_split(train.select(key, label, *features), label=label, key=key), k, label, key)
    weighted = classes.with_class_weight(folded, label, "weight_ratio")
    made = boosting.matrix(weighted, features, [key, label, "fold", "is_valid", "weight"])
    tasks = [(f, name) for f in (*range(k), *((-1,) if full else ())) for name in base_params]

    def fit(f: int, name: str):
        return lambda: fit_base(made.rows.where(F.col("fold") != f), base_params[name], made.max_bins, label)

    fitted = boosting.in_parallel(train.sparkSession, [fit(*t) for t in tasks], threads)
    models: dict[int, dict] = {}
    for (f, name), model in zip(tasks, fitted):
        models.setdefault(f, {})[name] = model
    return made, models


def _out_of_fold(made: boosting.Matrix, models: dict, k: int, label: str, key: str) -> DataFrame:
    parts = [_scored(made.rows.where(F.col("fold") == f).select(key, label, "fold", "features"), models[f]).drop("features")
             for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stack_oof(train: DataFrame, features: Sequence[str], base_params: dict, k: int = 5,
              label: str = "target", key: str = "case_id", threads: int = 6) -> DataFrame:
    """Out-of-fold probabilities of every base learner: ``case_id, target, fold, p_<name>…``.

    Folds come from the stratified k-fold (R4); fold ``f`` is scored by models fitted on the other folds.  All fits run
    over one written matrix, ``threads`` at a time; a fold's rows pass through its models one after the other.
    """
    made, models = _stack(train, features, base_params, k, label, key, threads, full=False)
    return _out_of_fold(made, models, k, label, key)


def fit_meta(oof: DataFrame, names: Sequence[str], label: str = "target"):
    """Class-balanced logistic regression on the out-of-fold probabilities."""
    cols = [f"p_{n}" for n in names]
    weighted = classes.with_class_weight(oof, label, "weight_balanced")
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=100)
    return lr.fit(assemble(weighted, cols).withColumn(label, F.col(label).cast("double")))


def stack_score(train: DataFrame, test: DataFrame, features: Sequence[str], base_params: dict,
                k: int = 5, label: str = "target", key: str = "case_id", threshold: float = 0.5, threads: int = 6) -> DataFrame:
    """Bases refit on all train rows score the test rows; the meta model combines them."""
    made, models = _stack(train, features, base_params, k, label, key, threads, full=True)
    path = boosting.shared_folder(train.sparkSession, "stack-oof")
    oof = _out_of_fold(made, models, k, label, key)
    oof.write.parquet(path)
    meta = fit_meta(train.sparkSession.read.schema(oof.schema).parquet(path), list(base_params), label)
    rows = test.select(key, label, *features)
    for s in made.stages:
        rows = s.transform(rows)
    scored = _scored(rows.select(key, label, "features"), models[-1]).drop("features")
    pred = meta.transform(assemble(scored, [f"p_{n}" for n in base_params]))
    return score_table(pred, positive_probability(), threshold, label=label)


# --------------------------------------------------------------------------
# Random searches with cross-validation on average precision
# --------------------------------------------------------------------------

# Hidden layers of the network search, and its epochs.
MLP_LAYERS = [(128, 64), (256, 128, 64), (512, 256, 128), (256, 128), (512, 256), (64, 32)]
MLP_ITERATIONS = [5, 10, 20]


def _search_matrix(train: DataFrame, features: Sequence[str], k: int, label: str, key: str) -> boosting.Matrix:
    folded = sampling.stratified_kfold(train.select(key, label, *features), k, label, key)
    weighted = classes.with_class_weight(folded, label, "weight_ratio")
    return boosting.matrix(weighted, features, [label, "fold", "weight"])


def random_search(train: DataFrame, features: Sequence[str], n_draws: int = 15, k: int = 5, label: str = "target",
                  key: str = "case_id", seed: int = 42, patience: int = 20, threads: int = 8) -> DataFrame:
    """Seeded random draws of boosted-tree settings (``boosting.SEARCH_SPACE``), scored by mean average precision
    over stratified folds with staged scores: each fold's best round within the drawn number of rounds, which ends
    ``patience`` rounds after the best one (``boosting.search``).

    Returns ``draw``, the settings, ``mean_pr_auc``, ``trees_built`` (on all folds) and ``is_best`` (first of equals)."""
    draws = boosting.draw(n_draws, seed)
    made = _search_matrix(train, features, k, label, key)
    found = boosting.search(made.rows, draws, k, label, patience, threads)
    best = max(range(n_draws), key=lambda i: (found[i]["score"], -i))
    rows = [(i, *(type(v[0])(getattr(d, c)) for c, v in boosting.SEARCH_SPACE.items()), f["score"], f["trees_built"], int(i == best))
            for i, (d, f) in enumerate(zip(draws, found))]
    settings = ", ".join(f"{c} {'double' if isinstance(v[0], float) else 'int'}" for c, v in boosting.SEARCH_SPACE.items())
    return train.sparkSession.createDataFrame(
        rows, f"draw int, {settings}, mean_pr_auc double, trees_built int, is_best int")


def mlp_search(train: DataFrame, features: Sequence[str], n_draws: int = 20, k: int = 5, folds: int = 3, label: str = "target",
               key: str = "case_id", seed: int = 42, threads: int = 6) -> DataFrame:
    """Seeded draws of hidden layers and iterations of the network, scored by mean average precision over the first
    ``folds`` of ``k`` stratified folds.  Equal draws share their fits.

    Returns ``draw, hidden, max_iter, mean_pr_auc, is_best``."""
    rng = random.Random(seed)
    draws = [MLPParams(rng.choice(MLP_LAYERS), rng.choice(MLP_ITERATIONS), seed) for _ in range(n_draws)]
    rows = _search_matrix(train, features, k, label, key).rows
    tasks = [(d, f) for d in dict.fromkeys(draws) for f in range(folds)]

    def score(params: MLPParams, f: int):
        def run() -> float:
            model = fit_mlp(rows.where(F.col("fold") != f), params, label)
            scored = model.transform(rows.where(F.col("fold") == f)).select(
                positive_probability().alias("score"), F.col(label).cast("int").alias("actual_label"))
            return float(metrics.curve_summary(scored).first()["average_precision"] or 0.0)
        return run

    found = dict(zip(tasks, boosting.in_parallel(train.sparkSession, [score(*t) for t in tasks], threads)))
    scores = [sum(found[d, f] for f in range(folds)) / folds for d in draws]
    best = max(range(n_draws), key=lambda i: (scores[i], -i))
    return train.sparkSession.createDataFrame(
        [(i, "-".join(map(str, d.hidden)), d.max_iter, scores[i], int(i == best)) for i, d in enumerate(draws)],
        "draw int, hidden string, max_iter int, mean_pr_auc double, is_best int")


# --------------------------------------------------------------------------
# Save, load, batch score
# --------------------------------------------------------------------------

def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batch_score(model: PipelineModel, df: DataFrame, threshold: float, label: str = "target",
                key: str = "case_id") -> DataFrame:
    """A saved pipeline scores a table; ``vector_to_array(probability)[1]`` is the score."""
    return score_table(model.transform(df), positive_probability(), threshold, label=label, key=key)
