"""Boosted trees with patience, staged scores and split counts, from the trees as data.

Spark's own early stopping watches the loss without patience.  Here a model is grown in stages: it is fitted with some
rounds, every prefix of it is scored on the validation rows in one pass, and it is fitted with half as many rounds
again until the best prefix is ``patience`` rounds old.  A fit is deterministic, so the first rounds of a longer one
are the same trees; all fits together build at most about three times the trees of the last one, and the model kept is
its best prefix.

* ``tree_nodes`` reads the node table of a saved forest or boosted model as a DataFrame.
* ``staged_scores`` has Spark write each row's leaf per tree (``leafCol``), looks the leaves' values up and sums them
  round by round; metrics of all rounds come from one grouped pass (``metrics.curve_summary``).
* ``split_counts`` counts the splits per feature.  Where only importance is wanted, ``forest_split_counts`` fits
  random forests: a forest's trees grow together, level by level, in a few passes over the data.
* ``matrix`` assembles the features once into one vector column and writes it to the shared folder; folds, rounds and
  draws all read that table.

On the driver: the leaves of one model (rounds x 2 ** depth numbers) and one metric per round.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskroll.operators import classes, metrics
from riskroll.operators.ordered import bounded_collect
from riskroll.session import ensure_checkpoint_dir

# Most values of a categorical feature (the indexer keeps them on the driver), bins of a numeric one,
# most leaves of one model that are looked up on the driver.
MAX_CATEGORIES = 100_000
NUMERIC_BINS = 64
MAX_LEAVES = 4_000_000
#: Most trees of one forest.
FOREST_TREES = 100
#: Stands for a missing number in a matrix.
MISSING = "-1E300"


@dataclass(frozen=True)
class GBTParams:
    """Boosted-tree settings; 1000 rounds with patience 100 as in the first boosted pipeline."""

    max_iter: int = 1000
    max_depth: int = 6
    step_size: float = 0.05
    weighting: str = "weight_ratio"     # n0 / n1 (first boosted pipeline) or weight_odds (second)
    seed: int = 42
    patience: int = 100
    max_bins: int = NUMERIC_BINS
    min_instances: int = 1
    min_gain: float = 0.0
    subsample: float = 1.0
    feature_share: float = 1.0


def in_parallel(spark, tasks: Sequence[Callable], threads: int) -> list:
    """Results of ``tasks`` (fits whose jobs share the cluster), ``threads`` at a time."""
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def shared_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------
# the feature matrix
# --------------------------------------------------------------------------

@dataclass
class Matrix:
    """``rows`` (the kept columns and ``features``), the transformers that made them and the features' names."""

    rows: DataFrame
    stages: list
    names: list[str]
    max_bins: int


def matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str], categorical: Sequence[str] = (),
           fit_on: DataFrame | None = None) -> Matrix:
    """F16: one vector column beside ``keep``, written once to the shared folder and read again.

    ``categorical`` string columns are indexed (sorted order, nulls and unseen values to one extra index) by a
    dictionary fitted on ``fit_on``.  Nulls and NaN of numeric features lie below every value, where a tree can split
    them off (Spark's trees take no NaN).
    """
    spark, fit_on = df.sparkSession, df if fit_on is None else fit_on
    stages, max_bins, index = [], NUMERIC_BINS, [f"{c}__idx" for c in categorical]
    if categorical:  # a categorical split needs a bin per category, and one for unseen values
        sizes = fit_on.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in categorical]).first()
        largest = int(max(sizes) * 1.1) + 2
        if largest > MAX_CATEGORIES:
            raise ValueError(f"a categorical feature with about {largest} values; at most {MAX_CATEGORIES}")
        max_bins = max(max_bins, largest)
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep",
                                    stringOrderType="alphabetAsc").fit(fit_on))
    numbers = [f"{c}__num" for c in features]
    if features:
        filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), {MISSING}D), {MISSING}D) AS `{n}`" for c, n in zip(features, numbers))
        stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=[*numbers, *index], outputCol="features"))
    rows = df
    for s in stages:
        rows = s.transform(rows)
    rows = rows.select(*keep, "features")
    path = shared_folder(spark, "matrix")
    rows.hint("rebalance").write.parquet(path)
    return Matrix(spark.read.schema(rows.schema).parquet(path), stages, [*features, *categorical], max_bins)


# --------------------------------------------------------------------------
# trees as data
# --------------------------------------------------------------------------

def tree_nodes(model, spark) -> DataFrame:
    """Node table of a fitted forest or boosted model, in preorder: ``tree, node, feature`` (null in a leaf),
    ``gain, value`` (the node's prediction), ``rows, is_leaf, leaf`` (number of the leaf in its tree)."""
    path = shared_folder(spark, "trees")
    model.write().overwrite().save(path)
    n, leaf = F.col("nodeData"), F.col("nodeData.leftChild") < 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(~leaf, n["split"]["featureIndex"]).alias("feature"),
        F.when(~leaf, n["gain"]).alias("gain"), n["prediction"].alias("value"), n["rawCount"].alias("rows"), leaf.alias("is_leaf"))
    place = F.row_number().over(Window.partitionBy("tree", "is_leaf").orderBy("node")) - 1
    return nodes.withColumn("leaf", F.when(F.col("is_leaf"), place))


def split_counts(model, names: Sequence[str], spark) -> DataFrame:
    """``feature, importance`` (splits on it in all trees; 0 for unused features)."""
    listed = spark.createDataFrame([(i, f) for i, f in enumerate(names)], "place int, feature string")
    counts = tree_nodes(model, spark).where(~F.col("is_leaf")).groupBy(F.col("feature").alias("place")).agg(
        F.count(F.lit(1)).alias("n"))
    return F.broadcast(listed).join(counts, "place", "left").select(
        "feature", F.coalesce("n", F.lit(0)).cast("bigint").alias("importance"))


def forest_split_counts(rows: DataFrame, names: Sequence[str], label: str, trees: int, depth: int, max_bins: int,
                        seed: int = 42, threads: int = 2) -> dict[str, int]:
    """Splits per feature in ``trees`` random trees fitted on ``rows`` (``label``, ``features``).

    A forest's cached rows hold a number per tree, and every task a histogram per open node of all trees.  So the trees
    are grown as forests of at most ``FOREST_TREES``, each with a seed of its own, ``threads`` at a time: memory is
    that of a few small forests, however many trees are wanted.
    """
    slim = rows.select(F.col(label).cast("double").alias(label), "features")

    def fit(first: int):
        def run() -> dict[str, int]:
            forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=min(FOREST_TREES, trees - first),
                                            maxDepth=depth, maxBins=max_bins, seed=seed + first)
            return {r["feature"]: r["importance"] for r in split_counts(forest.fit(slim), names, rows.sparkSession).collect()}
        return run

    counts = in_parallel(rows.sparkSession, [fit(first) for first in range(0, trees, FOREST_TREES)], threads)
    return {f: sum(c[f] for c in counts) for f in names}


# --------------------------------------------------------------------------
# staged scores and patience
# --------------------------------------------------------------------------

def leaf_values(model, spark) -> list[list[float]]:
    """Per tree of a boosted model, its leaves' values times the tree's weight, in the order of ``leafCol``."""
    leaves = tree_nodes(model, spark).where("is_leaf").select("tree", "leaf", "value")
    out: list[list] = [[] for _ in range(model.getNumTrees)]
    for r in sorted(bounded_collect(leaves, MAX_LEAVES, "leaves of a boosted model")):
        out[r["tree"]].append(r["value"] * model.treeWeights[r["tree"]])
    return out


def staged_scores(model: GBTClassificationModel, rows: DataFrame, label: str = "target") -> DataFrame:
    """``round, score, actual_label``: the margin of every row after every round (1 = the first tree alone)."""
    values = F.from_json(F.lit(json.dumps(leaf_values(model, rows.sparkSession))), "array<array<double>>")
    leafed = model.copy({model.leafCol: "_leaf"}).transform(rows.select(label, "features"))
    own = F.zip_with(vector_to_array("_leaf"), values, lambda leaf, v: F.element_at(v, leaf.cast("int") + 1))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("rounds"))

    def add(acc, x):
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["rounds"], F.array(acc["sum"] + x)).alias("rounds"))

    margins = F.aggregate(own, start, add)["rounds"]
    return leafed.select(F.col(label).cast("int").alias("actual_label"), F.posexplode(margins).alias("at", "score")).select(
        (F.col("at") + 1).alias("round"), "score", "actual_label")


def staged_metric(model: GBTClassificationModel, rows: DataFrame, metric: str = "roc_auc", label: str = "target") -> list[float]:
    """``metric`` (of ``metrics.curve_summary``) after every round, 0 where it is undefined."""
    per_round = metrics.curve_summary(staged_scores(model, rows, label), group_cols=["round"]).select("round", metric)
    found = {r["round"]: r[metric] for r in bounded_collect(per_round, MAX_LEAVES, "rounds")}
    return [float(found.get(i + 1) or 0.0) for i in range(model.getNumTrees)]


def best_round(values: Sequence[float], patience: int) -> tuple[int, bool]:
    """Round (from 1) with the first largest value before ``patience`` rounds pass without gain; whether they passed."""
    best = 0
    for i, v in enumerate(values):
        if v > values[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def prefix(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees."""
    if rounds >= model.getNumTrees:
        return model
    java, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds), gateway.new_array(gateway.jvm.double, rounds)
    all_trees = java.trees()
    for i, w in enumerate(model.treeWeights[:rounds]):
        trees[i], weights[i] = all_trees[i], w
    cut = GBTClassificationModel(ml.classification.GBTClassificationModel(f"{model.uid}_{rounds}", trees, weights))
    return cut.setFeaturesCol(model.getFeaturesCol())


@dataclass
class Boosted:
    """A grown model: its best prefix, the rounds fitted, the metric of each and whether patience ended it."""

    model: GBTClassificationModel
    trees_built: int
    best_round: int
    stopped: bool
    values: list[float] = field(default_factory=list)
    stages: list = field(default_factory=list)

    def pipeline(self) -> PipelineModel:
        return PipelineModel(stages=[*self.stages, self.model])


def boosted_estimator(params: GBTParams, rounds: int, max_bins: int, label: str, weight: str | None) -> GBTClassifier:
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=params.max_depth, stepSize=params.step_size,
                        seed=params.seed, maxBins=max(max_bins, params.max_bins), minInstancesPerNode=params.min_instances,
                        minInfoGain=params.min_gain, subsamplingRate=params.subsample,
                        featureSubsetStrategy="all" if params.feature_share >= 1 else str(params.feature_share))
    return est.setWeightCol(weight) if weight else est


def grow(train: DataFrame, valid: DataFrame, params: GBTParams, max_bins: int = NUMERIC_BINS, label: str = "target",
         weight: str | None = "weight", metric: str = "roc_auc") -> Boosted:
    """Grow on ``train`` until ``patience`` rounds bring no gain of ``metric`` on ``valid``, or ``max_iter`` rounds.

    Both are rows of a ``matrix`` (label, ``features``).  The best prefix is kept.
    """
    rounds = min(params.max_iter, params.patience + max(10, params.patience // 4))
    train = train.withColumn(label, F.col(label).cast("double"))
    while True:
        model = boosted_estimator(params, rounds, max_bins, label, weight).fit(train)
        values = staged_metric(model, valid, metric, label)
        best, stopped = best_round(values, params.patience)
        if stopped or rounds >= params.max_iter:
            return Boosted(prefix(model, best), rounds, best, stopped, values)
        rounds = min(params.max_iter, max(best + params.patience + 10, 3 * rounds // 2))


def fit_boosted(df: DataFrame, features: Sequence[str], params: GBTParams, label: str = "target", valid_col: str = "is_valid",
                categorical: Sequence[str] = (), key: str = "case_id") -> Boosted:
    """Boosted trees grown on the rows with ``valid_col`` 0 and stopped on those with 1.

    ``weight_ratio`` counts the classes of all rows, ``weight_odds`` those of the training rows, as the two pipelines
    did.  The dictionary of categories is fitted on the training rows.
    """
    train = df.where(F.col(valid_col) == 0)
    counted = df if params.weighting == "weight_ratio" else train
    weighted = classes.with_class_weight(df, label, params.weighting, fit_on=counted)
    made = matrix(weighted, features, [key, label, valid_col, "weight"], categorical, train)
    grown = grow(made.rows.where(F.col(valid_col) == 0), made.rows.where(F.col(valid_col) == 1), params, made.max_bins, label)
    grown.stages = made.stages
    return grown


# --------------------------------------------------------------------------
# Random search over tree settings
# --------------------------------------------------------------------------

# The search space, as far as Spark's trees have the parameters.
SEARCH_SPACE = {
    "max_iter": [100, 200, 300, 400, 500, 700],
    "max_depth": [3, 4, 5, 6, 7, 8, 10, 12],
    "step_size": [0.005, 0.01, 0.03, 0.05, 0.1, 0.15],
    "min_instances": [5, 10, 15, 20, 25, 30],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "feature_share": [0.6, 0.7, 0.8, 0.9, 1.0],
    "min_gain": [0.0, 0.01, 0.1, 0.5, 1.0],
    "max_bins": [128, 255, 512],
}


def draw(n: int, seed: int = 42) -> list[GBTParams]:
    """``n`` seeded draws from the search space."""
    rng = random.Random(seed)
    return [GBTParams(**{k: rng.choice(v) for k, v in SEARCH_SPACE.items()}) for _ in range(n)]


def search(rows: DataFrame, draws: Sequence[GBTParams], k: int, label: str = "target", patience: int = 20, threads: int = 8,
           metric: str = "average_precision") -> list[dict]:
    """Mean ``metric`` over the folds of every draw; ``rows`` (label, weight, fold, ``features``) is written.

    A draw's score on a fold is that of its best prefix of at most ``max_iter`` rounds, ended ``patience`` rounds after
    the best one.  Draws that differ in ``max_iter`` alone are read off one fit per fold, the longest one's.
    """
    groups: dict[GBTParams, int] = {}
    for d in draws:
        shape = replace(d, max_iter=0)
        groups[shape] = max(groups.get(shape, 0), d.max_iter)
    tasks = [(shape, f) for shape in groups for f in range(k)]

    def fit(shape: GBTParams, fold: int):
        return lambda: grow(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold),
                            replace(shape, max_iter=groups[shape], patience=patience), label=label, metric=metric)

    grown = dict(zip(tasks, in_parallel(rows.sparkSession, [fit(*t) for t in tasks], threads)))
    out = []
    for d in draws:
        own = [grown[replace(d, max_iter=0), f] for f in range(k)]
        out.append({"score": sum(max(g.values[:d.max_iter]) for g in own) / k, "trees_built": sum(g.trees_built for g in own)})
    return out
