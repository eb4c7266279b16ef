"""Exact, distributed scoring metrics over a score table.

Every curve metric first collapses the score table to one row per distinct
score (``groupBy(score)`` with partial aggregation, so a score shared by a
third of the rows is combined map-side), then takes running class counts in
descending score order with ``ordered.running_sums`` (no single-partition
window over raw rows).  From those, ROC/PR points, AUC (ties count ½),
average precision and KS are plain aggregates.  Threshold grids bin the
distinct-score table with a JVM binary search and never touch raw rows
per threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskroll.operators.ordered import bounded_collect, running_sums

# Fixed values
F1_EPS = 1e-8
GRID = [float(x) for x in np.arange(0.1, 0.9, 0.05)]          # 0.10, 0.15, … 0.85
COST_GRID = [float(x) for x in np.linspace(0.0, 1.0, 1000)]    # 1000 points on [0, 1]
MAX_MODELS = 1000
GRID_METRICS = ("f1", "accuracy", "precision", "recall", "balanced_accuracy")


# --------------------------------------------------------------------------
# hard-label metrics
# --------------------------------------------------------------------------

def confusion(df: DataFrame, label: str = "actual_label", pred: str = "predicted_label") -> DataFrame:
    """M1: one row ``tn, fp, fn, tp``."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    """M2 / M15 from the four counts (precision etc. are 0 on an empty denominator)."""
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    tnr = _ratio(tn, tn + fp)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    p_eps = tp.cast("double") / (tp + fp + F.lit(F1_EPS))
    r_eps = tp.cast("double") / (tp + fn + F.lit(F1_EPS))
    return [
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        ((recall + tnr) / 2).alias("balanced_accuracy"),
        _ratio(fn, fn + tp).alias("fnr"),
        (2 * p_eps * r_eps / (p_eps + r_eps + F.lit(F1_EPS))).alias("f1_incremental"),
    ]


def label_metrics(df: DataFrame, label: str = "actual_label", pred: str = "predicted_label") -> DataFrame:
    """M2 (+ M15's ε-F1): accuracy, precision, recall, F1, balanced accuracy, FNR and the counts."""
    cm = confusion(df, label, pred)
    c = [F.col(x) for x in ("tn", "fp", "fn", "tp")]
    return cm.select("tn", "fp", "fn", "tp", *metric_columns(*c))


def label_curve(df: DataFrame, label: str = "actual_label", pred: str = "predicted_label") -> DataFrame:
    """M4 + M11 on hard labels, from the four counts alone: ``label_auc`` (the ROC AUC of a 0/1 score, ties one half)
    and ``ks`` (the larger gap of the cumulative class shares at its two values)."""
    cm = confusion(df, label, pred)
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    tpr, tnr = F.try_divide(F.col("tp").cast("double"), pos), F.try_divide(F.col("tn").cast("double"), neg)
    gap = F.abs(_ratio(F.col("tp"), pos) - _ratio(F.col("fp"), neg))
    both = F.abs(F.when(pos > 0, 1.0).otherwise(0.0) - F.when(neg > 0, 1.0).otherwise(0.0))
    return cm.select(((tpr + tnr) / 2).alias("label_auc"),
                     F.when(pos + neg > 0, F.greatest(gap, both)).alias("ks"))


def class_report(df: DataFrame, label: str = "actual_label", pred: str = "predicted_label") -> DataFrame:
    """Precision, recall, F1 and support for each class (both ways round)."""
    cm = confusion(df, label, pred)
    one = cm.select(F.lit(1).alias("class"), *[_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                                               _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                                               _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                                               (F.col("tp") + F.col("fn")).alias("support")])
    zero = cm.select(F.lit(0).alias("class"), *[_ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("precision"),
                                                _ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("recall"),
                                                _ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fn") + F.col("fp")).alias("f1"),
                                                (F.col("tn") + F.col("fp")).alias("support")])
    return zero.unionByName(one)


# --------------------------------------------------------------------------
# curves over distinct scores
# --------------------------------------------------------------------------

def score_counts(df: DataFrame, score: str = "score", label: str = "actual_label",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): ``score, pos, neg``; rows without a score (null or NaN) are left out."""
    y = F.col(label).cast("bigint")
    return (df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
            .groupBy(*group_cols, F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def cumulative(df: DataFrame, score: str = "score", label: str = "actual_label",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct scores in descending order with running class counts and class totals.

    Columns: ``*group_cols, score, pos, neg, cum_pos, cum_neg, total_pos,
    total_neg`` where ``cum_*`` counts rows with a score >= this one (per group).
    """
    counts = score_counts(df, score, label, group_cols)
    return running_sums(counts, "score", ["pos", "neg"], group_cols=group_cols, descending=True, totals=True,
                        materialize=True)


def stack_scores(df: DataFrame, score_cols: Mapping[str, str], label: str = "actual_label",
                 model_col: str = "model") -> DataFrame:
    """Wide score columns of several models -> long ``model, score, label`` (one scan for all)."""
    pairs = ", ".join(f"'{m}', CAST(`{c}` AS DOUBLE)" for m, c in score_cols.items())
    return df.selectExpr(f"`{label}`", f"stack({len(score_cols)}, {pairs}) AS (`{model_col}`, score)")


def roc_curve(df: DataFrame, score: str = "score", label: str = "actual_label") -> DataFrame:
    """M7: one ROC point per distinct score: ``threshold, tp, fp, tpr, fpr``."""
    c = cumulative(df, score, label)
    return c.select(F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    _ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
                    _ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "actual_label") -> DataFrame:
    """M7: one PR point per distinct score: ``threshold, precision, recall, f1`` (F1 with ε = 1e-8)."""
    c = cumulative(df, score, label)
    prec = _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    rec = _ratio(F.col("cum_pos"), F.col("total_pos"))
    return c.select(F.col("score").alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                    (2 * prec * rec / (prec + rec + F.lit(F1_EPS))).alias("f1"))


def curve_summary(df: DataFrame, score: str = "score", label: str = "actual_label",
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """M3, M5, M6, M12 in one aggregate per group: ``roc_auc, gini, average_precision, ks``."""
    c = cumulative(df, score, label, group_cols)
    p, n = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    # positives above this score plus half of the tied ones, for every negative at this score
    auc_term = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    ap_term = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ks_term = _ratio(F.col("cum_pos"), F.col("total_pos")) - _ratio(F.col("cum_neg"), F.col("total_neg"))
    aggs = [F.try_divide(F.sum(auc_term), F.max(p) * F.max(n)).alias("roc_auc"),
            F.try_divide(F.sum(ap_term), F.max(p)).alias("average_precision"),
            F.greatest(F.max(ks_term), F.lit(0.0)).alias("ks")]
    agg = c.groupBy(*group_cols).agg(*aggs) if group_cols else c.agg(*aggs)
    return agg.select(*group_cols, "roc_auc", (2 * F.col("roc_auc") - 1).alias("gini"), "average_precision", "ks")


def ks_cumulative(df: DataFrame, score: str = "score", label: str = "actual_label") -> DataFrame:
    """Max |cum_bad - cum_good| over descending scores (per distinct score, so ties are
    resolved deterministically)."""
    c = cumulative(df, score, label)
    gap = F.abs(_ratio(F.col("cum_pos"), F.col("total_pos")) - _ratio(F.col("cum_neg"), F.col("total_neg")))
    return c.agg(F.max(gap).alias("ks"))


def cum_gain(df: DataFrame, score: str = "score", label: str = "actual_label") -> DataFrame:
    """Cumulative shares of bad (label 1) and good (label 0) rows by descending score."""
    c = cumulative(df, score, label)
    return c.select("score", "pos", "neg",
                    _ratio(F.col("cum_pos"), F.col("total_pos")).alias("cum_bad"),
                    _ratio(F.col("cum_neg"), F.col("total_neg")).alias("cum_good"))


def best_f1_threshold(df: DataFrame, score: str = "score", label: str = "actual_label") -> DataFrame:
    """M8: the PR-curve threshold with the largest F1 (first maximum in ascending threshold order)."""
    pr = pr_curve(df, score, label)
    best = pr.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                           F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select("b.threshold", "b.precision", "b.recall", "b.f1")


# --------------------------------------------------------------------------
# threshold grids on binned counts
# --------------------------------------------------------------------------

def grid_counts(df: DataFrame, grid: Sequence[float], score: str = "score",
                label: str = "actual_label") -> DataFrame:
    """Confusion counts at every grid threshold (predicted positive iff score >= t).

    Raw scores are binned by the grid (``Bucketizer``, a binary search in the JVM) and summed per bin, so at most
    len(grid) + 1 rows leave a task; suffix sums over that tiny table give the counts.  Rows without a score are left
    out.  Returns ``k, threshold, tn, fp, fn, tp`` for k = 0 … len(grid) - 1.
    """
    y = F.col(label).cast("bigint")
    scored = df.select(F.col(score).cast("double").alias("score"), y.alias("y")).where(
        F.col("score").isNotNull() & ~F.isnan("score"))
    splits = [float("-inf")] + list(grid) + [float("inf")]
    binned = Bucketizer(splits=splits, inputCol="score", outputCol="bin").transform(scored)
    per_bin = binned.groupBy(F.col("bin").cast("int").alias("bin")).agg(
        F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    rows = per_bin.collect()  # at most len(grid) + 1
    per_bin = df.sparkSession.createDataFrame([tuple(r) for r in rows], "bin int, pos long, neg long")
    spark = df.sparkSession
    grid_df = spark.createDataFrame([(k, float(t)) for k, t in enumerate(grid)], "k int, threshold double")
    # bin b holds scores in [grid[b-1], grid[b]); threshold k predicts positive for bins >= k + 1
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total_pos, total_neg = sum(r["pos"] or 0 for r in rows), sum(r["neg"] or 0 for r in rows)
    joined = (grid_df.join(F.broadcast(per_bin.withColumn("k", F.col("bin") - 1)), "k", "left")
              .select("k", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"),
                      F.coalesce("neg", F.lit(0)).alias("neg")))
    sums = joined.select("k", "threshold", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    return sums.select("k", "threshold",
                       (F.lit(total_neg) - F.col("fp")).cast("bigint").alias("tn"), F.col("fp").cast("bigint").alias("fp"),
                       (F.lit(total_pos) - F.col("tp")).cast("bigint").alias("fn"), F.col("tp").cast("bigint").alias("tp"))


def grid_threshold(df: DataFrame, metric: str | Sequence[str] = "f1", score: str = "score",
                   label: str = "actual_label", grid: Sequence[float] = GRID) -> DataFrame:
    """M9: the grid threshold (0.10 … 0.85) that maximises each metric (first maximum).

    One row per metric: ``metric, threshold, value``; all metrics come from a
    single pass of grid counts.
    """
    wanted = [metric] if isinstance(metric, str) else list(metric)
    if unknown := [m for m in wanted if m not in GRID_METRICS]:
        raise ValueError(f"unknown metrics {unknown}; one of {GRID_METRICS}")
    g = grid_counts(df, grid, score, label)
    m = g.select("k", "threshold", *metric_columns(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))
    best = m.agg(*[F.max_by(F.struct("threshold", F.col(x).alias("value")),
                            F.struct(F.col(x), -F.col("k"))).alias(f"b{i}") for i, x in enumerate(wanted)])
    stack = ", ".join(f"'{x}', b{i}.threshold, b{i}.value" for i, x in enumerate(wanted))
    return best.selectExpr(f"stack({len(wanted)}, {stack}) AS (metric, threshold, value)")


def cost_threshold(df: DataFrame, benefit_good: float, loss_bad: float, score: str = "score",
                   label: str = "actual_label", grid: Sequence[float] = COST_GRID) -> DataFrame:
    """Threshold minimising ``fp * benefit_good + fn * loss_bad`` on a 1000-point grid
    (first minimum)."""
    g = grid_counts(df, grid, score, label)
    cost = F.col("fp") * F.lit(float(benefit_good)) + F.col("fn") * F.lit(float(loss_bad))
    best = g.agg(F.min_by(F.struct("threshold", cost.alias("cost"), "tn", "fp", "fn", "tp"),
                          F.struct(cost, F.col("k"))).alias("b"))
    return best.select("b.threshold", "b.cost", "b.tn", "b.fp", "b.fn", "b.tp")


# --------------------------------------------------------------------------
# model comparison, histogram, focal loss
# --------------------------------------------------------------------------

def compare_models(tables: Mapping[str, DataFrame] | DataFrame, threshold: float = 0.5, primary: str = "pr_auc",
                   score: str = "score", label: str = "actual_label", model_col: str = "model") -> DataFrame:
    """One row per model (accuracy, precision, recall, F1 at ``threshold``, ROC AUC,
    PR AUC, KS) plus ``is_best`` (max of the primary metric, first model wins ties).

    ``tables`` is either ``{model: score table}`` or one long table with a
    ``model`` column; all models go through one pipeline grouped by model.
    """
    if isinstance(tables, DataFrame):
        long = tables
        names = long.select(model_col).distinct().orderBy(model_col)
        order = [r[0] for r in bounded_collect(names, MAX_MODELS, "models")]
    else:
        order = list(tables)
        long = None
        for name, t in tables.items():
            part = t.select(F.lit(name).alias(model_col), F.col(score).alias("score"), F.col(label).alias(label))
            long = part if long is None else long.unionByName(part)
        score = "score"
    y, hit = F.col(label).cast("int"), (F.col(score) >= F.lit(threshold))
    cm = long.groupBy(model_col).agg(
        F.count_if((y == 0) & ~hit).cast("bigint").alias("tn"), F.count_if((y == 0) & hit).cast("bigint").alias("fp"),
        F.count_if((y == 1) & ~hit).cast("bigint").alias("fn"), F.count_if((y == 1) & hit).cast("bigint").alias("tp"))
    lm = cm.select(model_col, *metric_columns(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))
    cs = curve_summary(long, score, label, [model_col])
    rank = F.create_map(*[x for i, m in enumerate(order) for x in (F.lit(m), F.lit(i))])
    rows = (lm.join(cs, model_col)
            .select(model_col, "accuracy", "precision", "recall", "f1", "roc_auc",
                    F.col("average_precision").alias("pr_auc"), "ks", rank[F.col(model_col)].alias("_i")))
    # one row per model: the best name comes back as a literal from a 1-row aggregate
    best = rows.agg(F.max_by(model_col, F.struct(F.col(primary), -F.col("_i")))).first()[0]
    return rows.withColumn("is_best", (F.col(model_col) == F.lit(best)).cast("int")).drop("_i")


def score_histogram(df: DataFrame, score: str = "score", bins: int = 50) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed), all bins listed."""
    mm = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return grid.select("bin", F.lit(None).cast("double").alias("lower"),
                           F.lit(None).cast("double").alias("upper"), F.lit(0).cast("bigint").alias("count"))
    lo, hi = float(lo), float(hi)
    width = (hi - lo) / bins
    s = F.col(score).cast("double")
    b = (F.least(F.floor((s - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
         if hi > lo else F.lit(0))
    counts = df.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def focal_loss(df: DataFrame, gamma: float = 2.0, alpha: float = 0.25, score: str = "score",
               label: str = "actual_label", eps: float = 1e-7) -> DataFrame:
    """mean binary focal loss of the scores (p clipped to [eps, 1 - eps])."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    loss_pos = -F.lit(alpha) * F.pow(1 - p, gamma) * F.log(p)
    loss_neg = -F.lit(1 - alpha) * F.pow(p, gamma) * F.log(1 - p)
    return df.agg(F.avg(y * loss_pos + (1 - y) * loss_neg).alias("focal_loss"),
                  F.count(F.lit(1)).alias("n"))


def two_stage_bands(df: DataFrame, stage1: str, stage2: str, stage1_threshold: float, approve_below: float,
                    reject_from: float, label: str = "actual_label") -> DataFrame:
    """A high-recall stage flags cases, a high-precision stage grades the flagged ones.

    Unflagged cases are approved at stage 1; flagged ones are approved below
    ``approve_below``, limited below ``reject_from`` and rejected from there.
    Returns ``band, n, n_bad, bad_rate`` per band.
    """
    flagged = F.col(stage1) >= F.lit(stage1_threshold)
    band = (F.when(~flagged, F.lit("approve_stage1"))
            .when(F.col(stage2) < F.lit(approve_below), F.lit("approve"))
            .when(F.col(stage2) < F.lit(reject_from), F.lit("limit"))
            .otherwise(F.lit("reject")))
    return (df.groupBy(band.alias("band"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_bad"))
            .select("band", "n", "n_bad", (F.col("n_bad") / F.col("n")).alias("bad_rate")))
