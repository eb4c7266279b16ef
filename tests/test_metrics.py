"""Metrics against brute force on small random tables, plus hand-made tie cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskroll.operators import metrics as me


def brute_auc(s, y):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = 0.0
    for p in pos:
        for n in neg:
            tot += 1.0 if p > n else 0.5 if p == n else 0.0
    return tot / (len(pos) * len(neg))


def brute_ap(s, y):
    order = sorted(set(s), reverse=True)
    P = sum(y)
    ap = 0.0
    for t in order:
        tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        pos_here = sum(1 for a, b in zip(s, y) if a == t and b == 1)
        ap += pos_here / P * tp / (tp + fp)
    return ap


def brute_ks(s, y):
    P, N = sum(y), len(y) - sum(y)
    best = 0.0
    for t in set(s):
        tpr = sum(1 for a, b in zip(s, y) if a >= t and b == 1) / P
        fpr = sum(1 for a, b in zip(s, y) if a >= t and b == 0) / N
        best = max(best, tpr - fpr)
    return best


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(400) < 0.2).astype(int)
    s = np.round(rng.random(400) * 0.6 + 0.3 * y, 2)          # rounded -> many ties
    rows = [(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))]
    return spark.createDataFrame(rows, "case_id long, score double, actual_label int"), list(s), list(y)


def test_curve_summary_matches_brute_force(table):
    df, s, y = table
    r = me.curve_summary(df).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(s, y), abs=1e-12)
    assert r["gini"] == pytest.approx(2 * brute_auc(s, y) - 1, abs=1e-12)
    assert r["average_precision"] == pytest.approx(brute_ap(s, y), abs=1e-12)
    assert r["ks"] == pytest.approx(brute_ks(s, y), abs=1e-12)


def test_auc_of_negated_score(table):
    df, s, y = table
    a = me.curve_summary(df).first()["roc_auc"]
    b = me.curve_summary(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)


def test_ranges_do_not_change_results(table):
    df, s, y = table
    from riskroll.operators.ordered import running_sums
    counts = me.score_counts(df)
    one = sorted(running_sums(counts, "score", ["pos"], descending=True, n_buckets=1).collect())
    many = sorted(running_sums(counts, "score", ["pos"], descending=True, n_buckets=17).collect())
    assert one == many


def test_label_auc_is_balanced_accuracy(table):
    df, s, y = table
    hard = df.select("actual_label", (F.col("score") >= 0.5).cast("int").alias("predicted_label"))
    auc = me.curve_summary(hard, score="predicted_label").first()["roc_auc"]
    bal = me.label_metrics(hard).first()["balanced_accuracy"]
    assert auc == pytest.approx(bal, abs=1e-12)


def test_confusion_and_label_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "actual_label int, predicted_label int")
    r = me.label_metrics(df).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 1, 1, 1)
    assert r["precision"] == 0.5 and r["recall"] == 0.5 and r["f1"] == 0.5 and r["accuracy"] == 0.6
    empty = spark.createDataFrame([(1, 0), (0, 0)], "actual_label int, predicted_label int")
    assert me.label_metrics(empty).first()["precision"] == 0.0       # empty denominator -> 0


def test_best_f1_threshold_tie_takes_smallest(spark):
    # thresholds 0.9 and 0.4 both give F1 = 2/3; the smaller one wins
    df = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.4, 0), (0.1, 1), (0.1, 0), (0.1, 0)],
                               "score double, actual_label int")
    pr = {r["threshold"]: r["f1"] for r in me.pr_curve(df).collect()}
    r = me.best_f1_threshold(df).first()
    assert r["f1"] == max(pr.values())
    assert r["threshold"] == min(t for t, f in pr.items() if f == r["f1"])


def test_grid_threshold_brute_force(table):
    df, s, y = table
    got = {r["metric"]: (r["threshold"], r["value"]) for r in me.grid_threshold(df, list(me.GRID_METRICS)).collect()}
    for metric in me.GRID_METRICS:
        best = None
        for t in me.GRID:
            tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
            fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
            fn = sum(1 for a, b in zip(s, y) if a < t and b == 1)
            tn = sum(1 for a, b in zip(s, y) if a < t and b == 0)
            prec = tp / (tp + fp) if tp + fp else 0.0
            rec = tp / (tp + fn) if tp + fn else 0.0
            val = {"f1": 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0,
                   "accuracy": (tp + tn) / len(s), "precision": prec, "recall": rec,
                   "balanced_accuracy": (rec + (tn / (tn + fp) if tn + fp else 0.0)) / 2}[metric]
            if best is None or val > best[1]:
                best = (t, val)
        assert got[metric][0] == best[0] and got[metric][1] == pytest.approx(best[1], abs=1e-12)


def test_cost_threshold_brute_force(table):
    df, s, y = table
    r = me.cost_threshold(df, benefit_good=0.3, loss_bad=1.7).first()
    costs = []
    for k, t in enumerate(me.COST_GRID):
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        fn = sum(1 for a, b in zip(s, y) if a < t and b == 1)
        costs.append((fp * 0.3 + fn * 1.7, k, t))
    best = min(costs)
    assert r["threshold"] == best[2] and r["cost"] == pytest.approx(best[0])


def test_ks_bounds_and_histogram(table, spark):
    df, s, y = table
    ks = me.ks_cumulative(df).first()["ks"]
    assert 0.0 <= ks <= 1.0
    h = me.score_histogram(df).collect()
    assert len(h) == 50 and sum(r["count"] for r in h) == len(s)


def test_compare_models_picks_best_pr_auc(table):
    df, s, y = table
    good = df
    bad = df.withColumn("score", -F.col("score"))
    out = {r["model"]: r for r in me.compare_models({"good": good, "bad": bad}).collect()}
    assert out["good"]["is_best"] == 1 and out["bad"]["is_best"] == 0
    assert out["good"]["roc_auc"] + out["bad"]["roc_auc"] == pytest.approx(1.0)


def test_focal_loss_by_hand(spark):
    df = spark.createDataFrame([(0.5, 1)], "score double, actual_label int")
    r = me.focal_loss(df).first()
    assert r["focal_loss"] == pytest.approx(0.25 * 0.25 * np.log(2))


def test_nan_scores_are_left_out_and_unknown_metrics_raise(spark):
    rows = [(0.2, 0), (0.9, 1), (float("nan"), 1), (None, 0), (0.7, 1)]
    df = spark.createDataFrame(rows, "score double, actual_label int")
    clean = df.where("score is not null and not isnan(score)")
    assert me.grid_threshold(df, "f1").collect() == me.grid_threshold(clean, "f1").collect()
    assert me.curve_summary(df).collect() == me.curve_summary(clean).collect()
    with pytest.raises(ValueError):
        me.grid_threshold(df, "f2")


def test_label_curve_equals_the_curve_over_two_scores(spark):
    for rows in ([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], [(1, 1), (0, 1)], [(0, 0), (0, 1)]):
        df = spark.createDataFrame(rows, "predicted_label int, actual_label int")
        got = me.label_curve(df).first()
        curve = me.curve_summary(df, score="predicted_label").first()
        assert got["label_auc"] == (None if curve["roc_auc"] is None else pytest.approx(curve["roc_auc"]))
        assert got["ks"] == pytest.approx(me.ks_cumulative(df, score="predicted_label").first()["ks"])
