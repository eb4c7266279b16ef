"""Model pipelines: planted signal, save / load, lasso against coordinate descent."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskroll.operators import metrics as me, models as mo


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    n = 600
    x1 = rng.normal(size=n)
    x2 = rng.normal(size=n)
    noise = rng.normal(size=n)
    y = (x1 + 0.3 * rng.normal(size=n) > 1.0).astype(int)
    rows = [(i, int(y[i]), float(x1[i]), float(x2[i]), float(noise[i]), i % 5 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id long, target int, x1 double, x2 double, noise double, v boolean")
    return df, ["x1", "x2", "noise"]


def test_gbt_finds_planted_signal_and_roundtrips(planted, spark):
    df, feats = planted
    train, valid = df.where(~F.col("v")), df.where(F.col("v"))
    model = mo.fit_gbt(train, feats, mo.GBTParams(max_iter=10, max_depth=3, step_size=0.3))
    scores = mo.batch_score(model, valid, 0.5)
    auc = me.curve_summary(scores).first()["roc_auc"]
    assert auc > 0.8
    path = tempfile.mkdtemp(prefix="riskroll-model-", dir="/tmp") + "/m"
    mo.save_model(model, path)
    again = mo.batch_score(mo.load_model(path), valid, 0.5)
    a = {r["case_id"]: r["score"] for r in scores.collect()}
    b = {r["case_id"]: r["score"] for r in again.collect()}
    assert a == b
    imp = {r["feature"]: r["importance"] for r in mo.gbt_importances(model, feats, spark).collect()}
    assert set(imp) == set(feats) and imp["x1"] > 0 and sum(imp.values()) <= 10 * 7


def coordinate_descent(X, y, alpha, iters=2000):
    n, p = X.shape
    w = np.zeros(p)
    b = y.mean()
    for _ in range(iters):
        for j in range(p):
            r = y - b - X @ w + X[:, j] * w[j]
            rho = X[:, j] @ r / n
            z = X[:, j] @ X[:, j] / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / z
        b = (y - X @ w).mean()
    return w


def test_lasso_matches_coordinate_descent(planted):
    df, feats = planted
    res = mo.fit_lasso(df, feats, alpha=0.01)
    pdf = df.select("target", *feats).toPandas()
    X = pdf[feats].to_numpy()
    X = (X - X.mean(0)) / X.std(0)
    w = coordinate_descent(X, pdf["target"].to_numpy().astype(float), 0.01)
    for f, expected in zip(feats, w):
        assert res.coefficients[f] == pytest.approx(expected, abs=1e-9)
    assert "x1" in res.selected


def test_noise_model_is_near_chance(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.random() < 0.3), float(rng.normal()), i % 3 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "case_id long, target int, z double, v boolean")
    model = mo.fit_gbt(df.where(~F.col("v")), ["z"], mo.GBTParams(max_iter=5, max_depth=2))
    auc = me.curve_summary(mo.batch_score(model, df.where(F.col("v")), 0.5)).first()["roc_auc"]
    assert 0.35 < auc < 0.65


def test_adversarial_auc_exact_and_sketch(spark):
    from riskroll.operators import selection

    rng = np.random.default_rng(5)
    rows = [(int(w), float(w + rng.normal() * 20), float(rng.normal())) for w in rng.integers(0, 92, 2000)]
    df = spark.createDataFrame(rows, "WEEK_NUM int, drift double, noise double")
    exact = {r["feature"]: r["auc"] for r in selection.adversarial_auc(df, ["drift", "noise"], bins=32).collect()}
    sketch = {r["feature"]: r["auc"]
              for r in selection.adversarial_auc(df, ["drift", "noise"], bins=32, exact_bins=False).collect()}
    assert exact["drift"] > 0.9 and sketch["drift"] > 0.9
    assert exact["noise"] < exact["drift"] and sketch["noise"] < sketch["drift"]
    assert abs(exact["drift"] - sketch["drift"]) < 0.05


def test_random_search(planted):
    df, feats = planted
    out = mo.random_search(df, feats, n_draws=2, k=2, patience=5).collect()
    assert len(out) == 2 and sum(r["is_best"] for r in out) == 1 and all(r["trees_built"] >= 10 for r in out)
    best = max(out, key=lambda r: (r["mean_pr_auc"], -r["draw"]))
    assert best["is_best"] == 1 and best["mean_pr_auc"] > 0.3


def test_mlp_search(planted, monkeypatch):
    monkeypatch.setattr(mo, "MLP_LAYERS", [(4,), (3, 2)])
    df, feats = planted
    out = mo.mlp_search(df, feats, n_draws=5, k=3, folds=2).collect()
    assert len(out) == 5 and sum(r["is_best"] for r in out) == 1
    by = {}
    for r in out:
        by.setdefault((r["hidden"], r["max_iter"]), set()).add(r["mean_pr_auc"])
    assert all(len(v) == 1 for v in by.values())


def test_stack_has_one_probability_per_row_and_base(planted):
    df, feats = planted
    bases = {"gbt": mo.GBTParams(max_iter=6, max_depth=2), "mlp": mo.MLPParams((4,), 10)}
    train, test = df.where(~F.col("v")).drop("v"), df.where("v").drop("v")
    oof = mo.stack_oof(train, feats, bases, k=3).collect()
    assert sorted(r["case_id"] for r in oof) == sorted(r["case_id"] for r in train.collect())
    assert {r["fold"] for r in oof} == {0, 1, 2} and all(0 <= r["p_gbt"] <= 1 and 0 <= r["p_mlp"] <= 1 for r in oof)
    scores = mo.stack_score(train, test, feats, bases, k=3)
    assert scores.count() == test.count() and me.curve_summary(scores).first()["roc_auc"] > 0.8


def test_null_importance_and_topk(planted):
    from riskroll.operators import selection

    df, feats = planted
    rows = {r["feature"]: r for r in selection.null_importance(df, feats, trees=20).collect()}
    assert rows["x1"]["real_importance"] == int(rows["x1"]["real_importance"]) > 0
    assert rows["x1"]["score"] > rows["noise"]["score"]
    top = selection.importance_topk(df, feats, k=2, trees=20).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"] and "x1" in {r["feature"] for r in top}
