"""Staged scores, patience, prefixes and split counts of boosted trees."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskroll.operators import boosting as bo, metrics as me


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(6)
    n = 500
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.8 * rng.normal(size=n) > 0.8).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i, :2]), None if i % 9 == 0 else float(x[i, 2]), "abc"[i % 3], int(i % 4 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "case_id long, target int, x1 double, x2 double, x3 double, c string, is_valid int")
    m = bo.matrix(df.withColumn("weight", F.lit(1.0)), ["x1", "x2", "x3"], ["case_id", "target", "is_valid", "weight"], ["c"])
    return df, m, m.rows.where("is_valid = 0"), m.rows.where("is_valid = 1")


def fitted(train, rounds, **kw):
    return bo.boosted_estimator(bo.GBTParams(max_depth=3, step_size=0.3, **kw), rounds, 64, "target", "weight").fit(
        train.withColumn("target", F.col("target").cast("double")))


def margins(model, rows):
    return sorted((r[0], round(r[1], 9)) for r in model.transform(rows).select(
        F.col("target"), vector_to_array("rawPrediction")[1]).collect())


def test_staged_scores_are_those_of_the_prefixes(made):
    _, _, train, valid = made
    model = fitted(train, 8)
    staged = bo.staged_scores(model, valid).collect()
    for rounds in (1, 3, 8):
        cut = bo.prefix(model, rounds)
        assert cut.getNumTrees == rounds
        assert sorted((r["actual_label"], round(r["score"], 9)) for r in staged if r["round"] == rounds) == margins(cut, valid)
        assert margins(cut, valid) == margins(fitted(train, rounds), valid)  # a shorter fit is a prefix of a longer one
        scored = cut.transform(valid).select(vector_to_array("probability")[1].alias("score"), F.col("target").alias("actual_label"))
        auc = bo.staged_metric(model, valid)[rounds - 1]
        assert auc == pytest.approx(me.curve_summary(scored).first()["roc_auc"])


def test_patience():
    assert bo.best_round([0.5, 0.7, 0.7, 0.6, 0.9, 0.1], 3) == (5, False)
    assert bo.best_round([0.5, 0.7, 0.7, 0.6, 0.9, 0.1], 2) == (2, True)
    assert bo.best_round([0.5], 1) == (1, False)


def test_growth_ends_by_patience_or_by_rounds(made, spark):
    df, _, _, _ = made
    params = bo.GBTParams(max_iter=400, max_depth=4, step_size=0.3, patience=15)
    grown = bo.fit_boosted(df, ["x1", "x2", "x3"], params, categorical=["c"])
    assert grown.stopped and grown.best_round + 15 <= grown.trees_built < 400
    assert grown.model.getNumTrees == grown.best_round == grown.values.index(max(grown.values[:grown.best_round + 15])) + 1
    noise = df.withColumn("target", F.pmod(F.xxhash64("case_id"), F.lit(2)).cast("int"))
    lost = bo.fit_boosted(noise, ["x1", "x2", "x3"], params)
    assert lost.stopped and 0.3 < lost.values[-1] < 0.7
    short = bo.fit_boosted(df, ["x1", "x2"], bo.GBTParams(max_iter=12, max_depth=2, patience=100))
    assert not short.stopped and short.trees_built == 12
    path = bo.shared_folder(spark, "model-test")
    grown.pipeline().write().save(path)
    from riskroll.operators import models as mo
    scores = mo.batch_score(mo.load_model(path), df, 0.5)
    assert scores.count() == 500 and me.curve_summary(scores).first()["roc_auc"] > 0.85


def test_split_counts_of_a_known_tree(spark):
    # one tree splits on a at 0.5, then on b in one half only
    rows = [(i, a, b, (a and b)) for i in range(40) for a in (0, 1) for b in (0, 1)]
    df = spark.createDataFrame([(i, float(a), float(b), float(i % 5), int(t)) for i, a, b, t in rows],
                               "case_id long, a double, b double, noise double, target int")
    m = bo.matrix(df.withColumn("weight", F.lit(1.0)), ["a", "b", "noise"], ["target", "weight"])
    model = fitted(m.rows, 1)
    assert {r["feature"]: r["importance"] for r in bo.split_counts(model, m.names, spark).collect()} == {"a": 1, "b": 1, "noise": 0}
    nodes = bo.tree_nodes(model, spark).orderBy("node").collect()
    assert [r["is_leaf"] for r in nodes].count(True) == 3 and sorted(r["leaf"] for r in nodes if r["is_leaf"]) == [0, 1, 2]


def test_nulls_can_be_split_off(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 7), int(i % 4 == 0), int(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "case_id long, x double, target int, is_valid int")
    grown = bo.fit_boosted(df, ["x"], bo.GBTParams(max_iter=3, max_depth=2))
    assert grown.values[0] == 1.0


def test_draws_that_differ_in_rounds_share_a_fit(made, monkeypatch):
    _, m, _, _ = made
    rows = m.rows.withColumn("fold", F.pmod("case_id", F.lit(2)).cast("int"))
    fits = []
    grow = bo.grow
    monkeypatch.setattr(bo, "grow", lambda *a, **k: fits.append(1) or grow(*a, **k))
    base = bo.GBTParams(max_iter=4, max_depth=2, step_size=0.3)
    found = bo.search(rows, [base, bo.replace(base, max_iter=12), bo.replace(base, max_depth=3)], 2)
    assert len(fits) == 4 and found[1]["score"] >= found[0]["score"] > 0.4
    assert len(set(bo.draw(15))) == 15 and bo.draw(15) == bo.draw(15)


def test_many_trees_are_grown_as_small_forests(made, spark, monkeypatch):
    _, m, _, _ = made
    forest, asked = bo.RandomForestClassifier, []
    monkeypatch.setattr(bo, "RandomForestClassifier", lambda **kw: asked.append((kw["numTrees"], kw["seed"])) or forest(**kw))
    monkeypatch.setattr(bo, "FOREST_TREES", 4)
    counts = bo.forest_split_counts(m.rows, m.names, "target", 10, 3, m.max_bins)
    assert sorted(n for n, _ in asked) == [2, 4, 4] and len({s for _, s in asked}) == 3
    alone = {f: 0 for f in m.names}
    for n, seed in list(asked):
        for f, c in bo.forest_split_counts(m.rows, m.names, "target", n, 3, m.max_bins, seed).items():
            alone[f] += c
    assert counts == alone and counts["x1"] > 0
