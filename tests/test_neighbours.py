"""Exact neighbours against all pairs; ADASYN against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskroll.operators import neighbours as nb


def frame(spark, ids, xs):
    return spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, xs)], "id long, x array<double>")


def brute(ids, xs, qids, qxs, k):
    d2 = nb.squared(np.array(qxs, dtype=float), np.array(xs, dtype=float))
    out = {}
    for q, row in zip(qids, d2):
        order = sorted((d, i) for d, i in zip(row, ids) if i != q)[:k]
        for rank, (d, i) in enumerate(order, 1):
            out[(q, rank)] = (i, d)
    return out


def check(spark, ids, xs, qids, qxs, k=5):
    got = {(r["query"], r["rank"]): (r["neighbour"], r["distance2"]) for r in nb.nearest(
        frame(spark, ids, xs), frame(spark, qids, qxs), k).collect()}
    assert got == brute(ids, xs, qids, qxs, k)


@pytest.mark.parametrize("kind", ["uniform", "clusters", "scales", "copies", "grid"])
def test_nearest_equals_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(nb, "BLOCK", 32)
    monkeypatch.setattr(nb, "_SHIFT", 5)
    monkeypatch.setattr(nb, "QUERIES_A_TASK", 40)
    rng = np.random.default_rng(4)
    n, d = 900, 6
    xs = {"uniform": rng.random((n, d)), "clusters": rng.normal(size=(n, d)) * 0.01 + rng.integers(0, 4, (n, 1)) * 10,
          "scales": rng.lognormal(0, 3, (n, d)) * np.array([1, 1e6, 1e-3, 1, 50, 0]),
          "copies": np.where(np.arange(n)[:, None] % 3 == 0, 0.5, rng.random((n, d))),
          "grid": rng.integers(0, 4, (n, d)).astype(float)}[kind]
    ids = rng.permutation(n)
    wanted = rng.choice(n, 250, replace=False)
    check(spark, ids, xs, ids[wanted], xs[wanted])
    check(spark, ids, xs, [10_000 + i for i in range(20)], rng.random((20, d)) * xs.max())  # queries that aren't points


@pytest.mark.parametrize("kind", ["uniform", "far", "copies", "huge", "infinite"])
def test_block_measures_only_what_can_be_near(kind):
    rng = np.random.default_rng(5)
    points = {"uniform": rng.random((500, 7)) * 1e5, "far": 1e9 + rng.random((500, 7)), "copies": rng.integers(0, 2, (500, 7)) * 1.5,
              "huge": rng.random((500, 7)) * 1e160, "infinite": np.where(rng.random((500, 7)) < 0.01, np.inf, rng.random((500, 7)))}[kind]
    ids = rng.permutation(500)
    with np.errstate(all="ignore"):
        got = nb._top(ids[:60], points[:60], ids, points, 5).to_pydict()
        d2 = nb.squared(points[:60], points)
        row, _ = nb._candidates(points[:60], points, 5)
    want = [(int(ids[q]), int(i), d) for q in range(60) for d, i in sorted(
        (d, i) for d, i in zip(d2[q], ids) if i != ids[q] and np.isfinite(d))[:5]]
    assert list(zip(got["query"], got["neighbour"], got["distance2"])) == want
    assert kind != "uniform" or len(row) < 60 * 8


def test_few_points(spark):
    xs = np.array([[0.0], [1.0], [1.0], [5.0]])
    check(spark, range(4), xs, range(4), xs)
    check(spark, range(4), xs, range(4), xs, k=2)
    assert nb.nearest(frame(spark, [], []), frame(spark, [1], [[2.0]]), 3).collect() == []


def labelled(spark, n=400):
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.15).astype(int)
    xs = rng.normal(size=(n, 3)) + y[:, None]
    rows = [(int(i), int(y[i]), float(xs[i, 0]), float(xs[i, 1]), None if i % 50 == 0 else float(xs[i, 2])) for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, target int, a double, b double, c double"), y, np.where(
        (np.arange(n) % 50 == 0)[:, None] & (np.arange(3) == 2)[None, :], 0.0, xs)


def test_adasyn_density_and_rows(spark):
    df, y, xs = labelled(spark)
    ids = np.arange(len(y))
    minority = ids[y == 1]
    near = brute(ids, xs, minority, xs[minority], 5)
    majority = {int(q): sum(y[near[(q, r)][0]] == 0 for r in range(1, 6)) for q in minority}
    wanted = int((y == 0).sum() * 0.5 - (y == 1).sum())
    total = sum(majority.values())
    got = {r["case_id"]: r for r in nb.adasyn_density(df, ["a", "b", "c"]).collect()}
    assert {q: r["majority"] for q, r in got.items()} == majority
    assert all(r["share"] == r["majority"] / 5 for r in got.values())
    assert {q: r["copies"] for q, r in got.items()} == {q: int(np.rint(m * wanted / total)) for q, m in majority.items()}
    own = brute(minority, xs[minority], minority, xs[minority], 5)
    made = nb.adasyn_rows(df, ["a", "b", "c"]).collect()
    assert len(made) == sum(r["copies"] for r in got.values()) and abs(len(made) - wanted) <= len(minority)
    for r in made:
        assert r["neighbour"] in {own[(r["case_id"], i)][0] for i in range(1, 6)}
        x, z = xs[r["case_id"]], xs[r["neighbour"]]
        step = (np.array([r["a"], r["b"], r["c"]]) - x) / np.where(z == x, 1, z - x)
        assert np.allclose(step[z != x], step[z != x][0], atol=1e-6) and 0 <= step[z != x][0] < 1
    whole = nb.adasyn(df, ["a", "b", "c"])
    assert whole.count() == len(y) + len(made) and whole.where(F.col("case_id").isNull() & (F.col("target") == 1)).count() == len(made)


def test_adasyn_without_majority_neighbours(spark):
    rows = [(i, int(i < 8), float(i < 8) * 1000 + i * 0.001) for i in range(60)]
    df = spark.createDataFrame(rows, "case_id long, target int, a double")
    assert {r["copies"] for r in nb.adasyn_density(df, ["a"]).collect()} == {0}
    assert nb.adasyn_rows(df, ["a"]).collect() == []
    assert nb.adasyn(df, ["a"]).count() == 60
