"""HNSW: recall and order against brute force, and defined results."""

import numpy as np
import pytest

from riskroll.llm import hnsw
from riskroll.llm.common import ship


def brute_force(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        out[q] = sorted((-s, i) for s, i in zip(scores.tolist(), ids) if i != q)[:k]
    return out


@pytest.mark.parametrize("shard_points", [8192, 700])
def test_recall_on_the_given_vectors(spark, shard_points):
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = hnsw.usable(table)
    rows = {r.vec_id: r.vector for r in vectors.collect()}
    ids = sorted(rows)
    queries = [i for i in ids if i % 20 == 0]
    exact = brute_force(ids, np.array([rows[i] for i in ids]), queries, 20)
    got = {}
    for r in hnsw.search(hnsw.build(vectors, shard_points=shard_points), vectors.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in queries:
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert sorted((-s, i) for _, i, s in own) == [(-s, i) for _, i, s in own]
        hits += len({i for _, i, _ in own} & {i for _, i in exact[q]})
    assert hits >= 0.95 * 20 * len(queries)


def test_odd_vectors_and_ties(spark):
    ship(spark)
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5])] + [(i, [2.0, 1.0]) for i in range(100, 160)] + [(40, [5.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    vectors = hnsw.usable(df)
    got = {}
    for r in hnsw.search(hnsw.build(vectors), vectors.filter("vec_id % 20 = 0").dropDuplicates(["vec_id"])).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [i for _, i, _ in sorted(got[0])] == [40, *range(100, 119)]  # ties by the smaller id
    assert [i for _, i, _ in sorted(got[100])] == [40, *range(101, 120)]
    assert sorted(got) == [0, 20, 40, 100, 120, 140]
    few = hnsw.usable(df.filter("vec_id in (0, 20)"))
    assert [(r.query_id, r.vec_id, r.score) for r in hnsw.search(hnsw.build(few), few.filter("vec_id = 0")).collect()] == [(0, 20, 0.5)]
    none = hnsw.usable(df.limit(0))
    assert hnsw.search(hnsw.build(none), none).collect() == []


@pytest.mark.parametrize("spread", ["one of 1e4", "one of 1e25", "six orders", "two lengths", "lognormal"])
def test_recall_with_varied_norms(spread):
    rng = np.random.default_rng(4)
    n = 4000
    vectors = rng.normal(size=(n, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if spread.startswith("one of "):
        vectors[17] *= float(spread[7:])
    else:
        vectors *= {"six orders": 10 ** rng.uniform(-3, 3, n), "two lengths": np.where(np.arange(n) % 2, 1, 1000.0),
                    "lognormal": np.exp(rng.normal(size=n))}[spread][:, None]
    queries = rng.normal(size=(200, 32))
    exact = np.argsort(-queries @ vectors.T, axis=1)[:, :20]
    found = hnsw.Graph.build(vectors).search(queries)
    scores = np.where(found >= 0, np.einsum("qj,qij->qi", queries, vectors[np.maximum(found, 0)]), -np.inf)
    best = np.take_along_axis(found, np.argsort(-scores, axis=1)[:, :20], 1)
    hits = sum(len(set(a) & set(b)) for a, b in zip(best.tolist(), exact.tolist()))
    assert hits >= 0.95 * exact.size
