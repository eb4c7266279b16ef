"""Whitening by block matrices against numpy over all rows."""

import numpy as np
import pytest

from riskroll.llm import whitening
from riskroll.llm.common import ship


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, block int")


def usable(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)


def brute(rows):
    """vec_id -> deviation, and the whitened rows, shares and size of the fit list."""
    kept = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) + 1_000_000) for i, v in rows if usable(v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, int((values > 1e-12 * values[0]).sum()))
    white = [(x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]) for _, x in kept]
    return kept, n, [int(((n * x - sums) ** 2).sum()) for _, x in kept], np.array(white), values[:k] / values.sum(), k


def check(spark, rows):
    kept, n, deviations, white, shares, k = brute(rows)
    got = whitening.report(frame(spark, rows)).collect()
    assert len(got) == len(kept) * k
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-6
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    signs = [None] * k
    for (i, _), d, w in zip(kept, deviations, white):
        for c in range(k):
            for r in by_id[(i, c + 1)]:
                assert r.explained == pytest.approx(shares[c], rel=1e-6)
            near = [r for r in by_id[(i, c + 1)] if r.deviation == d and abs(abs(r.whitened) - abs(w[c])) < 1e-6]
            assert near
            if abs(w[c]) > 1e-3 and len(by_id[(i, c + 1)]) == 1:
                sign = np.sign(w[c] * near[0].whitened)
                signs[c] = sign if signs[c] is None else signs[c]
                assert sign == signs[c]


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ np.diag(np.linspace(1, 3, d)) + 5).astype(np.float32).tolist()


def test_equals_numpy(spark):
    check(spark, list(enumerate(vectors(700, 24))))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    check(spark, list(enumerate(vectors(500, 6, 1))))


def test_odd_rows(spark):
    some = vectors(30, 5, 2)
    rows = list(enumerate(some)) + [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, []),
                                    (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, some[3]), (7, some[4]), (7, some[7]), (200, [0.0] * 5)]
    check(spark, rows + [(300 + i, some[0]) for i in range(200)])


def test_fewer_vectors_than_dimensions(spark):
    check(spark, list(enumerate(vectors(4, 9, 3))))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 3])
def test_nothing_to_whiten(spark, rows):
    df = whitening.report(frame(spark, rows))
    assert df.collect() == [] and df.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("rows", [[(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30]), (2, [1.0])]])
def test_refused(spark, rows):
    with pytest.raises(Exception, match="entries|2\\*\\*47"):
        whitening.report(frame(spark, rows)).collect()
