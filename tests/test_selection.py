"""Equal-frequency bins from exact ranks: against numpy, with ties, infinities, NaN and nulls, at forced refinement."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskroll.operators import selection

COLUMNS = {
    "normal": lambda rng, n: rng.normal(size=n),
    "tied": lambda rng, n: rng.integers(0, 7, n).astype(float),
    "outlier": lambda rng, n: np.where(np.arange(n) == 3, 1e300, rng.random(n)),
    "hot": lambda rng, n: np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n) * 1e-9),
    "neighbours": lambda rng, n: np.array([1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)])[rng.integers(0, 3, n)],
    "infinite": lambda rng, n: np.where(rng.random(n) < 0.1, np.inf, np.where(rng.random(n) < 0.1, -np.inf, rng.random(n))),
}


@pytest.mark.parametrize("group_values", [10_000, 3])
def test_cuts_are_exact_ranks(spark, monkeypatch, group_values):
    monkeypatch.setattr(selection, "GROUP_VALUES", group_values)
    monkeypatch.setattr(selection, "PROBE_SHARE", 0.01)
    rng, n, bins = np.random.default_rng(4), 3000, 31
    data = {c: make(rng, n) for c, make in COLUMNS.items()}
    rows = [tuple(None if i % 11 == 0 else float(data[c][i]) for c in COLUMNS) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*COLUMNS, "empty"])).repartition(4)
    got = selection.equal_frequency_cuts(df, [*COLUMNS, "empty"], bins)
    assert got["empty"] == []
    for c in COLUMNS:
        own = np.sort(np.array([data[c][i] for i in range(n) if i % 11]))
        ranks = {-(-b * len(own) // bins) for b in range(1, bins)}
        assert set(got[c]) == set(own[[r - 1 for r in ranks]]), c


def test_auc_by_bins_equals_counting(spark):
    """Bins as the share of values below, in ``bins``-ths, from the definition in plain Python."""
    rng, n, bins = np.random.default_rng(8), 900, 16
    week, x = rng.integers(0, 92, n), np.round(rng.normal(size=n), 1)
    rows = [(int(w), None if i % 13 == 0 else float("nan") if i % 17 == 0 else float(v)) for i, (w, v) in enumerate(zip(week, x))]
    df = spark.createDataFrame(rows, "WEEK_NUM int, x double")
    known = [v for _, v in rows if v is not None]

    def bin_of(v):
        if v is None:
            return -1
        below = sum(not math.isnan(u) and (math.isnan(v) or u < v) for u in known)
        return below * bins // len(known)

    groups = {}
    for w, v in rows:
        groups.setdefault(bin_of(v), []).append(w >= 65)
    scored = [(sum(g) / len(g), y) for g in groups.values() for y in g]
    late, early = [s for s, y in scored if y], [s for s, y in scored if not y]
    expected = sum((a > b) + (a == b) / 2 for a in late for b in early) / (len(late) * len(early))
    assert selection.adversarial_auc(df, ["x"], bins=bins).first()["auc"] == pytest.approx(expected, abs=1e-12)


def test_no_value_table_is_written(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *a, **k: pytest.fail("a table of values was written"))
    df = spark.range(500).select(F.col("id").alias("WEEK_NUM"), (F.col("id") % 37).alias("x"))
    assert selection.adversarial_auc(df, ["x"]).count() == 1
