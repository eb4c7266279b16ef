"""Sampling, splitting and resampling of labelled tables.

Randomness is ``u(id, seed)`` (md5 of the id and the seed), a function of the
id alone: samples do not depend on partitioning, task retries or executor
loss, and every sample has a SQL twin.  Exact counts come from global ranks
(``operators.ordered``), never from a window over a whole class.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskroll.functions.exprs import hash_uniform
from riskroll.operators.ordered import bounded_collect, global_rank

# Fixed values
SEED = 42
U = "_u"
MAX_CLASSES = 1000  # most classes a label may have for the per-class operators


def _with_u(df: DataFrame, key: str, seed) -> DataFrame:
    return df.withColumn(U, hash_uniform(key, seed))


def class_counts(df: DataFrame, label: str = "target") -> dict:
    """Rows per class (one small aggregate, one row per class, at most ``MAX_CLASSES``); null is no class."""
    rows = bounded_collect(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")), MAX_CLASSES, f"classes of {label}")
    return {r[label]: r["n"] for r in rows}


def _cuts(df: DataFrame, limits: dict, label: str | None, key: str, seed) -> dict:
    """Per class, (u, key) of its ``limits[c]``-th row in (u, key) order: only these slim columns are ranked, and one
    row per class reaches the driver."""
    groups = [label] if label is not None else []
    slim = _with_u(df.select(key, *groups), key, seed)
    ranked = global_rank(slim, U, [key], group_cols=groups, name="_pos")
    wanted = reduce(lambda a, b: a | b, [
        ((F.col(label) == F.lit(c)) if groups else F.lit(True)) & (F.col("_pos") == F.lit(int(n)))
        for c, n in limits.items() if n > 0], F.lit(False))
    rows = bounded_collect(ranked.where(wanted), MAX_CLASSES, "classes")
    return {(r[label] if groups else None): (r[U], r[key]) for r in rows}


def _up_to(cut: tuple | None, key: str) -> Column:
    """Rows not after ``cut`` in (u, key) order; none without one."""
    if cut is None:
        return F.lit(False)
    return (F.col(U) < F.lit(cut[0])) | ((F.col(U) == F.lit(cut[0])) & (F.col(key) <= F.lit(cut[1])))


def _chosen(cuts: dict, label: str, key: str) -> Column:
    return reduce(lambda a, b: a | b, [(F.col(label) == F.lit(c)) & _up_to(cut, key) for c, cut in cuts.items()], F.lit(False))


def sample_n(df: DataFrame, n: int, key: str = "case_id", seed=SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement: the ``n`` smallest ``(u, key)``; raises if there are fewer."""
    have = df.count()
    if n > have:
        raise ValueError(f"a sample of {n} rows from {have}")
    cut = _cuts(df, {None: n}, None, key, seed).get(None)
    return _with_u(df, key, seed).where(_up_to(cut, key)).drop(U)


def sample_per_class(df: DataFrame, counts: dict, label: str = "target", key: str = "case_id",
                     seed=SEED) -> DataFrame:
    """Exactly ``counts[c]`` rows of every class ``c`` (classes absent from ``counts`` keep none); raises if a class
    has fewer.  Rows are kept by comparison with the class's last (u, key): no window or shuffle of whole rows."""
    have = class_counts(df, label)
    for c, n in counts.items():
        if n > have.get(c, 0):
            raise ValueError(f"a sample of {n} rows from the {have.get(c, 0)} of class {c!r}")
    cuts = _cuts(df, counts, label, key, seed)
    return _with_u(df, key, seed).where(_chosen(cuts, label, key)).drop(U)


def holdout_split(df: DataFrame, n_test: int, n_pos: int, label: str = "target", key: str = "case_id",
                  seed=SEED) -> DataFrame:
    """R2 + J5 + U1: ``n_pos`` positives and ``n_test - n_pos`` negatives form the test set,
    every other row is train.  Returns the input with ``split`` in {'test', 'train'}."""
    counts = {1: n_pos, 0: n_test - n_pos}
    have = class_counts(df, label)
    for c, n in counts.items():
        if n > have.get(c, 0):
            raise ValueError(f"a test set with {n} rows of class {c!r}, which has {have.get(c, 0)}")
    cuts = _cuts(df, counts, label, key, seed)
    is_test = F.coalesce(_chosen(cuts, label, key), F.lit(False))
    return _with_u(df, key, seed).withColumn("split", F.when(is_test, "test").otherwise("train")).drop(U)


def stratified_split(df: DataFrame, test_size: float = 0.2, label: str = "target", key: str = "case_id",
                     seed=SEED) -> DataFrame:
    """Per class, the ``ceil(test_size * n_class)`` smallest ``u`` go to validation.

    Adds ``is_valid`` (0/1).  Class sizes come from one small aggregate.  The
    ceiling puts at least one row of every non-empty class in validation, so
    the original's "re-split with the next seed when validation has no
    positive" never triggers.
    """
    limits = {c: math.ceil(test_size * n) for c, n in class_counts(df, label).items()}
    cuts = _cuts(df, limits, label, key, seed)
    return _with_u(df, key, seed).withColumn("is_valid", _chosen(cuts, label, key).cast("int")).drop(U)


def stratified_kfold(df: DataFrame, k: int = 5, label: str = "target", key: str = "case_id",
                     seed=SEED) -> DataFrame:
    """``fold = (rank of u within the class - 1) mod k``: class shares equal in every fold."""
    slim = _with_u(df.select(key, label), key, seed)
    ranked = global_rank(slim, U, [key], group_cols=[label], name="_pos")
    folds = ranked.select(key, ((F.col("_pos") - 1) % k).cast("int").alias("fold"))
    return df.join(folds, key)


def undersample(df: DataFrame, ratio: float, label: str = "target", key: str = "case_id",
                seed=SEED) -> DataFrame:
    """Keep every minority row and ``floor(n_min / ratio)`` majority rows; rows without a label stay as they are."""
    counts = class_counts(df, label)
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c if isinstance(c, (int, float)) else 0))
    keep = {minority: counts[minority], majority: min(counts[majority], int(counts[minority] / ratio))}
    for c in counts:
        keep.setdefault(c, counts[c])
    return sample_per_class(df, keep, label, key, seed).unionByName(df.where(F.col(label).isNull()))


def permute_labels(df: DataFrame, label: str = "target", key: str = "case_id", seed=SEED,
                   name: str = "permuted_target") -> DataFrame:
    """A seeded permutation of the label against the rows.

    Row at position ``p`` in key order receives the label of the row at position ``p`` in ``(u, key)`` order.  Only
    (key, label) is ranked; other columns come back by the key (unique, of any type).  Key order is numeric for
    numbers; other keys are ordered by their hash, which is as good for a permutation.
    """
    slim = df.select(key, label)
    numeric = isinstance(df.schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType))
    by_key = global_rank(slim, key, [key], name="_p") if numeric else global_rank(
        slim.withColumn("_h", hash_uniform(key, f"{seed}-order")), "_h", [key], name="_p").drop("_h")
    by_u = global_rank(_with_u(slim, key, seed), U, [key], name="_p")
    permuted = by_key.select(key, "_p").join(by_u.select("_p", F.col(label).alias(name)), "_p").drop("_p")
    return df.join(permuted, key)


def shuffle_rows(df: DataFrame, key: str = "case_id", seed=SEED) -> DataFrame:
    """A seeded row order for a sink (``orderBy(u, key)``); a DataFrame has no order
    otherwise, so this only matters where rows are written out."""
    return _with_u(df, key, seed).orderBy(U, key).drop(U)
