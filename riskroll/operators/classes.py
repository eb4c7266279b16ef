"""Class balance, weights, scaling and economic summaries.

Each of these is a one-row (or one-row-per-class) aggregate; fitted values
are collected as literals and applied in a single ``select``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskroll.operators.ordered import bounded_collect

# Fixed values
IMBALANCE_RATIO = 0.2
MAX_CLASSES = 1000  # most classes a label may have
MINMAX_EPS = 1e-6


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Per class ``n``, ``share`` and the three weightings of the original pipelines.

    ``weight_ratio``: n0 / n1 for the positive class, 1 for the negative one;
    ``weight_odds``: (1 - p) / p for the positive class (p = positive share);
    ``weight_balanced``: n / (k · n_c).
    """
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"),
                     F.sum(F.when(F.col("class") == 0, F.col("n")).otherwise(0)).alias("n0"),
                     F.sum(F.when(F.col("class") == 1, F.col("n")).otherwise(0)).alias("n1")).first()
    total, k, n0, n1 = int(tot["total"] or 0), int(tot["k"] or 0), int(tot["n0"] or 0), int(tot["n1"] or 0)
    share = F.col("n") / F.lit(float(total))
    pos_share = n1 / total if total else 0.0
    is_pos = F.col("class") == 1
    return counts.select(
        "class", F.col("n").cast("bigint").alias("n"), share.alias("share"),
        F.when(is_pos, F.lit(n0 / n1 if n1 else None)).otherwise(F.lit(1.0)).alias("weight_ratio"),
        F.when(is_pos, F.lit((1 - pos_share) / pos_share if pos_share else None)).otherwise(F.lit(1.0))
         .alias("weight_odds"),
        (F.lit(float(total)) / (F.lit(float(k)) * F.col("n"))).alias("weight_balanced"),
    )


def with_class_weight(df: DataFrame, label: str = "target", kind: str = "weight_balanced",
                      name: str = "weight", fit_on: DataFrame | None = None) -> DataFrame:
    """Attach a per-row weight column from ``class_weights`` of ``fit_on`` (``df`` if none is given); the class table
    is tiny: one row per class."""
    counted = class_weights(df if fit_on is None else fit_on, label)
    w = {r["class"]: r[kind] for r in bounded_collect(counted, MAX_CLASSES, f"classes of {label}")}
    expr = None
    for c, v in w.items():
        cond = F.col(label) == F.lit(c)
        expr = F.when(cond, F.lit(float(v))) if expr is None else expr.when(cond, F.lit(float(v)))
    return df.withColumn(name, expr.otherwise(F.lit(1.0)) if expr is not None else F.lit(1.0))


def class_profile(df: DataFrame, label: str = "target") -> DataFrame:
    """One row: counts, positive share, minority / majority ratio, imbalance flag and
    the secondary metric it implies (f1 when imbalanced, else accuracy)."""
    y = F.col(label)
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))
    minority = F.least("n_pos", "n_neg").cast("double")
    majority = F.greatest("n_pos", "n_neg").cast("double")
    ratio = F.coalesce(F.try_divide(minority, majority), F.lit(0.0))
    return agg.select(
        F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
        F.coalesce(F.try_divide(F.col("n_pos").cast("double"), F.col("n_rows").cast("double")), F.lit(0.0)).alias("pos_share"),
        ratio.alias("minority_ratio"),
        (ratio < IMBALANCE_RATIO).cast("int").alias("is_imbalanced"),
        F.when(ratio < IMBALANCE_RATIO, F.lit("f1")).otherwise(F.lit("accuracy")).alias("secondary_metric"),
    )


@dataclass
class MinMax:
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    eps: float = MINMAX_EPS

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        new = []
        for c, (lo, hi) in self.bounds.items():
            if lo is None:
                new.append(F.lit(None).cast("double").alias(f"{c}{suffix}"))
                continue
            new.append(((F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo + self.eps)).alias(f"{c}{suffix}"))
        if suffix:
            return df.select("*", *new)
        return df.select(*[c for c in df.columns if c not in self.bounds], *new)


def fit_minmax(df: DataFrame, columns: Sequence[str], eps: float = MINMAX_EPS) -> MinMax:
    """A10: min and max of every column in one aggregate row."""
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"_l{i}") for i, c in enumerate(columns)],
                 *[F.max(F.col(c).cast("double")).alias(f"_h{i}") for i, c in enumerate(columns)]).first()
    return MinMax({c: (row[f"_l{i}"], row[f"_h{i}"]) for i, c in enumerate(columns)}, eps)


@dataclass
class Standardizer:
    stats: dict[str, tuple[float | None, float]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            ((F.col(c).cast("double") - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1])).alias(c)
            if c in self.stats else F.col(c) for c in df.columns])


def fit_standardizer(train: DataFrame, columns: Sequence[str]) -> Standardizer:
    """Mean and population std (ddof 0) per column from the train table; std 0 -> 1."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(columns)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(columns)]).first()
    stats = {}
    for i, c in enumerate(columns):
        sd = row[f"_s{i}"]
        stats[c] = (row[f"_m{i}"], sd if sd not in (None, 0.0) else 1.0)
    return Standardizer(stats)


def econ_summary(df: DataFrame, label: str = "target") -> DataFrame:
    """Per class: mean ELI, mean BI and count, after min-max scaling of the raw indices."""
    scaled = fit_minmax(df, ["ELI_raw", "BI_raw"]).apply(df, suffix="_scaled")
    return scaled.groupBy(F.col(label).alias(label)).agg(
        F.avg("ELI_raw_scaled").alias("avg_eli"), F.avg("BI_raw_scaled").alias("avg_bi"),
        F.count(F.lit(1)).alias("user_count"))
