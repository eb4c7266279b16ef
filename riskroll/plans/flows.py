"""Stage-level entry points: the operators chained the way the original scripts ran them.

* ``merge_stage``: base ⟕ static ⟕ roll-ups of every child family (E1).
* ``feature_stage``: hold-out split -> clean -> derive -> clean again -> type
  filter -> the three selectors -> projection (E2).
* ``evaluation_stage``: score tables of several models -> comparison table (E3).

Each stage is lazy apart from the small profile / fit jobs its steps need;
multi-pass inputs are cut from their lineage with a reliable checkpoint in
the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskroll.functions import features as fe
from riskroll.operators import clean, joins, metrics, sampling, selection
from riskroll.session import ensure_checkpoint_dir

# Fixed values of the original feature stage
KEEP_COLUMNS = ("case_id", "target", "date_decision")


def merge_stage(base: DataFrame, families: Mapping[str, DataFrame], static: DataFrame | None = None,
                static_cb: DataFrame | None = None, cb_order: Sequence[str] | None = None,
                key: str = "case_id") -> DataFrame:
    """Depth-0 statics joined first (common columns removed), then every child family rolled up."""
    case = joins.join_static(base, static, static_cb, key, cb_order) if static is not None else base
    return joins.build_case_table(case, families, key)


def _checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean_stage(df: DataFrame, exclude: Sequence[str] = clean.NEVER_FEATURES, fit_on: Column | None = None) -> DataFrame:
    """NaN -> null, sparse columns out, sentinel -> null, numeric nulls -> 0, winsorise (ids excluded).

    Sparse columns and outlier bounds are those of the rows with ``fit_on`` (all rows if none is given)."""
    whole = _checkpointed(clean.nan_to_null(df))
    fit = whole if fit_on is None else whole.where(fit_on)
    kept = clean.drop_sparse(fit).columns
    cleaned = _checkpointed(clean.fill_zero(clean.sentinel_null(whole.select(*kept))))
    return clean.fit_winsor(cleaned if fit_on is None else cleaned.where(fit_on), exclude=exclude).apply(cleaned)


@dataclass
class FeatureResult:
    table: DataFrame
    candidates: list[str]
    selected: list[str]
    reports: dict[str, DataFrame] = field(default_factory=dict)


def feature_stage(merged: DataFrame, top_k: int = 60, n_test: int | None = None, n_pos: int | None = None,
                  trees: tuple[int, int] = (500, 1000)) -> FeatureResult:
    """The feature table with a ``split`` column (test / train).

    The test rows are drawn first; sparse columns, bounds and all three selectors are fitted on the train rows.  The
    selectors run in turn: null importance (L1), adversarial validation (L2), the ``top_k`` features by splits (L3);
    ``trees`` are those of L1 and L3.  A selector that would leave nothing keeps what it was given.  Test size
    defaults to a tenth of the rows with a tenth of those positive.
    """
    if n_test is None:
        n_test = merged.count() // 10
        n_pos = n_test // 10 if n_pos is None else n_pos
    split = _checkpointed(sampling.holdout_split(merged, n_test, n_pos if n_pos is not None else n_test // 10))
    is_train, never = F.col("split") == "train", (*clean.NEVER_FEATURES, "split")
    first = clean_stage(split, never, is_train)
    derived = fe.rfm_features(fe.ratio_features(fe.days_diff(first)))
    second = _checkpointed(clean_stage(derived, never, is_train))
    candidates = clean.numeric_features(second)
    train = second.where(is_train)
    reports: dict[str, DataFrame] = {}
    ni = selection.null_importance(train, candidates, trees=trees[0])
    reports["null_importance"] = ni
    keep = [r["feature"] for r in ni.where(F.col("keep") == 1).collect()] or candidates
    adv = selection.adversarial_auc(train, keep)
    reports["adversarial_auc"] = adv
    keep = [r["feature"] for r in adv.where(F.col("keep") == 1).orderBy("auc", "feature").collect()] or keep
    top = selection.importance_topk(train, keep, k=top_k, trees=trees[1])
    reports["importance_topk"] = top
    keep = [r["feature"] for r in top.collect()]
    table = second.select(*[c for c in KEEP_COLUMNS if c in second.columns], *keep, "split")
    return FeatureResult(table, candidates, keep, reports)


def common_scores(score_tables: Mapping[str, DataFrame], key: str = "case_id", score: str = "score",
                  label: str = "actual_label") -> DataFrame:
    """Long ``model, case_id, score, actual_label`` over the cases that every model scored.

    Each table is reduced to one row per case (the smallest (score, label) if it has several); the tables are
    inner-joined on the case; the label is that of the first table.
    """
    wide = None
    for name, t in score_tables.items():
        one = joins.dedup_first(t.select(key, score, label), key, [score, label]).select(
            key, F.col(score).alias(f"_s_{name}"), *([F.col(label).alias("_label")] if wide is None else []))
        wide = one if wide is None else wide.join(one, key)
    stacked = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_s_{name}").cast("double").alias("score"))
                        for name in score_tables])
    return wide.select(key, F.col("_label").alias(label), F.explode(stacked).alias("_m")).select(
        "_m.model", key, "_m.score", label)


def evaluation_stage(score_tables: Mapping[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """All models on the cases that each of them scored: per-model metric table, best model by PR AUC."""
    common = _checkpointed(common_scores(score_tables))
    return metrics.compare_models(common, threshold=threshold)
