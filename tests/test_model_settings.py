"""The registered model queries run their operators at full strength (nothing is fitted here)."""

from unittest.mock import MagicMock

from riskroll.operators import models as mo
from riskroll.plans import catalog, flows

REDUCING = {"params", "max_iter", "n_draws", "hidden", "trees", "patience", "rounds", "folds", "k"}


def test_model_queries_run_the_full_settings(spark, monkeypatch):
    calls = {}

    def spy(owner, name, result=None):
        def called(*args, **kw):
            calls[name] = (args, kw)
            return MagicMock() if result is None else result
        monkeypatch.setattr(owner, name, called)

    for name, made in (("model_frame", (MagicMock(), ["x"])), ("train_valid", (MagicMock(), MagicMock(), ["x"])),
                       ("tree_tables", (MagicMock(), MagicMock(), ["x"], ["c"])), ("merged", None), ("materialized", None)):
        spy(catalog, name, made)
    spy(catalog.clean, "fit_imputer")
    spy(catalog.boosting, "fit_boosted")
    for name in ("null_importance", "importance_topk"):
        spy(catalog.se, name)
    spy(mo, "svm_pipeline", (MagicMock(), MagicMock()))
    for name in ("mlp_pipeline", "stack_oof", "stack_score", "random_search", "mlp_search", "boosted_scores", "gbt_importances",
                 "save_model", "load_model", "batch_score"):
        spy(mo, name)
    spy(flows, "feature_stage")
    monkeypatch.setattr(catalog, "round_doubles", lambda df: df)
    for query, operator in (("null_importance", "null_importance"), ("importance_topk", "importance_topk"),
                            ("svm_score", "svm_pipeline"), ("mlp_score", "mlp_pipeline"), ("stack_oof", "stack_oof"),
                            ("stack_score", "stack_score"), ("random_search", "random_search"), ("mlp_search", "mlp_search"),
                            ("feature_table", "feature_stage")):
        catalog.QUERIES[query](spark, "nowhere")
        args, kw = calls[operator]
        assert not REDUCING & set(kw), query
        if operator.startswith("stack"):
            assert mo.GBTParams() in args[-1].values() and mo.MLPParams() in args[-1].values()
    for query in ("importance_table", "batch_score"):
        catalog.QUERIES[query](spark, "nowhere")
        assert calls["fit_boosted"][0][2] == mo.GBTParams()
    for query, trees, patience in (("gbt_score", 1000, 100), ("gbt_score_b", 4000, 300)):
        catalog.QUERIES[query](spark, "nowhere")
        params = calls["boosted_scores"][0][4]
        assert (params.max_iter, params.patience, params.max_depth) == (trees, patience, 6)
