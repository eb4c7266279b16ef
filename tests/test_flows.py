"""Stage entry points chain the operators end to end."""

from pyspark.sql import functions as F

from riskroll.plans import fixtures as fx, flows

from conftest import SMALL


def test_feature_stage_split_and_ids(spark):
    merged = fx.build_base(spark, SMALL)
    res = flows.feature_stage(merged, n_test=20, n_pos=2, trees=(20, 20))
    t = res.table
    assert t.count() == merged.count()
    assert t.where(F.col("split") == "test").count() == 20
    assert t.where("split = 'test' AND target = 1").count() == 2
    assert {"case_id", "target", "date_decision"} <= set(t.columns)
    assert res.selected and set(res.selected) <= set(res.candidates)
    assert set(res.reports) == {"null_importance", "adversarial_auc", "importance_topk"}
    # ids never winsorised: keys stay unique
    assert t.select("case_id").distinct().count() == t.count()


def test_merge_and_evaluation_stage(spark):
    base = fx.fx_base(spark, SMALL)
    merged = flows.merge_stage(base.select("case_id", "target"), {"d1": fx.fx_depth1(spark, SMALL)},
                               static=base.select("case_id", "maininc_215A"))
    assert merged.count() == base.count() and "maininc_215A" in merged.columns
    scores = {s: fx.score_table(spark, SMALL, s) for s in ("a", "b")}
    table = flows.evaluation_stage(scores)
    assert table.count() == 2 and table.agg(F.sum("is_best")).first()[0] == 1
