"""A key holding a third of all rows: results stay exact and the plan pre-aggregates before the shuffle."""

from pyspark.sql import functions as F

from riskroll.operators import joins, metrics as me, rollup as ru


def skewed(spark, n=3000):
    # case 0 holds a third of all rows
    rows = [(0 if i % 3 == 0 else i, i, float(i % 97), "c" + str(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, num_group1 int, amt_1A double, cat_2M string")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_hot_key_exact_and_partial(spark):
    df = skewed(spark)
    out = ru.rollup(df)
    hot = out.where("case_id = 0").first()
    assert hot["record_count"] == 1000
    assert hot["num_group1_nunique"] == 1000 and hot["num_group1_max"] == 2997
    assert hot["cat_2M_first"] == "c0" and hot["cat_2M_nunique"] == 5
    text = plan_text(out)
    # partial aggregation happens below the first exchange on the key
    assert "partial_" in text


def test_dedup_first_hot_key(spark):
    df = skewed(spark)
    got = joins.dedup_first(df, "case_id", ["num_group1"]).where("case_id = 0").first()
    assert got["num_group1"] == 0
    assert "partial_min_by" in plan_text(joins.dedup_first(df, "case_id", ["num_group1"]))


def test_metrics_hot_score(spark):
    # one score value shared by a third of the rows
    rows = [(i, 0.5 if i % 3 == 0 else (i % 101) / 101.0, int(i % 4 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "case_id long, score double, actual_label int")
    counts = me.score_counts(df)
    assert counts.where(F.col("score") == 0.5).first()["pos"] + counts.where(F.col("score") == 0.5).first()["neg"] == 1000
    r = me.curve_summary(df).first()
    assert 0.0 <= r["roc_auc"] <= 1.0 and 0.0 <= r["ks"] <= 1.0
