"""Plan shape: no single-partition window over raw rows, one exchange per roll-up family."""

import re

import pytest

from riskroll.operators import metrics as me, rollup as ru
from riskroll.plans import fixtures as fx
from riskroll.plans.catalog import QUERIES

from conftest import SMALL


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_have_no_global_window(spark):
    df = me.cum_gain(fx.score_table(spark, SMALL, "a"))
    text = plan_text(df)
    for line in text.splitlines():
        if "Window [" in line:
            # every window is partitioned (by the value range), never a global ORDER BY
            assert re.search(r"\], \[[^\]]*_range", line), line


def test_rollup_one_exchange_on_key(spark):
    child = fx.fx_depth1(spark, SMALL).drop("num_group1").withColumnRenamed("case_id", "case_id")
    child = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr(
        "o_custkey AS case_id", "o_totalprice AS price_1A", "o_orderpriority AS prio_2M")
    text = plan_text(ru.rollup(child))
    assert text.count("Exchange hashpartitioning(case_id") <= 2   # distinct-count expansion adds one on the same key
    assert "SinglePartition" not in text


def test_ranking_and_metric_queries_only_partitioned_windows(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    for name in ("roc_auc", "pr_curve", "compare_models", "sample_n", "holdout_split", "permute_labels",
                 "stratified_kfold", "grid_threshold"):
        text = plan_text(qs[name](spark, SMALL))
        for line in text.splitlines():
            if "Window [" not in line:
                continue
            spec = re.search(r"Window \[.*\], \[([^\]]*)\], \[", line)
            partition = spec.group(1) if spec else ""
            # the only unpartitioned window runs over the threshold grid (at most 1,001 rows)
            assert partition.strip() or "k#" in line, (name, line[:200])


@pytest.mark.parametrize("name,most", [("build_base", 13), ("merge_stage", 19)])
def test_roll_ups_meet_without_further_exchanges(spark, name, most):
    """The two parts of a roll-up and the left joins use the partitioning by case that the aggregates made."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "coalesce(case_id" not in plan
    assert plan.count("Exchange hashpartitioning") <= most
