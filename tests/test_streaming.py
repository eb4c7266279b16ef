"""Streaming accumulation equals the batch counts, and the history grows per micro-batch."""

import tempfile

from pyspark.sql import functions as F

from riskroll.operators import metrics as me
from riskroll.streaming import run_incremental_f1


def test_incremental_f1_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="riskroll-stream-", dir="/tmp")
    df = spark.createDataFrame([(i, (i % 10) / 10.0, int(i % 3 == 0)) for i in range(300)],
                               "case_id long, score double, actual_label int")
    df.repartition(3, "case_id").write.parquet(f"{d}/src")
    final, history = run_incremental_f1(spark, f"{d}/src", "case_id long, score double, actual_label int",
                                        threshold=0.5, files_per_batch=1, work_dir=f"{d}/work")
    got = final.first()
    hard = df.select("actual_label", (F.col("score") > 0.5).cast("int").alias("predicted_label"))
    want = me.label_metrics(hard).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (want["tp"], want["fp"], want["fn"], want["tn"])
    assert abs(got["f1_incremental"] - want["f1_incremental"]) < 1e-12
    assert history.select("batch").distinct().count() >= 3
    totals = [r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in history.orderBy("batch").collect()]
    assert totals == sorted(totals) and totals[-1] == 300


def test_incremental_f1_resumes_from_its_checkpoint(spark):
    d = tempfile.mkdtemp(prefix="riskroll-stream-", dir="/tmp")
    schema = "case_id long, score double, actual_label int"
    first = spark.createDataFrame([(i, (i % 10) / 10.0, int(i % 3 == 0)) for i in range(200)], schema)
    first.repartition(2, "case_id").write.parquet(f"{d}/src")
    run_incremental_f1(spark, f"{d}/src", schema, work_dir=f"{d}/work")
    # new score files arrive; the restarted query continues from its state store and reads only the new files
    second = spark.createDataFrame([(i, (i % 7) / 7.0, int(i % 2 == 0)) for i in range(200, 320)], schema)
    second.repartition(2, "case_id").write.mode("append").parquet(f"{d}/src")
    final, _ = run_incremental_f1(spark, f"{d}/src", schema, work_dir=f"{d}/work")
    got = final.first()
    both = first.unionByName(second)
    hard = both.select("actual_label", (F.col("score") > 0.5).cast("int").alias("predicted_label"))
    want = me.label_metrics(hard).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (want["tp"], want["fp"], want["fn"], want["tn"])
