"""Quality and toxicity: held-out accuracy on the labelled tables, and defined results on the odd ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskroll.llm import quality, toxicity
from riskroll.llm.common import ship

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def auc(rows):
    """Share of (positive, negative) pairs in the right order."""
    scores = np.array([r.score for r in rows])
    truth = np.array([r.truth for r in rows])
    gaps = scores[truth == 1][:, None] - scores[truth == 0][None, :]
    return float((gaps > 0).mean() + (gaps == 0).mean() / 2)


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.85)])
def test_held_out_rows(spark, module, label, least):
    ship(spark)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).alias("truth"))
    rows = module.query(spark, LARGER).join(labels, "doc_id").filter("held_out").collect()
    assert auc(rows) >= least
    assert all(r.predicted == (r.score >= module.THRESHOLD) for r in rows)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, module, label):
    ship(spark)
    docs = spark.createDataFrame(
        [(1, None, "c"), (2, "", "c"), (None, "some words here", "c"), (3, "idiot " * 3, "c"), (3, "idiot " * 3, "c"), (4, "x" * 200_000, "c")],
        "doc_id long, text string, score string")
    for rows in ([], [(1, 1), (1, None), (None, 0)], [(1, 1), (2, 0), (3, 1), (4, 0), (6, 1), (7, 0), (3, 0)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        model = module.fit(docs, labels)
        got = module.score(docs, model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), model).collect() == []
    if module is toxicity:
        kept = toxicity.keep_clean(docs, labels)
        assert kept.columns == docs.columns
        assert 1 in [r.doc_id for r in kept.collect()]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.2
    fires = np.zeros((20_000, toxicity.VOTERS), dtype=bool)
    for k in range(4):
        fires[:, k] = np.where(truth, rng.random(20_000) < 0.6, rng.random(20_000) < 0.02)
    fires[:, 4] = fires[:, 0]  # a copy of the first voter
    fires[:, -1] = ~fires[:, :-1].any(axis=1)
    masks, counts = np.unique((fires << np.arange(toxicity.VOTERS)).sum(axis=1), return_counts=True)
    model = toxicity.LabelModel(masks.astype(np.int64), counts.astype(float))
    assert np.abs(model.rate[1][:4] - 0.6).max() < 0.08 and model.rate[0][:4].max() < 0.06
    assert model.weight[4] < 0.75 and model.weight[0] < 0.75  # copies share their weight


def test_a_doubled_id_does_not_widen_the_sample(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"),
                                    F.concat(F.lit("text "), F.col("id")).alias("text"))
    sample = spark.createDataFrame([(7, 1), (1500, 1), (1501, 0), (99_999, 0)], "doc_id long, label int")
    got = quality.sampled_texts(docs, sample, 20).collect()
    assert sum(r.label for r in got) == 20 and [r.text for r in got if not r.label] == ["text 1501"]
    plain = quality.sampled_texts(docs.filter("doc_id != 7"), sample, 20).collect()
    assert sorted(r.doc_id for r in plain) == [1500, 1501]
