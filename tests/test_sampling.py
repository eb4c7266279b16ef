"""Sampling contracts: exact counts, disjointness, determinism."""

from pyspark.sql import functions as F

from riskroll.operators import sampling as sa


def base(spark, n=500, pos_every=7):
    return spark.createDataFrame([(i, 1 if i % pos_every == 0 else 0) for i in range(n)], "case_id long, target int")


def test_sample_n_exact_and_deterministic(spark):
    df = base(spark)
    a = sa.sample_n(df, 123)
    assert a.count() == 123
    assert sorted(r[0] for r in a.select("case_id").collect()) == \
        sorted(r[0] for r in sa.sample_n(df.repartition(7), 123).select("case_id").collect())


def test_holdout_split_counts_and_disjoint(spark):
    df = base(spark)
    out = sa.holdout_split(df, 50, 10)
    test = out.where(F.col("split") == "test")
    assert test.count() == 50 and test.where(F.col("target") == 1).count() == 10
    assert out.count() == 500
    train_ids = {r[0] for r in out.where(F.col("split") == "train").select("case_id").collect()}
    assert not train_ids & {r[0] for r in test.select("case_id").collect()}


def test_stratified_split_and_kfold(spark):
    df = base(spark)
    s = sa.stratified_split(df, 0.2)
    n_pos = df.where("target = 1").count()
    assert s.where("is_valid = 1 AND target = 1").count() == -(-n_pos * 2 // 10)
    k = sa.stratified_kfold(df, 5)
    per = {(r["fold"], r["target"]): r["n"] for r in k.groupBy("fold", "target").agg(F.count("*").alias("n")).collect()}
    for t in (0, 1):
        counts = [per.get((f, t), 0) for f in range(5)]
        assert max(counts) - min(counts) <= 1


def test_undersample_ratio(spark):
    df = base(spark)
    out = sa.undersample(df, 0.2)
    n_pos = df.where("target = 1").count()
    assert out.where("target = 1").count() == n_pos
    assert out.where("target = 0").count() == int(n_pos / 0.2)


def test_permutation_keeps_label_counts(spark):
    df = base(spark)
    p = sa.permute_labels(df)
    assert p.count() == 500
    assert p.agg(F.sum("permuted_target")).first()[0] == df.agg(F.sum("target")).first()[0]
    assert p.where(F.col("permuted_target") != F.col("target")).count() > 0


def test_bounded_collect_refuses_large_results(spark):
    import pytest

    from riskroll.operators.ordered import bounded_collect
    df = spark.range(10)
    assert len(bounded_collect(df, 10, "ids")) == 10
    with pytest.raises(ValueError):
        bounded_collect(df, 9, "ids")


def test_dense_codes_match_sorted_order(spark):
    import random

    from riskroll.operators.ordered import dense_codes
    random.seed(2)
    words = ["w%05d" % random.randint(0, 5000) for _ in range(3000)] + [None] * 5
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = {r["v"]: r["_code"] for r in dense_codes(df, "v", n_parts=7).collect()}
    want = {w: i for i, w in enumerate(sorted({w for w in words if w is not None}))}
    assert got == want


def test_short_samples_raise(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(30)], "case_id long, target int")
    for call in (lambda: sa.sample_n(df, 31), lambda: sa.holdout_split(df, 20, 10)):
        try:
            call()
        except ValueError:
            continue
        raise AssertionError("a short sample passed")


def test_null_labels_are_no_class(spark):
    df = spark.createDataFrame([(0, None)] + [(i, int(i < 10)) for i in range(1, 30)], "case_id long, target int")
    out = sa.undersample(df, 0.5)
    counts = {r["target"]: r["count"] for r in out.groupBy("target").count().collect()}
    assert counts == {None: 1, 1: 9, 0: 18}


def test_permute_labels_with_text_keys(spark):
    df = spark.createDataFrame([(f"c{i}", i % 3, i) for i in range(60)], "case_id string, target int, x int")
    out = sa.permute_labels(df)
    rows = out.collect()
    assert sorted(r["case_id"] for r in rows) == sorted(f"c{i}" for i in range(60))
    assert sorted(r["permuted_target"] for r in rows) == sorted(i % 3 for i in range(60))
    assert all(r["x"] == int(r["case_id"][1:]) for r in rows) and any(r["permuted_target"] != r["target"] for r in rows)
