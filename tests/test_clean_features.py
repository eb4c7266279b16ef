"""Cleaning and feature functions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskroll.functions import features as fe
from riskroll.operators import classes, clean, encode


def test_sparse_then_sentinel_order(spark):
    df = spark.createDataFrame([(i, "a55475b1" if i < 9 else "k", None if i < 9 else 1.0) for i in range(10)],
                               "case_id long, s_1M string, x_2A double")
    first = clean.drop_sparse(df)
    assert "x_2A" not in first.columns and "s_1M" in first.columns      # 90% null -> dropped
    second = clean.sentinel_null(first)
    assert second.where(F.col("s_1M").isNull()).count() == 9
    assert "s_1M" not in clean.drop_sparse(second).columns               # seen as sparse on the second pass
    prof = {r["column"]: r for r in clean.null_profile(df).collect()}
    assert prof["x_2A"]["null_count"] == 9 and prof["x_2A"]["keep"] is False
    assert prof["case_id"]["null_ratio"] == 0.0


def test_drop_sparse_threshold_is_strict(spark):
    df = spark.createDataFrame([(i, None if i < 8 else 1.0) for i in range(10)], "case_id long, x double")
    assert "x" in clean.drop_sparse(df).columns                          # exactly 0.8 stays


def test_fill_zero_numeric_only(spark):
    df = spark.createDataFrame([(1, None, None, None)], "case_id long, a double, s string, d date")
    r = clean.fill_zero(df).first()
    assert r["a"] == 0.0 and r["s"] is None and r["d"] is None


def test_winsorize_excludes_ids_and_keeps_nulls(spark):
    df = spark.createDataFrame([(i, float(i), i % 3) for i in range(1, 201)] + [(999, None, None)],
                               "case_id long, x double, target int")
    out = clean.winsorize(df)
    lo, hi = out.agg(F.min("x"), F.max("x")).first()
    assert lo == 2.0 and hi == 198.0                 # percentile_disc q01 / q99 of 1..200
    assert out.agg(F.max("case_id")).first()[0] == 999
    assert out.where(F.col("x").isNull()).count() == 1


def test_shrink_plan(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1)], "a long, b long, c long, d long")
    plan = {r["column"]: r["shrunk_type"] for r in clean.shrink_plan(df).collect()}
    assert plan == {"a": "tinyint", "b": "smallint", "c": "int", "d": "tinyint"}


def test_infer_types(spark):
    df = spark.createDataFrame([("2024-01-02", "x", 1), ("bad", "y", 2), ("2024-02-03", None, 3)],
                               "a string, b string, c int")
    kinds = {r["column"]: r["inferred"] for r in clean.infer_types(df).collect()}
    assert kinds == {"a": "date", "b": "categorical", "c": "numeric"}


def test_imputer_median_and_mode(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (10.0, "a"), (None, "b"), (4.0, None)], "x double, s string")
    imp = clean.fit_imputer(train, exclude=())
    assert imp.fills["x"] == 3.0              # interpolated median of 1, 2, 4, 10
    assert imp.fills["s"] == "a"              # tie a/b (2 each) -> smallest
    test = spark.createDataFrame([(None, None)], "x double, s string")
    r = imp.apply(test).first()
    assert r["x"] == 3.0 and r["s"] == "a"


def test_ratio_guards(spark):
    df = spark.createDataFrame([(1, 10.0, -1.0, 4.0)], "case_id long, currdebt_22A double, maininc_215A double, "
                                                       "credacc_credlmt_575A_mean double")
    r = fe.ratio_features(df).first()
    assert r["debt_to_income_ratio"] is None               # d = -1 -> null, never an error
    assert r["active_credit_util_ratio"] == 2.0
    assert "residual_debt_ratio" not in fe.ratio_features(df).columns   # absent input -> skipped


def test_days_diff_and_rfm(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 12, 1), "2024-12-30", "junk", 60)],
                               "case_id long, d date, lastrejectdate_50D string, lastapprdate_640D string, "
                               "applications30d_658L long")
    r = fe.days_diff(df).first()
    assert r["d_days_diff"] == 30
    q = fe.rfm_features(df).first()
    assert q["days_since_last_reject"] == 1 and q["days_since_last_approval"] is None
    assert q["application_freq_30d"] == 2.0


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 4, 1),)], "d date")
    rows = fe.date_parts(df, ["d"]).orderBy("d_day").collect()
    first, last = rows[0], rows[1]
    assert first["d_quarter"] == 2 and first["d_is_quarter_start"] == 1 and first["d_dayofweek"] == 0
    assert last["d_is_month_end"] == 1 and last["d_is_quarter_end"] == 1 and last["d_days_in_month"] == 31
    assert last["d_is_weekend"] == 1                         # 2024-03-31 is a Sunday


def test_econ_indices(spark):
    df = spark.createDataFrame([(1, 100.0, 100.0, 300.0, None, None, 0.1)],
                               "case_id long, residualamount_856A_mean double, currdebt_22A double, "
                               "collater_valueofguarantee_1124L_sum double, maxdpdlast6m_474P double, "
                               "pmts_overdue_1140A_mean double, nominalrate_281L_max double")
    r = fe.econ_indices(df).first()
    assert r["EAD"] == 200.0 and r["LGD"] == 0.0 and r["PD"] == 0.5 and r["BI_raw"] == pytest.approx(10.0)


def test_minmax_and_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    mm = classes.fit_minmax(df, ["x"]).apply(df).orderBy("x").collect()
    assert mm[0]["x"] == 0.0 and mm[1]["x"] == pytest.approx(1.0, abs=1e-5)
    st = classes.fit_standardizer(df, ["x", "c"]).apply(df).orderBy("x").collect()
    assert st[0]["x"] == -1.0 and st[0]["c"] == 0.0          # std 0 -> 1


def test_encoders_share_one_dictionary(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    test = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    codes = encode.fit_label_encoder(train, ["c"], null_as=None)
    got = sorted((r["c"] for r in codes.apply(test).collect()))
    assert got == [-1, -1, 0]                                # unseen and null -> -1
    le = encode.fit_label_encoder(train, ["c"])
    assert sorted(r["c"] for r in le.apply(train).collect()) == [0, 1, 2]   # 'None' < 'a' < 'b'
    oh = encode.fit_one_hot(train, ["c"]).apply(test)
    assert set(oh.columns) == {"c_None", "c_a", "c_b"}
    assert oh.where(F.col("c_a") + F.col("c_b") + F.col("c_None") == 0).count() == 1   # unseen -> zeros


def test_class_tables(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(10)], "case_id long, target int")
    w = {r["class"]: r for r in classes.class_weights(df).collect()}
    assert w[1]["weight_ratio"] == 4.0 and w[1]["weight_odds"] == 4.0 and w[1]["weight_balanced"] == 2.5
    p = classes.class_profile(df).first()
    assert p["minority_ratio"] == 0.25 and p["is_imbalanced"] == 0 and p["secondary_metric"] == "accuracy"


def test_exact_quantiles_match_spark_aggregates(spark):
    import random

    random.seed(9)
    rows = [(float(random.randint(0, 50)), random.random() * 1000 if random.random() > 0.1 else None,
             random.randint(-5, 5)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    cols = ["a", "b", "c"]
    ps = [0.01, 0.25, 0.5, 0.55, 0.99]
    got = clean.quantile_values(df, cols, ps)
    df.createOrReplaceTempView("qt")
    for c in cols:
        want = spark.sql("SELECT " + ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})" for p in ps)
                         + " FROM qt").first()
        assert [float(x) for x in got[c]] == [float(x) for x in want]


@pytest.mark.parametrize("bracket", [3, 10_000])
def test_ranks_on_odd_columns(spark, monkeypatch, bracket):
    """Infinities, NaN, integers beyond 2**53, one hot value, an empty column; also when brackets must be cut again."""
    import random

    monkeypatch.setattr(clean, "BRACKET_VALUES", bracket)
    monkeypatch.setattr(clean, "ACCURACY", 20)
    random.seed(4)
    big = 2**60
    rows = [(random.choice([float("inf"), float("-inf"), float("nan"), None, random.gauss(0, 1e9), 0.0]), big + i,
             5 if random.random() < 0.9 else random.randint(0, 99), None) for i in range(600)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "a double, b long, c int, d double").repartition(5)
    ps = [0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0]
    for method in ("disc", "nearest"):
        got = clean.quantile_values(df, ["a", "b", "c", "d"], ps, method)
        for k, c in enumerate("abc"):
            values = sorted(r[k] for r in rows if r[k] is not None and r[k] == r[k])
            assert got[c] == [values[clean.QUANTILE_RANKS[method](p)(len(values)) - 1] for p in ps], (c, method)
        assert got["d"] == [None] * len(ps)


def test_winsorize_keeps_integers(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(i, big + i) for i in range(400)], "case_id long, x long")
    out = {r["case_id"]: r["x"] for r in clean.winsorize(df).collect()}
    assert out[200] == big + 200 and out[0] == big + 3 and out[399] == big + 395


def test_one_hot_keeps_null_and_text_none_apart(spark):
    df = spark.createDataFrame([(1, None), (2, "None"), (3, "a")], "case_id int, x string")
    rows = {r["case_id"]: r.asDict() for r in encode.fit_one_hot(df, ["x"]).apply(df).collect()}
    assert rows[1] == {"case_id": 1, "x_null": 1, "x_None": 0, "x_a": 0}
    assert rows[2] == {"case_id": 2, "x_null": 0, "x_None": 1, "x_a": 0}


def test_nan_means_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), 1), (2, 2.0, None)], "case_id long, x double, y int")
    assert sorted(tuple(r) for r in clean.nan_to_null(df).collect()) == [(1, None, 1), (2, 2.0, None)]


def test_codes_by_broadcast_and_by_shuffle_agree(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"v{i % 7}") for i in range(200)], "case_id int, x string")
    for null_as in (None, "None"):
        codes = encode.fit_label_encoder(df, ["x"], null_as)
        small = sorted(map(tuple, codes.apply(df).collect()))
        codes.sizes["x"] = encode.MAX_BROADCAST_BYTES + 1
        assert sorted(map(tuple, codes.apply(df).collect())) == small
        assert all((x == -1) == (i % 3 == 0) for i, x in small) or null_as
