"""Sources and sinks with real files in a scratch folder."""

import tempfile

from pyspark.sql import functions as F

from riskroll import sources


def test_csv_lineage_ranks_files(spark):
    d = tempfile.mkdtemp(prefix="riskroll-csv-", dir="/tmp")
    files = {"b.csv": "x,y\n1,2\n3,4\n", "a.csv": "x,y\n5,6\n", "c.csv": "x,y\n7,8\n", "notes.txt": "x,y\n9,9\n"}
    for name, rows in files.items():
        with open(f"{d}/{name}", "w") as fh:
            fh.write(rows)
    df = sources.read_with_lineage(spark, d, fmt="csv", schema="x int, y int")
    got = sorted((r["x"], r["file_name"]) for r in df.collect())
    assert got == [(1, "file_2.csv"), (3, "file_2.csv"), (5, "file_1.csv"), (7, "file_3.csv")]


def test_union_relaxed_widens_and_fills(spark):
    a = spark.createDataFrame([(1, 1.5)], "k int, v float")
    b = spark.createDataFrame([(2, "z", 2.25)], "k long, extra string, v double")
    out = sources.union_relaxed([a, b])
    types = dict(out.dtypes)
    assert types == {"k": "bigint", "v": "double", "extra": "string"}
    assert out.where(F.col("extra").isNull()).count() == 1


def test_union_strict_rejects_other_schema(spark):
    a = spark.createDataFrame([(1,)], "k int")
    b = spark.createDataFrame([(1,)], "k long")
    try:
        sources.union_strict([a, b])
    except ValueError:
        return
    raise AssertionError("schema mismatch not detected")


def test_allowlist_and_sinks(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 3.0)], "case_id long, target int, a double, b double")
    sheet = spark.createDataFrame([("b",), ("nope",), ("case_id",)], "Feature_Name string")
    out = sources.select_allowlist(df, sources.allowlist_names(sheet))
    assert out.columns == ["case_id", "target", "b"]
    assert sources.select_allowlist(df, []).columns == df.columns
    d = tempfile.mkdtemp(prefix="riskroll-sink-", dir="/tmp")
    sources.write_parquet(out, f"{d}/p")
    sources.write_csv(out, f"{d}/c")
    assert spark.read.parquet(f"{d}/p").count() == 1
    assert spark.read.option("header", "true").csv(f"{d}/c").columns == ["case_id", "target", "b"]


def test_lineage_keeps_equal_names_apart(spark):
    d = tempfile.mkdtemp(prefix="riskroll-lineage-", dir="/tmp")
    for i, folder in enumerate(("d1", "d2")):
        spark.createDataFrame([(i,)], "k int").coalesce(1).write.option("header", "true").csv(f"{d}/{folder}")
    out = sources.read_with_lineage(spark, [f"{d}/d1", f"{d}/d2"], schema="k int")
    assert sorted((r["k"], r["file_name"]) for r in out.collect()) == [(0, "file_1.csv"), (1, "file_2.csv")]


def test_common_types():
    from pyspark.sql import types as T

    dec = T.DecimalType
    for given, want in [([dec(10, 2), T.DoubleType()], T.DoubleType()), ([dec(10, 2), dec(12, 3)], dec(12, 3)),
                        ([dec(10, 2), T.LongType()], dec(22, 2)), ([T.BooleanType(), T.IntegerType()], T.IntegerType()),
                        ([T.IntegerType(), T.FloatType()], T.DoubleType()), ([T.StringType(), T.LongType()], T.StringType())]:
        assert sources.common_type(given) == want
    for given in ([T.DateType(), T.LongType()], [T.ArrayType(T.LongType()), T.StringType()]):
        try:
            sources.common_type(given)
        except TypeError:
            continue
        raise AssertionError(given)
