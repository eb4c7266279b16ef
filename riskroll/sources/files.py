"""Sources and sinks.

Families of shards are read with one reader call (one scan node, file
listing and split planning done by Spark) instead of a Python loop of
unions; relaxed unions align columns by name and widen types explicitly.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# Ids and labels are never features.
ID_COLUMNS = ("target", "case_id")


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One file, a directory, a glob or a list of shard files -> one frame."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def union_strict(frames: Iterable[DataFrame]) -> DataFrame:
    """Vertical concat of shards that must share one schema (names and types)."""
    frames = list(frames)
    first = frames[0].schema
    for i, f in enumerate(frames[1:], start=1):
        if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in first]:
            raise ValueError(f"shard {i} schema differs from shard 0: {f.schema.simpleString()} "
                             f"vs {first.simpleString()}")
    return reduce(lambda a, b: a.unionByName(b), frames)


_NUMERIC_RANK = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _decimal_of(t: T.DataType) -> T.DecimalType | None:
    """The decimal that holds every value of an exact numeric type."""
    digits = {T.BooleanType: 1, T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
    return t if isinstance(t, T.DecimalType) else T.DecimalType(digits[type(t)], 0) if type(t) in digits else None


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Supertype of several column types.

    Widest numeric type (booleans count as 0 / 1; decimals widen to the joint precision and scale, with a float to
    double); dates and timestamps to timestamp; a string with anything else to string (its text form).  Types
    without a common form (say a date and a number) raise.
    """
    distinct = []
    for t in types:
        if t not in distinct:
            distinct.append(t)
    if len(distinct) == 1:
        return distinct[0]
    distinct = [t for t in distinct if not isinstance(t, T.NullType)]
    if len(distinct) == 1:
        return distinct[0]
    exact = [_decimal_of(t) for t in distinct]
    if any(isinstance(t, T.DecimalType) for t in distinct):
        if all(exact):
            scale = max(t.scale for t in exact)
            whole = max(t.precision - t.scale for t in exact)
            if whole + scale > 38:
                raise TypeError(f"no decimal holds all of {distinct}")
            return T.DecimalType(whole + scale, scale)
        if all(d or isinstance(t, (T.FloatType, T.DoubleType)) for t, d in zip(distinct, exact)):
            return T.DoubleType()
    numeric = [T.ByteType() if isinstance(t, T.BooleanType) else t for t in distinct]
    if all(type(t) in _NUMERIC_RANK for t in numeric):
        distinct = numeric
        ranks = [_NUMERIC_RANK.index(type(t)) for t in distinct]
        best = _NUMERIC_RANK[max(ranks)]
        # long + float cannot hold every long exactly in a float: use double
        if best is T.FloatType and any(type(t) in (T.IntegerType, T.LongType) for t in distinct):
            best = T.DoubleType
        return best()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in distinct):
        return T.TimestampNTZType() if any(isinstance(t, T.TimestampNTZType) for t in distinct) else T.TimestampType()
    if any(isinstance(t, T.StringType) for t in distinct) and not any(
            isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for t in distinct):
        return T.StringType()
    raise TypeError(f"no common type of {[t.simpleString() for t in distinct]}")


def union_relaxed(frames: Iterable[DataFrame]) -> DataFrame:
    """S3: union of column sets; absent columns are null, types go to a common supertype."""
    frames = list(frames)
    order: list[str] = []
    types: dict[str, list[T.DataType]] = {}
    for f in frames:
        for fld in f.schema.fields:
            if fld.name not in types:
                order.append(fld.name)
                types[fld.name] = []
            types[fld.name].append(fld.dataType)
    target = {n: common_type(ts) for n, ts in types.items()}
    aligned = []
    for f in frames:
        have = set(f.columns)
        aligned.append(f.select(*[
            (F.col(n).cast(target[n]) if n in have else F.lit(None).cast(target[n])).alias(n) for n in order
        ]))
    return reduce(lambda a, b: a.unionByName(b), aligned)


def read_with_lineage(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv",
                      ext: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a set of files and add ``file_name = file_{i}{ext}``.

    ``i`` is the 1-based alphabetical rank of the file's full path among the files that hold rows (so equal base names
    in two folders stay apart).  The rank table has one row per file and is joined, not hinted: the planner broadcasts
    it while it is small.  CSV needs a ``schema`` (a header row is skipped): without one the data would be read twice.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV files need a schema")
        options.setdefault("header", "true")
        options.setdefault("pathGlobFilter", "*.csv")      # only the directory's .csv files
    if fmt == "parquet" and schema is None:
        options.setdefault("mergeSchema", "true")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(paths)
    suffix = ext if ext is not None else (f".{fmt}" if fmt != "text" else ".txt")
    with_src = df.withColumn("_src", F.col("_metadata.file_path"))
    files = with_src.select("_src").distinct()
    ranks = files.select("_src", F.concat(F.lit("file_"), F.row_number().over(Window.orderBy("_src")).cast("string"),
                                          F.lit(suffix)).alias("file_name"))
    return with_src.join(ranks, "_src", "left").drop("_src")


def read_in_order(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A parquet sink's rows with their place in it (from 1): files by name, rows by their index in the file.

    Sums over the files have one row per file; the rows are neither sorted nor shuffled."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_file").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


# Fixed value: most names an allow-list sheet may hold.
MAX_NAMES = 100_000


def allowlist_names(names_df: DataFrame, column: str = "Feature_Name") -> list[str]:
    """The feature names of an allow-list sheet, at most ``MAX_NAMES``, in row order of the sheet."""
    rows = names_df.select(column).where(F.col(column).isNotNull()).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"an allow-list of more than {MAX_NAMES} names")
    return [r[0] for r in rows]


def select_allowlist(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ("case_id", "target")) -> DataFrame:
    """``keep`` columns plus the listed features that exist, in list order.

    Ids in the list are ignored; unknown names are skipped with a warning; an
    empty list keeps every column.
    """
    wanted = [n for n in names if n not in ID_COLUMNS]
    if not wanted:
        return df
    valid = [n for n in dict.fromkeys(wanted) if n in df.columns]
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        log.warning("allow-list names not in the table, skipped: %s", missing)
    head = [c for c in keep if c in df.columns]
    return df.select(*head, *[c for c in valid if c not in head])


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> None:
    """Parquet sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header, no index column."""
    df.write.mode(mode).option("header", "true").csv(path)
