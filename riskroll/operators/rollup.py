"""Suffix-driven roll-up of child histories to one row per case (A1-A5).

The last character of a column name decides which aggregates it gets:

====================  =====================================================
``…P`` / ``…A``       mean, max, min, sample std (numeric); max/min otherwise
``…D``                mean date
``…M``                first, last (ordered, null-keeping), n_unique (null = a value)
``…L`` / ``…T``       sum (all-null -> 0), max, min; strings get max/min only
contains ``num_group`` max, n_unique
always                ``record_count``
====================  =====================================================

The ladder is checked in that order; the key is skipped and any other column
is dropped.  The expressions are resolved against the schema on the driver (no
data is read).  Numbers and dates are one partial (map-side) and one final hash
aggregate around a shuffle on the key; category columns are reduced by distinct
value first (see ``rollup``).  Nothing is sorted or gathered per case, so a case
with a huge history is combined map-side instead of landing in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskroll.functions.exprs import date_mean, is_numeric_type

# The suffix ladder and the suffix of the aggregate names.
AMOUNT_SUFFIXES = ("P", "A")
DATE_SUFFIXES = ("D",)
CATEGORY_SUFFIXES = ("M",)
COUNT_SUFFIXES = ("L", "T")
ORDINAL_MARK = "num_group"
RECORD_COUNT = "record_count"
# aggregates that add up across partial results (everything else is averaged)
ADDITIVE_SUFFIXES = ("_sum", "_count", "_nunique")


def nunique_with_null(c: Column, approx: bool = False) -> Column:
    """Number of distinct values, counting null as one value.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``, ~1% error):
    no ``Expand`` of the input and a hash-based aggregate buffer."""
    distinct = F.approx_count_distinct(c, 0.01) if approx else F.count_distinct(c)
    return (distinct + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("bigint")


def default_order_columns(columns: Sequence[str]) -> list[str]:
    """The ordinal columns by their number (``num_group2`` before ``num_group10``)."""
    def number(name: str) -> tuple[int, str]:
        digits = re.search(r"\d+", name.partition(ORDINAL_MARK)[2])
        return int(digits.group()) if digits else -1, name

    return sorted((c for c in columns if ORDINAL_MARK in c), key=number)


def classify(name: str) -> str | None:
    """Which branch of the suffix ladder a column falls in (None = dropped)."""
    if name.endswith(AMOUNT_SUFFIXES):
        return "amount"
    if name.endswith(DATE_SUFFIXES):
        return "date"
    if name.endswith(CATEGORY_SUFFIXES):
        return "category"
    if name.endswith(COUNT_SUFFIXES):
        return "count"
    if ORDINAL_MARK in name:
        return "ordinal"
    return None


def rollup_exprs(schema: T.StructType, key: str = "case_id",
                 order_cols: Sequence[str] | None = None, approx_nunique: bool = False) -> list[Column]:
    """The aggregate list for one child table, in column order."""
    names = [f.name for f in schema.fields]
    order = list(order_cols) if order_cols is not None else default_order_columns(names)
    if not order:
        # no ordinal column: every other column orders the rows, so first / last never depend on the partitioning
        order = [n for n in names if n != key]
    def order_key(c: str) -> Column:  # ties in the order columns go by the value itself
        return F.struct(*[F.col(x) for x in order], F.col(c))

    out: list[Column] = []
    for f in schema.fields:
        name, dtype = f.name, f.dataType
        if name == key:
            continue
        c = F.col(name)
        kind = classify(name)
        if kind == "amount":
            if is_numeric_type(dtype):
                x = c.cast("double")
                out += [F.avg(x).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"),
                        F.min(c).alias(f"{name}_min"), F.stddev_samp(x).alias(f"{name}_std")]
            else:
                out += [F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]
        elif kind == "date":
            d = c if isinstance(dtype, T.DateType) else F.to_date(c)
            out.append(date_mean(d).alias(f"{name}_mean"))
        elif kind == "category":
            out += [F.min_by(c, order_key(name)).alias(f"{name}_first"),
                    F.max_by(c, order_key(name)).alias(f"{name}_last"),
                    nunique_with_null(c, approx_nunique).alias(f"{name}_nunique")]
        elif kind == "count":
            if is_numeric_type(dtype):
                summed = c.cast("int") if isinstance(dtype, T.BooleanType) else c
                out.append(F.coalesce(F.sum(summed), F.lit(0).cast(_sum_type(dtype))).alias(f"{name}_sum"))
            out += [F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]
        elif kind == "ordinal":
            out += [F.max(c).alias(f"{name}_max"), nunique_with_null(c, approx_nunique).alias(f"{name}_nunique")]
    out.append(F.count(F.lit(1)).alias(RECORD_COUNT))
    return out


def _sum_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.DecimalType):
        return f"decimal({min(dtype.precision + 10, 38)},{dtype.scale})"
    return "bigint"


def rollup(df: DataFrame, key: str | Sequence[str] = "case_id", order_cols: Sequence[str] | None = None,
           approx_nunique: bool = False, null_keys: bool = True) -> DataFrame:
    """A1 / A4: roll-up of a child table to one row per ``key``.

    Numbers and dates are one hash aggregate over the whole row.  Category and ordinal columns take another way, so that
    exact distinct counts never multiply wide rows: they are unpivoted to (key, column, value), each distinct value is
    reduced map-side to its first and last place, and these few rows give first, last and the number of values.  Both
    parts end up partitioned by the key and meet there by plain equality, without another exchange; rows with a null key
    are rolled up apart (``null_keys=False``: there are none, as behind a semi-join).  Ties in the ordinal columns go to the smaller (first) or
    larger (last) value; without ordinal columns every other column orders the rows.

    ``approx_nunique`` swaps the distinct counts for HyperLogLog++ sketches on very large histories; one aggregate then
    does everything.
    """
    keys = [key] if isinstance(key, str) else list(key)
    schema = T.StructType([f for f in df.schema.fields if f.name not in keys[1:]])
    exprs = rollup_exprs(schema, keys[0], order_cols, approx_nunique)
    names = df.groupBy(*keys).agg(*exprs).columns
    counted = [f for f in schema.fields if f.name != keys[0] and classify(f.name) in ("category", "ordinal")]
    order = list(order_cols) if order_cols is not None else default_order_columns(schema.names)
    if approx_nunique or not counted or not order:
        return df.groupBy(*keys).agg(*exprs)
    made = {f"{f.name}_{x}" for f in counted for x in ("first", "last", "nunique")}
    plain = [e for e, n in zip(exprs, names[len(keys):]) if n not in made]

    def both(part: DataFrame, same: Callable[[Column, Column], Column]) -> DataFrame:
        met = reduce(lambda a, b: a & b, [same(F.col(f"`{k}`"), F.col(f"`_{k}`")) for k in keys])
        # both sides hold every key: as a left join the optimiser leaves it out where only numbers and dates are wanted
        return part.groupBy(*keys).agg(*plain).join(_by_value(part, keys, counted, order), met, "left").select(
            *[F.col(f"`{k}`") for k in keys], *[F.col(f"`{n}`") for n in names[len(keys):]])

    known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    whole = both(df.where(known), lambda a, b: a == b)
    return whole.unionByName(both(df.where(~known), lambda a, b: a.eqNullSafe(b))) if null_keys else whole


def _by_value(df: DataFrame, keys: list[str], columns: Sequence[T.StructField], order: Sequence[str]) -> DataFrame:
    """First, last and number of distinct values (null is one) per key of the given columns; keys get a ``_`` prefix."""
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return (c + 0.0 if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c).cast("string")

    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(f).alias("value")) for i, f in enumerate(columns)]))
    place = F.col(f"`{order[0]}`") if len(order) == 1 else F.struct(*[F.col(f"`{c}`") for c in order])
    by = [F.col(f"`{k}`").alias(f"_{k}") for k in keys]
    values = (df.select(*by, place.alias("place"), pairs.alias("p"))
              .groupBy(*[f"_{k}" for k in keys], F.col("p.i").alias("i"), F.col("p.value").alias("value"))
              .agg(F.min(F.struct("place")).alias("lo"), F.max(F.struct("place")).alias("hi")))
    aggs = []
    for i, f in enumerate(columns):
        own = F.col("i") == i
        if classify(f.name) == "category":
            aggs += [F.min_by(F.when(own, F.col("value")), F.when(own, F.struct("lo", "value"))).cast(f.dataType).alias(f"{f.name}_first"),
                     F.max_by(F.when(own, F.col("value")), F.when(own, F.struct("hi", "value"))).cast(f.dataType).alias(f"{f.name}_last")]
        aggs.append(F.count_if(own).cast("bigint").alias(f"{f.name}_nunique"))
    return values.groupBy(*[f"_{k}" for k in keys]).agg(*aggs)


def rollup_partials(df: DataFrame, shard_col: str, key: str = "case_id", batch_size: int = 5,
                    order_cols: Sequence[str] | None = None) -> DataFrame:
    """A2: the per-file roll-up merged per batch of ``batch_size`` files.

    Each shard (file) is rolled up on its own; the shards of one batch are then
    combined per key: ``…_sum``, ``…_count``, ``…_nunique`` add up, every other
    aggregate becomes the mean of the per-file values (null for strings, the
    mean day for dates).  Returns ``key, chunk, <aggregates>`` where ``chunk``
    is the batch number (``shard // batch_size``).
    """
    cols = [c for c in df.columns if c != shard_col]
    per_file = rollup(df.select(*cols, shard_col), [key, shard_col], order_cols)
    per_file = per_file.withColumn("chunk", F.floor(F.col(shard_col) / batch_size).cast("bigint"))
    merged = []
    for f in per_file.schema.fields:
        if f.name in (key, shard_col, "chunk"):
            continue
        merged.append(_combine(F.col(f.name), f.name, f.dataType))
    return per_file.groupBy(key, "chunk").agg(*merged)


def _combine(c: Column, name: str, dtype: T.DataType) -> Column:
    if name.endswith(ADDITIVE_SUFFIXES):
        return F.sum(c).cast(_sum_type(dtype) if is_numeric_type(dtype) else "bigint").alias(name)
    if isinstance(dtype, T.DateType):
        return date_mean(c).alias(name)
    if is_numeric_type(dtype):
        return F.avg(c.cast("double")).alias(name)
    return F.lit(None).cast("string").alias(name)


def fold_chunks(partials: DataFrame, key: str = "case_id", chunk_col: str = "chunk") -> DataFrame:
    """A3: running pairwise mean over the chunks of a key, in chunk order.

    ``acc = v1; acc = mean(acc, v_k)`` for every later chunk holding the key
    (nulls are skipped, so a null on either side keeps the other).  Sums and
    counts are averaged as well.  The per-key array has one entry per chunk,
    so its length is bounded by the number of files, never by the row count.
    """
    value_cols = [f for f in partials.schema.fields if f.name not in (key, chunk_col)]
    aggs = []
    for f in value_cols:
        if is_numeric_type(f.dataType) or isinstance(f.dataType, T.DateType):
            aggs.append(F.array_sort(F.collect_list(F.struct(F.col(chunk_col).alias("k"),
                                                             F.col(f.name).alias("v")))).alias(f.name))
    grouped = partials.groupBy(key).agg(*aggs) if aggs else partials.select(key).distinct()
    out = [F.col(key)]
    for f in value_cols:
        if isinstance(f.dataType, T.DateType):
            arr = F.transform(F.col(f.name), lambda e: F.unix_date(e["v"]).cast("double"))
            folded = F.aggregate(arr, F.lit(None).cast("double"), _pair_mean)
            out.append(F.date_from_unix_date(F.floor(folded).cast("int")).alias(f.name))
        elif is_numeric_type(f.dataType):
            arr = F.transform(F.col(f.name), lambda e: e["v"].cast("double"))
            out.append(F.aggregate(arr, F.lit(None).cast("double"), _pair_mean).alias(f.name))
        else:
            out.append(F.lit(None).cast("string").alias(f.name))
    return grouped.select(*out)


def _pair_mean(acc: Column, v: Column) -> Column:
    return (F.when(acc.isNull(), v)
            .when(v.isNull(), acc)
            .otherwise((acc + v) / 2.0))


def prefix_columns(df: DataFrame, prefix: str, names: Sequence[str], key: str = "case_id") -> DataFrame:
    """Rename ``names`` (never the key) to ``{prefix}_{name}``."""
    wanted = set(names) - {key}
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") if c in wanted else F.col(c) for c in df.columns])
