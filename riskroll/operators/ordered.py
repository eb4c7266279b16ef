"""Global order without a single-partition window: ranks and running sums.

A window ``ORDER BY`` without ``PARTITION BY`` moves every row into one task.
Instead, rows are cut into ``B`` value ranges (quantile cut points of the
order column, one small job; the ranges are assigned with a binary search in
the JVM by ``Bucketizer``), per-range totals are aggregated (``B`` rows per
group, collected), their exclusive prefix becomes a per-range offset joined
back as a broadcast of at most ``groups × (B + 1)`` rows, and the running
value inside a range is an ordinary window partitioned by the range.  Every
step is linear and parallel in the number of ranges; nothing depends on
partition ids, so a retried task gives the same answer.

Group columns (e.g. the class label) are for low-cardinality strata only:
their count multiplies the size of the offset table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_range"
# Fixed value: most (group, range) rows the offset table may hold (it is collected and broadcast).
MAX_OFFSET_ROWS = 1_000_000


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; more is an error, never a silent truncation."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows would reach the driver; "
                         f"use fewer groups / categories for this operator")
    return rows


def _default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def with_ranges(df: DataFrame, order_col: str, n_buckets: int | None = None,
                descending: bool = False, range_key: Column | None = None) -> DataFrame:
    """Add ``_okey`` (the order key) and ``_range`` (its value range, 0-based).

    ``range_key`` (optional) is the numeric key the ranges are cut on; it
    must not decrease when the order key increases within a group (used to
    give groups on different scales their own ranges).
    """
    b = n_buckets or _default_buckets(df)
    x = F.col(order_col).cast("double")
    staged = df.withColumn("_okey", -x if descending else x)
    rk = "_okey"
    if range_key is not None:
        staged = staged.withColumn("_rkey", -range_key if descending else range_key)
        rk = "_rkey"
    if b <= 1:
        return staged.withColumn(_BUCKET, F.lit(0.0)).drop("_rkey")
    probs = [i / b for i in range(1, b)]
    cuts = staged.stat.approxQuantile(rk, probs, 1.0 / (4 * b))
    splits = [float("-inf")] + sorted(set(c for c in cuts if c is not None)) + [float("inf")]
    return (Bucketizer(splits=splits, inputCol=rk, outputCol=_BUCKET, handleInvalid="keep")
            .transform(staged).drop("_rkey"))


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], tiebreak: Sequence[str] = (),
                 group_cols: Sequence[str] = (), descending: bool = False, n_buckets: int | None = None,
                 prefix: str = "cum_", totals: bool = False, range_key: Column | None = None,
                 materialize: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``(order_col, *tiebreak)`` order within ``group_cols``.

    ``order_col`` must be numeric and non-null.  Adds ``{prefix}{c}`` for
    every summed column, and ``total_{c}`` (the group total) when ``totals``;
    the totals come from the same small job that sizes the ranges.

    The input is read three times (cut points, range totals, final pass).
    ``materialize=True`` first writes it as a reliable checkpoint in the
    shared checkpoint folder: use it when the input is an expensive
    aggregate (e.g. the distinct-score table of a large score table), so
    the aggregate runs once instead of three times.
    """
    if materialize:
        from riskroll.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    ranged = with_ranges(df, order_col, n_buckets, descending, range_key)
    keys = [*group_cols, _BUCKET]
    range_totals = bounded_collect(ranged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sum_cols]),
                                   MAX_OFFSET_ROWS, "per-range totals (groups × ranges)")
    # exclusive prefix of the per-range totals, per group, on the driver (bounded by groups × ranges)
    rows = []
    by_group: dict[tuple, list] = {}
    for r in range_totals:
        by_group.setdefault(tuple(r[g] for g in group_cols), []).append(r)
    for g, rs in by_group.items():
        acc = [0] * len(sum_cols)
        group_rows = []
        for r in sorted(rs, key=lambda r: r[_BUCKET]):
            group_rows.append([*g, r[_BUCKET], *acc])
            acc = [a + (r[c] or 0) for a, c in zip(acc, sum_cols)]
        rows += [tuple(gr + acc) for gr in group_rows]
    spark = df.sparkSession
    off_schema = [f for f in ranged.schema.fields if f.name in group_cols]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in off_schema]
                       + [f"`{_BUCKET}` double"]
                       + [f"`_off_{c}` {ranged.schema[c].dataType.simpleString()}" for c in sum_cols]
                       + [f"`_tot_{c}` {ranged.schema[c].dataType.simpleString()}" for c in sum_cols])
    offsets = spark.createDataFrame(rows, schema)
    joined = ranged.join(F.broadcast(offsets), keys, "left")
    order = [F.col("_okey")] + [F.col(t) for t in tiebreak]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.select("*", *[(F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.sum(c).over(w)).alias(f"{prefix}{c}")
                               for c in sum_cols])
    if totals:
        out = out.select("*", *[F.col(f"_tot_{c}").alias(f"total_{c}") for c in sum_cols])
    return out.drop("_okey", _BUCKET, *[f"_off_{c}" for c in sum_cols], *[f"_tot_{c}" for c in sum_cols])


def global_rank(df: DataFrame, order_col: str, tiebreak: Sequence[str] = (), group_cols: Sequence[str] = (),
                descending: bool = False, n_buckets: int | None = None, name: str = "rank") -> DataFrame:
    """1-based position of each row in ``(order_col, *tiebreak)`` order within ``group_cols``."""
    staged = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_sums(staged, order_col, ["_one"], tiebreak, group_cols, descending, n_buckets, prefix="_cum")
    return ranked.withColumnRenamed("_cum_one", name).drop("_one")


def first_rows(df: DataFrame, n: int | Column, order_col: str, tiebreak: Sequence[str] = (),
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Exactly the first ``n`` rows (per group when ``n`` is a column) in the given order."""
    ranked = global_rank(df, order_col, tiebreak, group_cols, name="_pos")
    limit = n if isinstance(n, Column) else F.lit(n)
    return ranked.where(F.col("_pos") <= limit).drop("_pos")


def dense_codes(values: DataFrame, col: str, n_parts: int | None = None, name: str = "_code") -> DataFrame:
    """0-based code of every distinct non-null value of ``col`` in sorted order (any orderable type).

    Distinct values are range-partitioned (Spark samples the bounds) and the
    partitioned result is cut from its lineage with a reliable checkpoint in
    the shared checkpoint folder, so the partition a value sits in is fixed
    for both passes.  Per-partition counts (one row per partition) give the
    offsets; the code is offset + position inside the partition.  No task
    ever holds more than one range of values.
    """
    from riskroll.session import ensure_checkpoint_dir

    b = n_parts or _default_buckets(values)
    ensure_checkpoint_dir(values.sparkSession)
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct()
    ranged = (distinct.repartitionByRange(b, col).withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    counts = sorted((r["_pid"], r["n"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, acc = [], 0
    for pid, n in counts:
        rows.append((pid, acc))
        acc += n
    offsets = values.sparkSession.createDataFrame(rows, "_pid int, _off long")
    w = Window.partitionBy("_pid").orderBy(col)
    return (ranged.join(F.broadcast(offsets), "_pid")
            .select(col, (F.col("_off") + F.row_number().over(w) - 1).alias(name)))
