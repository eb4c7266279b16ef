"""Case-key joins (J1-J5), dedup (A5) and the merge to one row per case.

Roll-ups come out of ``groupBy(case_id)`` already hash-partitioned on the key,
so chaining them onto the base with left joins on the same key lets the
planner reuse that partitioning (one exchange per family, none extra for the
join).  AQE turns a join into a broadcast only when the runtime size of a
side is under ``spark.sql.autoBroadcastJoinThreshold``; nothing here forces a
broadcast of a side whose size grows with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskroll.operators.rollup import prefix_columns, rollup


def drop_common_columns(left: DataFrame, right: DataFrame, key: str = "case_id") -> DataFrame:
    """Drop from ``right`` every column ``left`` also has, except the key."""
    common = (set(left.columns) & set(right.columns)) - {key}
    return right.drop(*sorted(common)) if common else right


def dedup_first(df: DataFrame, key: str = "case_id", order_cols: Sequence[str] | None = None) -> DataFrame:
    """A5: keep the first row per key in ``order_cols`` order (ties broken by every column).

    Expressed as ``min_by(struct(row), struct(order))`` in a ``groupBy``, so it
    is a partial aggregate: a key holding a third of the table is reduced
    map-side instead of being sorted in a single window task.
    """
    others = [c for c in df.columns if c != key]
    order = list(order_cols or []) + [c for c in others if c not in (order_cols or [])]
    row = F.struct(*[F.col(c) for c in others])
    picked = df.groupBy(key).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def join_static(base: DataFrame, static: DataFrame, static_cb: DataFrame | None = None,
                key: str = "case_id", cb_order: Sequence[str] | None = None) -> DataFrame:
    """Depth 0: static ⟕ deduplicated bureau-static, common columns removed, then base ⟕ that."""
    depth0 = static
    if static_cb is not None:
        cb = dedup_first(static_cb, key, cb_order)
        depth0 = depth0.join(drop_common_columns(depth0, cb, key), key, "left")
    depth0 = drop_common_columns(base, depth0, key)
    return base.join(depth0, key, "left")


def semi_join_keys(df: DataFrame, keys: DataFrame, key: str = "case_id") -> DataFrame:
    """Keep rows whose key is in ``keys`` (a DataFrame, never a driver list)."""
    return df.join(keys.select(key), key, "left_semi")


def anti_join_keys(df: DataFrame, keys: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys.select(key), key, "left_anti")


def build_case_table(base: DataFrame, families: Mapping[str, DataFrame], key: str = "case_id",
                     restrict_to_base: bool = True, approx_nunique: bool = False) -> DataFrame:
    """J1 + J2 + A1 (+ J4): base ⟕ roll-up(family) for every child family.

    Histories of cases outside the base never reach the result.  ``restrict_to_base`` drops them by a semi-join before
    the roll-up; the join carries no hint, so the planner broadcasts the keys only while they are small and otherwise
    joins on the partitioning that the roll-up needs anyway.

    ``approx_nunique`` switches the roll-ups' distinct counts to HyperLogLog++.

    Output names that more than one family (or the base) produce, e.g.
    ``record_count`` or ``num_group1_max``, get the family name as a
    prefix instead of an engine-chosen suffix.
    """
    keys = base.select(key)
    rolled = {name: rollup(semi_join_keys(child, keys, key) if restrict_to_base else child, key,
                           approx_nunique=approx_nunique, null_keys=not restrict_to_base) for name, child in families.items()}
    counts: dict[str, int] = {}
    for df in [base, *rolled.values()]:
        for c in df.columns:
            counts[c] = counts.get(c, 0) + 1
    clashes = [c for c, n in counts.items() if n > 1 and c != key]
    out = base
    for name, df in rolled.items():
        out = out.join(prefix_columns(df, name, clashes, key), key, "left")
    return out
