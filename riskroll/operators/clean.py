"""Cleaning of wide tables.

Profiles (nulls, min/max) are one aggregate over all columns; quantiles and
medians take three or four jobs of one aggregate per ~100 columns, never one job
per column.  Fitted steps return a small
dataclass of literals whose ``apply`` is a single ``select`` (no chain of
``withColumn``), keeping the plan flat and inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskroll.functions.exprs import is_date_type, is_numeric_type

# Fixed values
SENTINEL = "a55475b1"
SPARSE_THRESHOLD = 0.8
NEVER_FEATURES = ("target", "case_id", "date_decision", "MONTH", "WEEK_NUM")
PROFILE_CHUNK = 100


def _chunks(items: Sequence, n: int = PROFILE_CHUNK):
    for i in range(0, len(items), n):
        yield items[i:i + n]


def _lit_name(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# --------------------------------------------------------------------------
# P3 / P13 null profile, P3 drop sparse
# --------------------------------------------------------------------------

def null_profile(df: DataFrame, threshold: float = SPARSE_THRESHOLD) -> DataFrame:
    """Long form ``column, null_count, null_ratio, keep`` in one pass over the data.

    One aggregate row (``count_if(isnull)`` per column plus the row count) is
    unpivoted with ``stack``; nothing is collected.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(F.col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    stack = "stack({}, {}) as (`column`, null_count)".format(
        len(cols), ", ".join(f"{_lit_name(c)}, _c{i}" for i, c in enumerate(cols)))
    long = one.selectExpr("_n", stack)
    ratio = F.when(F.col("_n") > 0, F.col("null_count") / F.col("_n")).otherwise(F.lit(0.0))
    return long.select(
        "column",
        F.col("null_count").cast("bigint").alias("null_count"),
        ratio.alias("null_ratio"),
        (ratio <= threshold).alias("keep"),
    )


def null_counts(df: DataFrame) -> dict[str, int]:
    """Null count per column (P13), one aggregate row per chunk of columns."""
    out: dict[str, int] = {}
    for chunk in _chunks(df.columns):
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_c{i}") for i, c in enumerate(chunk)]).first()
        out.update({c: int(row[i]) for i, c in enumerate(chunk)})
    return out


def drop_sparse(df: DataFrame, threshold: float = SPARSE_THRESHOLD) -> DataFrame:
    """Drop columns whose null share is strictly above ``threshold``; one pass over the input for all columns."""
    row = df.agg(F.count(F.lit(1)), *[F.count(F.col(_q(c))) for c in df.columns]).first()
    n = row[0]
    drop = [c for c, known in zip(df.columns, row[1:]) if n and (n - known) / n > threshold]
    return df.drop(*drop) if drop else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns means missing, as in the original's frames: null from here on."""
    return df.select(*[
        F.when(~F.isnan(F.col(_q(f.name))), F.col(_q(f.name))).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(_q(f.name)) for f in df.schema.fields])


# --------------------------------------------------------------------------
# P4 sentinel, P5 fill, P14 coerce, P15 casts
# --------------------------------------------------------------------------

def sentinel_null(df: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """Every string column: ``sentinel`` -> null."""
    return df.select(*[
        F.when(F.col(f.name) == F.lit(sentinel), F.lit(None).cast("string")).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields])


def fill_zero(df: DataFrame) -> DataFrame:
    """Numeric nulls -> 0 (strings and dates stay null)."""
    return df.select(*[
        F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        if is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType) else F.col(f.name)
        for f in df.schema.fields])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-parsable -> null -> 0, as double."""
    wanted = set(columns)
    return df.select(*[
        F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c) if c in wanted else F.col(c)
        for c in df.columns])


def cast_columns(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Explicit casts by name (labels -> int, features -> float, categoricals -> string)."""
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


# --------------------------------------------------------------------------
# P6 winsorise, A9 quantile bounds
# --------------------------------------------------------------------------

# Sketch accuracy (a bracket holds about 4 / ACCURACY of the rows around a rank) and the most values of
# one bracket that are gathered.
ACCURACY = 2000
BRACKET_VALUES = 10_000


@dataclass
class _Rank:
    """The value of one rank of one column: what lies strictly between ``low`` and ``high`` is still open."""

    column: str
    rank: int = 0
    low: object = None
    high: object = None
    below: int = 0
    inside: int = 0
    value: object = None
    done: bool = False


def exact_ranks(df: DataFrame, wanted: Sequence[tuple[str, float, Callable[[int], int]]]) -> list:
    """The exact value at a rank for each ``(column, share, rank of n)``; null for a column without values.

    One sketch pass per column gives a bracket around each rank (``percentile_approx`` returns values of the column);
    a counting pass says where the rank lies between them; what is left strictly inside (about 4 / ``ACCURACY`` of the
    rows, ties excluded) is gathered if it is at most ``BRACKET_VALUES`` values and bracketed again if not.  The same
    steps run at every size: three or four jobs over the columns, no shuffle of values, no table written.  Values keep
    the column's own type; null and NaN are no values, infinities are ordinary ones.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def value(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~F.isnan(c), c) if isinstance(types[name], (T.FloatType, T.DoubleType)) else c

    def inside(r: _Rank) -> Column:
        v, cond = value(r.column), F.lit(True)
        if r.low is not None:
            cond = cond & (v > F.lit(r.low).cast(types[r.column]))
        if r.high is not None:
            cond = cond & (v < F.lit(r.high).cast(types[r.column]))
        return F.when(cond, v)

    def run(jobs: list[tuple[_Rank, list[Column]]]) -> list[tuple[_Rank, list]]:
        out = []
        for part in _chunks(jobs):
            row = df.agg(*[c.alias(f"_{i}_{k}") for i, (_, cs) in enumerate(part) for k, c in enumerate(cs)]).first()
            out += [(r, [row[f"_{i}_{k}"] for k in range(len(cs))]) for i, (r, cs) in enumerate(part)]
        return out

    def sketch(r: _Rank, share: float) -> Column:
        probs = [min(1.0, max(0.0, share + d)) for d in (-2 / ACCURACY, 0.0, 2 / ACCURACY)]
        return F.percentile_approx(inside(r), probs, ACCURACY)

    ranks = [_Rank(c) for c, _, _ in wanted]
    started = run([(r, [F.count(value(r.column)), sketch(r, share)]) for r, (_, share, _) in zip(ranks, wanted)])
    probes = {}
    for (r, (n, points)), (_, _, rank_of) in zip(started, wanted):
        r.inside, r.done = n, not n
        r.rank = rank_of(n) if n else 0
        probes[id(r)] = points
    while left := [r for r in ranks if not r.done]:
        if tight := [r for r in left if id(r) not in probes]:
            gathered = [r for r in tight if r.inside <= BRACKET_VALUES]
            for r, (values,) in run([(r, [F.sort_array(F.collect_list(inside(r)))]) for r in gathered]):
                r.value, r.done = values[r.rank - r.below - 1], True
            wide = [r for r in tight if r.inside > BRACKET_VALUES]
            for r, (points,) in run([(r, [sketch(r, (r.rank - r.below) / r.inside)]) for r in wide]):
                probes[id(r)] = points
            continue
        stuck: list[_Rank] = []
        counted = run([(r, [F.count_if(value(r.column) < F.lit(p).cast(types[r.column])) for p in probes[id(r)]]
                        + [F.count_if(value(r.column) == F.lit(p).cast(types[r.column])) for p in probes[id(r)]])
                       for r in left])
        for r, counts in counted:
            before = (r.low, r.high)
            for p, below, equal in zip(probes.pop(id(r)), counts[:3], counts[3:]):
                if below < r.rank <= below + equal:
                    r.value, r.done = p, True
                    break
                if r.rank > below + equal and (r.low is None or p > r.low):
                    r.inside -= below + equal - r.below
                    r.low, r.below = p, below + equal
                elif r.rank <= below and (r.high is None or p < r.high):
                    r.inside = below - r.below
                    r.high = p
            if not r.done and before == (r.low, r.high):
                stuck.append(r)  # the sketch works in doubles: integers beyond 2**53 may all look alike to it
        for r, (least, most) in run([(r, [F.min(inside(r)), F.max(inside(r))]) for r in stuck]):
            probes[id(r)] = [least, least + (most - least) // 2 if isinstance(least, int) else least, most]
    return [r.value for r in ranks]


def _rank_disc(p: float) -> Callable[[int], int]:
    """Smallest rank whose cumulative share reaches ``p``."""
    return lambda n: max(1, math.ceil(p * n))


def _rank_nearest(p: float) -> Callable[[int], int]:
    """Rank nearest to position (n - 1) p, halves up."""
    return lambda n: min(n, math.floor((n - 1) * p + 0.5) + 1)


QUANTILE_RANKS = {"disc": _rank_disc, "nearest": _rank_nearest}


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "disc") -> dict[str, list]:
    """Exact quantiles of many columns at once, in the columns' types; see ``exact_ranks``."""
    rank = QUANTILE_RANKS[method]
    values = exact_ranks(df, [(c, p, rank(p)) for c in columns for p in probs])
    return {c: values[i * len(probs):(i + 1) * len(probs)] for i, c in enumerate(columns)}


def quantile_bounds(df: DataFrame, columns: Sequence[str], lower: float = 0.01, upper: float = 0.99,
                    method: str = "disc") -> DataFrame:
    """Long form ``column, q_low, q_high`` (double).  ``method`` ``disc`` is ``percentile_disc``; ``nearest`` takes
    the value nearest to position (n - 1) p."""
    found = quantile_values(df, columns, [lower, upper], method)
    return df.sparkSession.createDataFrame(
        [(c, *[None if v is None else float(v) for v in vs]) for c, vs in found.items()],
        "`column` string, q_low double, q_high double")


@dataclass
class WinsorBounds:
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema.fields:
            lo, hi = self.bounds.get(f.name, (None, None))
            if lo is None or hi is None:
                out.append(F.col(f.name))
                continue
            c = F.col(f"`{f.name}`")
            low, high = F.lit(lo).cast(f.dataType), F.lit(hi).cast(f.dataType)
            out.append(F.when(c < low, low).when(c > high, high).otherwise(c).alias(f.name))
        return df.select(*out)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType) and f.name not in exclude]


def fit_winsor(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = NEVER_FEATURES,
               lower: float = 0.01, upper: float = 0.99, method: str = "disc") -> WinsorBounds:
    """Fit q_low / q_high per numeric column (keys, label and periods excluded), in the column's own type."""
    cols = list(columns) if columns is not None else numeric_columns(df, exclude)
    return WinsorBounds({c: tuple(v) for c, v in quantile_values(df, cols, [lower, upper], method).items()})


def winsorize(df: DataFrame, exclude: Sequence[str] = NEVER_FEATURES, lower: float = 0.01,
              upper: float = 0.99) -> DataFrame:
    """Clip every numeric column (but ``exclude``) to its own quantile bounds; NaN stays NaN."""
    return fit_winsor(df, exclude=exclude, lower=lower, upper=upper).apply(df)


# --------------------------------------------------------------------------
# P7 shrink types
# --------------------------------------------------------------------------

_INT_RANGES = [("tinyint", -2 ** 7, 2 ** 7 - 1), ("smallint", -2 ** 15, 2 ** 15 - 1),
               ("int", -2 ** 31, 2 ** 31 - 1), ("bigint", -2 ** 63, 2 ** 63 - 1)]


def shrink_plan(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Long form ``column, min_value, max_value, shrunk_type`` for the integer columns."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and f.name not in exclude]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).cast("bigint").alias(f"_l{i}"), F.max(c).cast("bigint").alias(f"_h{i}")]
    one = df.agg(*aggs)
    stack = "stack({}, {}) as (`column`, min_value, max_value)".format(
        len(cols), ", ".join(f"{_lit_name(c)}, _l{i}, _h{i}" for i, c in enumerate(cols)))
    long = one.selectExpr(stack)
    choice = None
    for name, lo, hi in _INT_RANGES:
        cond = (F.col("min_value") >= F.lit(lo)) & (F.col("max_value") <= F.lit(hi))
        choice = F.when(cond, F.lit(name)) if choice is None else choice.when(cond, F.lit(name))
    return long.select("column", "min_value", "max_value", choice.otherwise(F.lit("bigint")).alias("shrunk_type"))


def lossless_floats(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """The double columns whose values are all single-precision numbers (NaN and null are); one pass for all columns."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and f.name not in exclude]
    out: list[str] = []
    for chunk in _chunks(cols):
        row = df.agg(*[F.count_if(~F.col(_q(c)).cast("float").cast("double").eqNullSafe(F.col(_q(c)))).alias(f"_c{i}")
                       for i, c in enumerate(chunk)]).first()
        out += [c for i, c in enumerate(chunk) if not row[i]]
    return out


def shrink_types(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Cast each integer column to the narrowest integer type holding its values, and each double column without
    loss to float."""
    plan = {r["column"]: r["shrunk_type"] for r in shrink_plan(df, exclude).collect()}
    return cast_columns(df, {**plan, **{c: "float" for c in lossless_floats(df, exclude)}})


# --------------------------------------------------------------------------
# P8 type filter, P10 type inference
# --------------------------------------------------------------------------

def numeric_features(df: DataFrame, exclude: Sequence[str] = NEVER_FEATURES) -> list[str]:
    """Int / float / bool columns that are not ids, label, decision date or periods."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, date_share: float = 0.5) -> DataFrame:
    """P10: long form ``column, parsed_share, inferred`` in one pass.

    A string column whose non-null values parse as dates in at least
    ``date_share`` of the rows is a date, any other string column is
    categorical; numeric columns are numeric, date columns date.  The share is
    an aggregate over the whole column, so the answer never depends on row order.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = []
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.StringType):
            c = F.col(f.name)
            share = F.try_divide(F.count_if(F.try_to_date(c).isNotNull()).cast("double"),
                                 F.count(c).cast("double"))
            aggs.append(F.coalesce(share, F.lit(0.0)).alias(f"_s{i}"))
        else:
            aggs.append(F.lit(None).cast("double").alias(f"_s{i}"))
    one = df.agg(*aggs)
    kinds = []
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.StringType):
            kinds.append(f"{_lit_name(f.name)}, _s{i}, CASE WHEN _s{i} >= {date_share} THEN 'date' ELSE 'categorical' END")
        elif is_date_type(f.dataType):
            kinds.append(f"{_lit_name(f.name)}, _s{i}, 'date'")
        elif is_numeric_type(f.dataType):
            kinds.append(f"{_lit_name(f.name)}, _s{i}, 'numeric'")
        else:
            kinds.append(f"{_lit_name(f.name)}, _s{i}, 'other'")
    return one.selectExpr(f"stack({len(fields)}, {', '.join(kinds)}) as (`column`, parsed_share, inferred)")


# --------------------------------------------------------------------------
# P12 median / mode imputation
# --------------------------------------------------------------------------

@dataclass
class Imputer:
    fills: dict[str, object] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill nulls with the fitted values; an imputed integer column becomes double (its
        median may be fractional), as a column with missing values is float in the original."""
        out = []
        for f in df.schema.fields:
            fill = self.fills.get(f.name)
            if fill is None:
                out.append(F.col(f.name))
            elif isinstance(f.dataType, T.StringType):
                out.append(F.coalesce(F.col(f.name), F.lit(fill)).alias(f.name))
            else:
                out.append(F.coalesce(F.col(f.name).cast("double"), F.lit(float(fill))).alias(f.name))
        return df.select(*out)


def fit_imputer(train: DataFrame, exclude: Sequence[str] = ("case_id", "target")) -> Imputer:
    """Median for numeric and mode (most frequent, ties -> smallest) for string
    columns, fitted on ``train`` and only for columns that have nulls there."""
    nulls = null_counts(train)
    num = [f.name for f in train.schema.fields if is_numeric_type(f.dataType)
           and not isinstance(f.dataType, T.BooleanType) and nulls[f.name] > 0 and f.name not in exclude]
    cat = [f.name for f in train.schema.fields if isinstance(f.dataType, T.StringType)
           and nulls[f.name] > 0 and f.name not in exclude]
    fills: dict[str, object] = {}
    # the interpolated median lies between the two middle ranks
    middle = exact_ranks(train, [(c, 0.5, f) for c in num for f in (lambda n: (n + 1) // 2, lambda n: n // 2 + 1)])
    for c, low, high in zip(num, middle[::2], middle[1::2]):
        if low is not None:
            fills[c] = (float(low) + float(high)) / 2
    if cat:
        fills.update({r["column"]: r["mode"] for r in modes(train, cat).collect()})
    return Imputer(fills)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column (ties -> smallest), all columns in one shuffle.

    The table is unpivoted to ``(column, value)``, counted per pair (partial
    aggregation absorbs hot values), then ``min_by`` picks the mode.
    """
    stack = "stack({}, {}) as (`column`, value)".format(
        len(columns), ", ".join(f"{_lit_name(c)}, CAST({_q(c)} AS STRING)" for c in columns))
    long = df.selectExpr(stack).where(F.col("value").isNotNull())
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
