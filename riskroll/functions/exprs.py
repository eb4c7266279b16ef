"""Column-expression helpers shared by the operators.

All helpers return ``pyspark.sql.Column`` objects built from built-in
functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_uniform(id_col: Column | str, seed: str | int = 42) -> Column:
    """Deterministic pseudo-random number in [0, 2**32) per id.

    ``u(id, seed)`` = first 8 hex digits of ``md5("{id}:{seed}")`` read as an
    integer.  It depends only on the id (never on partitioning or task
    retries), so samples and splits are reproducible and have a SQL twin.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_unit(id_col: Column | str, seed: str | int = 42) -> Column:
    """``hash_uniform`` scaled to [0, 1)."""
    return hash_uniform(id_col, seed) / F.lit(float(2 ** 32))


def safe_div(num: Column, den: Column) -> Column:
    """``num / (den + 1)`` with null instead of an ANSI error on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double") + F.lit(1.0))


def days_between(col: Column, ref: Column, is_timestamp: bool) -> Column:
    """Whole days from ``col`` to ``ref`` (``ref - col``), truncated toward zero."""
    if is_timestamp:
        return F.timestamp_diff("DAY", col, ref).cast("bigint")
    return F.datediff(ref, col).cast("bigint")


def lenient_date(col: Column, dtype: T.DataType) -> Column:
    """String -> date with unparsable values as null; dates pass through."""
    if isinstance(dtype, T.DateType):
        return col
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return col.cast("date")
    return F.try_to_date(col.cast("string"))


def date_mean(col: Column) -> Column:
    """Mean of a date column as a date (floor of the mean day number)."""
    return F.date_from_unix_date(F.floor(F.avg(F.unix_date(col))).cast("int"))


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_date_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def snap(c: Column) -> Column:
    """Round a double to 6 decimals the same way in every engine.

    Two IEEE steps (to 9, then to 6 decimals, half up) so that results that
    differ only in the last bits because of summation order land on the same
    value; magnitudes of 1e9 and more are left as they are.
    """
    x = c.cast("double")
    nine = F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
    six = F.floor(nine * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    return F.when(F.abs(x) < F.lit(1e9), six).otherwise(x)


def round_doubles(df):
    """Snap every double column (used at the edge of oracle-checked queries)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(snap(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
