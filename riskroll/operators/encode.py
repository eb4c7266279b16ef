"""Categorical encodings.

Dictionaries are fitted once (on the train table) and applied to any table,
so train and test always share codes.  Label / category codes stay
DataFrames (distinct values ranked by ``ordered.dense_codes``, range by
range) and are joined back, so a high-cardinality column never passes
through the driver or one task; one-hot needs its category list on the
driver to name the output columns, which is what one-hot is for
(low-cardinality columns).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskroll.operators.ordered import bounded_collect, dense_codes

# Fixed value: the class name that a null takes when it is encoded as a string.
NULL_CLASS = "None"


# Fixed value: largest dictionary (in bytes of its values and codes) that is broadcast.
MAX_BROADCAST_BYTES = 32 << 20
_NULL_SPREAD = 1024


@dataclass
class LabelCodes:
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)
    null_as: str | None = NULL_CLASS
    sizes: dict[str, int] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Codes in place of the values.  A dictionary of counted size up to ``MAX_BROADCAST_BYTES`` is broadcast, so no
        row moves; a larger one is joined by shuffle (AQE splits hot values), with nulls that have no code of their
        own spread over made-up keys that match nothing."""
        out = df
        for c, d in self.dictionaries.items():
            small = self.sizes.get(c, MAX_BROADCAST_BYTES + 1) <= MAX_BROADCAST_BYTES
            text = F.col(f"`{c}`").cast("string")
            if self.null_as is not None:
                text = F.coalesce(text, F.lit(self.null_as))
            elif not small:
                spread = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]), F.lit(_NULL_SPREAD))
                text = F.coalesce(text, F.concat(F.lit("\0"), spread.cast("string")))
            codes = d.withColumnRenamed("value", "_k")
            joined = out.withColumn("_k", text).join(F.broadcast(codes) if small else codes, "_k", "left").drop("_k")
            code = F.col("_code") if self.null_as is not None else F.coalesce(F.col("_code"), F.lit(-1))
            out = joined.select(*[code.cast("int").alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
        return out


def fit_label_encoder(train: DataFrame, columns: Sequence[str], null_as: str | None = NULL_CLASS) -> LabelCodes:
    """F9 (``null_as`` a string: null is one more class) and F10 (``null_as=None``: null -> -1).

    Codes are 0 … k-1 in sorted order of the string form.
    """
    dicts, sizes = {}, {}
    for c in columns:
        v = F.col(c).cast("string")
        vals = train.select((F.coalesce(v, F.lit(null_as)) if null_as is not None else v).alias("value"))
        dicts[c] = dense_codes(vals, "value")
        sizes[c] = int(dicts[c].agg(F.coalesce(F.sum(F.octet_length("value") + 16), F.lit(0))).first()[0])
    return LabelCodes(dicts, null_as, sizes)


@dataclass
class OneHot:
    categories: dict[str, list[str | None]] = field(default_factory=dict)

    def apply(self, df: DataFrame, drop: bool = True) -> DataFrame:
        new = []
        for c, cats in self.categories.items():
            v = F.col(c).cast("string")
            new += [v.eqNullSafe(F.lit(cat)).cast("int").alias(
                f"{c}_{cat}" if cat is not None else f"{c}_{NULL_CLASS}" if NULL_CLASS not in cats else f"{c}_null")
                for cat in cats]
        keep = [x for x in df.columns if not (drop and x in self.categories)]
        return df.select(*keep, *new)


# Fixed value: most categories one column may turn into 0/1 columns.
MAX_ONE_HOT_CATEGORIES = 1000


def fit_one_hot(train: DataFrame, columns: Sequence[str], max_categories: int = MAX_ONE_HOT_CATEGORIES) -> OneHot:
    """every category seen in ``train`` (null included) becomes a 0/1 column
    ``{column}_{category}`` (null: ``{column}_None``, or ``{column}_null`` beside a text 'None'); values not seen in train give all zeros.  A column with more than
    ``max_categories`` values is refused (its category list would be unbounded on the driver)."""
    cats = {}
    for c in columns:
        distinct = train.select(F.col(c).cast("string").alias("v")).distinct().orderBy(F.coalesce("v", F.lit(NULL_CLASS)), "v")
        cats[c] = [r["v"] for r in bounded_collect(distinct, max_categories, f"one-hot categories of {c}")]
    return OneHot(cats)
