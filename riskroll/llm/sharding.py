"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (DataFrame functions only).

1. Every source partition is permuted locally (a sort by a seeded hash; no exchange) and written once, so that all
   later passes and any recomputation see the same partitions.
2. The matrix of row counts from partition to shard follows the distribution that a uniform permutation of all rows
   has: margins fixed, cells multivariate hypergeometric.  It is drawn by halving the set of partitions again and
   again; a node splits each shard's count between its halves by exact inversion of the hypergeometric distribution
   function, in SQL higher-order functions.  Nodes of a level are independent rows.
3. Row j of a partition goes to the shard whose cumulated count covers j (a bisection).
4. Every shard is permuted again, in blocks of about ``block_rows`` rows that a seeded hash of the row's number deals
   (not of its content); the counts of the blocks before give a block's first slot.  No task holds a whole shard.

Law ``rows``: shard sizes differ by at most one.  Equal rows, equal texts or null keys don't matter: nothing is hashed
by content.  Beside the rows only the matrix (partitions x shards) and the block counts grow, and a row's work is the
same at every size.

Defined results: null text has size 8 and the checksum of no bytes; repeated rows are rows of their own; an empty
table gives no rows; further columns are untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, table, written

BLOCK_ROWS = 1 << 16
_LOCAL = (1 << 33) - 1


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked rows among ``drawn`` of ``total`` rows, by inversion at ``u``.

    The probabilities are summed from their recursion over 12 standard deviations (and 12) on either side of the mean;
    what lies beyond is below the resolution of a double.
    """
    mean = drawn * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(mean * (1 - marked / F.greatest(total, F.lit(1))) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked), F.floor(mean - 12 * spread - 12))
    high = F.least(marked, drawn, F.ceil(mean + 12 * spread + 12))
    given = F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), low.alias("low"),
                     high.alias("high"), u.alias("u"))

    def ratio(g: Column, k: Column) -> Column:  # of the probabilities of k + 1 and k
        return ((g["marked"] - k).cast("double") * (g["drawn"] - k)
                / ((k + 1).cast("double") * (g["total"] - g["marked"] - g["drawn"] + k + 1)))

    def weigh(g: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"))
        whole = F.aggregate(
            F.sequence(g["low"], g["high"]), start,
            lambda a, k: _let(a["weight"] * ratio(g, k),
                              lambda w: F.struct(w.alias("weight"), (a["sum"] + w).alias("sum"))),
            lambda a: a["sum"])
        return F.struct(g.alias("g"), (whole * g["u"]).alias("goal"))

    def pick(h: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), h["g"]["low"].alias("at"))
        return F.aggregate(
            F.sequence(h["g"]["low"], h["g"]["high"]), start,
            lambda a, k: F.when(a["sum"] > h["goal"], a).otherwise(
                _let(a["weight"] * ratio(h["g"], k), lambda w: F.struct(
                    w.alias("weight"), (a["sum"] + w).alias("sum"), (k + 1).alias("at")))),
            lambda a: F.least(a["at"], h["g"]["high"]))

    return _let(given, lambda g: _let(weigh(g), pick))


def _scan(values: Column, start: Column, step: Callable[[Column, Column], Column], run: int = 64) -> Column:
    """The ``out`` numbers of ``step(state, value)`` over an array, ``state`` from ``start`` on.

    Numbers are gathered in runs, so the arrays copied on the way stay short and the work is linear."""
    def one_run(a: Column, i: Column) -> Column:
        inner = F.aggregate(
            F.slice(values, i * run + 1, F.lit(run)), F.struct(a["state"].alias("state"), F.array().cast("array<bigint>").alias("out")),
            lambda b, v: _let(step(b["state"], v), lambda t: F.struct(
                t["state"].alias("state"), F.concat(b["out"], F.array(t["out"])).alias("out"))))
        return _let(inner, lambda x: F.struct(x["state"].alias("state"),
                                              F.concat(a["runs"], F.array(x["out"])).alias("runs")))

    zero = F.struct(start.alias("state"), F.array().cast("array<array<bigint>>").alias("runs"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / run).cast("int")), zero, one_run,
                       lambda a: F.flatten(a["runs"]))


def _halves(seed: int) -> Column:
    """The two children of a node (node, parts, shards); a single partition stays as it is."""
    left, right = F.slice("parts", 1, F.col("half")), F.slice("parts", F.col("half") + 1, F.size("parts"))

    def rows(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])

    start = F.struct(rows(F.col("parts")).alias("total"), rows(left).alias("drawn"), F.lit(1).alias("at"))

    def step(a: Column, marked: Column) -> Column:
        drawn = hypergeometric(a["total"], marked, a["drawn"], _uniform(F.lit(seed), F.col("node"), a["at"]))
        return _let(drawn, lambda x: F.struct(F.struct(
            (a["total"] - marked).alias("total"), (a["drawn"] - x).alias("drawn"), (a["at"] + 1).alias("at")).alias("state"),
            x.alias("out")))

    def node(number: Column, parts: Column, shards: Column) -> Column:
        return F.struct(number.alias("node"), parts.alias("parts"), shards.alias("shards"))

    split = _let(_scan(F.col("shards"), start, step), lambda x: F.array(
        node(F.col("node") * 2, left, x),
        node(F.col("node") * 2 + 1, right, F.zip_with("shards", x, lambda b, y: b - y))))
    return F.when(F.size("parts") == 1, F.array(node(F.col("node") * 2, F.col("parts"), F.col("shards")))).otherwise(split)


def communication_matrix(counts: DataFrame, sizes: Column, partitions: int, seed: int) -> DataFrame:
    """part, shards (rows it sends to each shard), from ``counts`` (part, n) and the array of shard sizes."""
    tree = counts.agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts")).select(
        F.lit(1).cast("long").alias("node"), "parts", sizes.alias("shards"))
    for level in range(math.ceil(math.log2(partitions)) if partitions > 1 else 0):
        if level == 5:
            tree = tree.repartition(32, "node")  # the further levels in parallel
        tree = tree.withColumn("half", F.ceil(F.size("parts") / 2).cast("int")).select(
            F.explode(_halves(seed)).alias("child")).select("child.*")
    return tree.select(F.element_at("parts", 1)["part"].alias("part"), "shards")


def _covering(ends: Column, place: Column, size: int) -> Column:
    """Number of the first of ``size`` ascending ``ends`` beyond ``place``, by bisection."""
    start = F.struct(F.lit(0).alias("low"), F.lit(size).alias("high"))  # the answer lies in [low, high)

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["low"] + a["high"], 1)
        return F.when(a["high"] - a["low"] <= 1, a).when(
            F.element_at(ends, mid) <= place, F.struct(mid.alias("low"), a["high"].alias("high"))).otherwise(
            F.struct(a["low"].alias("low"), mid.alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, size.bit_length()))), start, halve, lambda a: a["low"])


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 20261, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``row`` (the whole input row), shard and slot (gapless from 0 in a shard): a uniform shuffle."""
    number = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn(
        "id", F.monotonically_increasing_id())
    local = (number.withColumn("key", F.xxhash64(F.lit(seed), "id")).sortWithinPartitions("key", "id")
             .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL)))
             .select("row", "id", F.shiftright("id", 33).alias("part"), "place"))
    local = written(local, "shards-local", compression="zstd")  # whole rows: the copy on disk is kept small
    counts = local.groupBy("part").agg(F.count("*").alias("n"))
    total, partitions = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        return local.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: (
        F.lit(total // shards) + F.when(i < total % shards, 1).otherwise(0)).cast("long"))
    ends = _scan(F.col("shards"), F.lit(0).cast("long"),
                 lambda a, n: F.struct((a + n).alias("state"), (a + n).alias("out")))
    matrix = written(communication_matrix(counts, sizes, partitions, seed).select("part", ends.alias("ends")), "shards-matrix")
    blocks = -(-total // (shards * block_rows))
    sent = local.join(matrix, "part").select(
        "row", "id", _covering(F.col("ends"), F.col("place"), shards).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(blocks)).alias("block"))
    held = sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = written(held.select("shard", "block", (F.sum("n").over(
        Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before")), "shards-blocks")
    again = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 2), "id"), "id")
    return sent.withColumn("n", F.row_number().over(again) - 1).join(before, ["shard", "block"]).select(
        "row", "shard", (F.col("before") + F.col("n")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: int, seed: int = 20261, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The shuffle as files, a folder per shard in the shared folder: ``row`` (whole), slot and shard as read back."""
    dealt = shuffle_into_shards(docs, shards, seed, block_rows).select("row", "slot", "shard")
    path = shared_path(docs.sparkSession, "shards")
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents, whole, shuffled uniformly into 24 shards whose counts differ by at most one; sizes and
    checksums are those of the texts in the shards' files."""
    text = F.col("row.text")
    return write_shards(table(spark, sf_dir, "documents"), 24).select(
        "row.doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
