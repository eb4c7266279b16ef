"""Exact nearest neighbours by pivots, and ADASYN oversampling on them.

No cross join and no cap on candidates.  Points are dealt to cells around pivots (points drawn by hash); the points of
a cell are cut into blocks by their distance to its pivot, ``BLOCK`` at most.  A query searches one block of its own
cell, which bounds the distance of its k-th neighbour, and then only the blocks that the triangle inequality can't
exclude: for a point s in the cell of pivot p with query q and bound U,

* |d(q, p) - d(s, p)| <= U, compared with the block's smallest and largest distance to p, and
* (d(q, p) - d(q, own pivot)) / 2 <= U.

Inside a block a matrix product leaves out the points that are surely farther than the k-th; only the rest is measured.
Bounds are widened by a relative 1e-9; distances themselves are squared differences summed in the order of the
features, so that another engine gets the same numbers.  Ties go to the smaller id.

Equal points: the k + 1 smallest ids of each vector are all that k neighbours can need, so a vector with a third of all
rows is k + 1 points (a ranking limit, kept map-side).  A block wanted by very many queries is copied to several tasks.

The distances are computed by numpy on Arrow batches: Spark has no built-in for a point against a block of points.
On the driver: the pivots and one radius per cell (``MAX_PIVOTS`` at most).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskroll.functions.exprs import hash_uniform
from riskroll.operators import sampling
from riskroll.session import ensure_checkpoint_dir, ship_package

# Fixed values
ADASYN_NEIGHBOURS = 5
MAX_PIVOTS = 1024
BLOCK = 4096
#: Queries of one block that one task searches.
QUERIES_A_TASK = 65_536
_SHIFT = BLOCK.bit_length() - 1
SLACK = 1e-9
#: Squared length up to which no product overflows.
LONGEST = 1e300


def _kept(df: DataFrame) -> DataFrame:
    """Computed once: several steps read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``, summed over the features in their order."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        out += diff * diff
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def nearest(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ``points`` (id long, x array<double>) of every query (same columns), a point of its own id
    left out: ``query, rank, neighbour, distance2``; fewer where there are fewer points."""
    spark = points.sparkSession
    ship_package(spark)
    of_vector = Window.partitionBy("x").orderBy("id")
    points = _kept(points.withColumn("_n", F.row_number().over(of_vector)).where(F.col("_n") <= k + 1).drop("_n"))
    n = points.count()
    schema = "query long, neighbour long, distance2 double"
    if not n:
        return spark.createDataFrame([], "query long, rank int, neighbour long, distance2 double")
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(min(MAX_PIVOTS, max(8, math.isqrt(n))))
    pivots = np.array([r["x"] for r in chosen.collect()], dtype=float)

    def deal(batches):
        for batch in _chunks(batches):
            d2 = squared(_vectors(batch.column("x")), pivots)
            cell = d2.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.array(cell, pa.int32()), pa.array(np.sqrt(d2[np.arange(len(cell)), cell]))],
                names=["id", "x", "cell", "r"])

    dealt = points.select("id", "x").mapInArrow(deal, "id long, x array<double>, cell int, r double")
    placed = _kept(dealt.repartitionByRange("cell", "r", "id").sortWithinPartitions("cell", "r", "id").withColumn(
        "block", F.shiftright(F.monotonically_increasing_id(), _SHIFT)))
    blocks = _kept(placed.groupBy("block", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high")))
    radius = np.full(len(pivots), -np.inf)
    for r in blocks.groupBy("cell").agg(F.max("high").alias("high")).collect():
        radius[r["cell"]] = r["high"]

    def start(batches):
        for batch in _chunks(batches):
            d2 = squared(_vectors(batch.column("x")), pivots)
            cell = d2.argmin(axis=1)
            own = np.sqrt(d2[np.arange(len(cell)), cell])
            bound = np.sqrt(np.partition(d2, k, axis=1)[:, k]) if len(pivots) > k else np.full(len(cell), np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cell, pa.int32()), pa.array(own),
                                              pa.array(bound)], names=["query", "x", "cell", "d", "bound"])

    started = _kept(queries.select("id", "x").mapInArrow(start, "query long, x array<double>, cell int, d double, bound double"))
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    first = started.select("query", "cell", "d").join(blocks, "cell").groupBy("query", "cell").agg(
        F.min_by("block", F.struct(gap, F.col("block"))).alias("block"))
    first = _kept(started.join(first, ["query", "cell"]))
    near = _kept(_searched(first.select("query", "x", "block", "cell"), placed, k, schema))
    kth = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max("distance2")).alias("kth"))
    bounded = first.join(kth, "query", "left").select(
        "query", "x", F.col("block").alias("done"), F.col("cell").alias("own"),
        F.when(F.col("n") >= k, F.least("bound", "kth")).otherwise(F.col("bound")).alias("bound"))

    def onward(batches):
        for batch in _chunks(batches):
            d = np.sqrt(squared(_vectors(batch.column("x")), pivots))
            bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
            own = d.min(axis=1, keepdims=True)
            room = bound + SLACK * (bound + d)
            row, cell = np.nonzero((d - radius[None, :] <= room) & (d - own <= 2 * room))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query").take(take), batch.column("x").take(take), pa.array(cell, pa.int32()), pa.array(d[row, cell]),
                 pa.array(room[row, cell]), batch.column("own").take(take), batch.column("done").take(take)],
                names=["query", "x", "cell", "d", "room", "own", "done"])

    wanted = bounded.mapInArrow(onward, "query long, x array<double>, cell int, d double, room double, own int, done long").join(
        blocks, "cell").where((F.col("low") <= F.col("d") + F.col("room")) & (F.col("high") >= F.col("d") - F.col("room"))
                              & ~((F.col("cell") == F.col("own")) & (F.col("block") == F.col("done"))))
    far = _searched(wanted.select("query", "x", "block", "cell"), placed, k, schema)
    best = Window.partitionBy("query").orderBy("distance2", "neighbour")
    return near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query", "rank", "neighbour", "distance2")


def _searched(wanted: DataFrame, placed: DataFrame, k: int, schema: str) -> DataFrame:
    """The k nearest points of each query in each block it wants: ``wanted`` (query, x, block, cell)."""
    wanted = _kept(wanted)
    tasks = wanted.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_TASK).cast("int").alias("copies"))
    asked = wanted.join(tasks, ["block", "cell"]).select(
        "block", "cell", (F.monotonically_increasing_id() % F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"),
        F.col("query").alias("id"), "x")
    there = placed.join(tasks, ["block", "cell"]).select(
        "block", "cell", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "id", "x")
    keys = ["block", "cell", "copy"]
    met = there.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "id")

    def run(batches):
        here, ids, xs, points = None, [], [], None
        for batch in _chunks(batches, 256):
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)]
            all_ids, all_x = batch.column("id").to_numpy(zero_copy_only=False), _vectors(batch.column("x"))
            for a, b in zip(cuts, cuts[1:]):
                group, kind = tuple(marks[a, :3]), marks[a, 3]
                if group != here:
                    here, ids, xs, points = group, [], [], None
                if not kind:
                    ids.append(all_ids[a:b])
                    xs.append(all_x[a:b])
                    continue
                if points is None:
                    points = np.concatenate(ids), np.concatenate(xs)
                yield _top(all_ids[a:b], all_x[a:b], *points, k)

    return met.mapInArrow(run, schema)


def _candidates(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of query and point of all pairs that can be among a query's k nearest, one point more left aside.

    A matrix product gives every squared distance within ``error``; only pairs within it of the (k + 1)-th smallest
    are kept (one may be the query itself)."""
    lengths = [np.einsum("ij,ij->i", v, v) for v in (queries, points)]
    if len(points) <= k + 1 or not all((n < LONGEST).all() for n in lengths):
        row, col = np.indices((len(queries), len(points)))
        return row.ravel(), col.ravel()
    rough = queries @ points.T  # less the query's squared length, which is the same for all points
    rough *= -2.0
    rough += lengths[1]
    error = 4 * (points.shape[1] + 8) * np.finfo(float).eps * (lengths[0] + lengths[1].max()) + np.finfo(float).tiny
    bound = np.partition(rough, k, axis=1)[:, k] + 4 * error
    return np.nonzero(rough <= bound[:, None])


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> pa.RecordBatch:
    row, col = _candidates(queries, points, k)
    other = query_ids[row] != ids[col]
    row, col = row[other], col[other]
    d2 = np.zeros(len(row))
    for j in range(points.shape[1]):  # the same sums as in ``squared``
        diff = queries[row, j] - points[col, j]
        d2 += diff * diff
    order = np.lexsort((ids[col], d2, row))
    order = order[np.isfinite(d2[order])]
    row, col, d2 = row[order], col[order], d2[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, d2 = row[place < k], col[place < k], d2[place < k]
    return pa.RecordBatch.from_arrays([pa.array(query_ids[row], pa.int64()), pa.array(ids[col], pa.int64()), pa.array(d2)],
                                      names=["query", "neighbour", "distance2"])


# --------------------------------------------------------------------------
# ADASYN
# --------------------------------------------------------------------------

def _points(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    values = [F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    return df.select(F.col(key).cast("long").alias("id"), F.array(*values).alias("x"))


def adasyn_density(df: DataFrame, features: Sequence[str], ratio: float = 0.5, label: str = "target", key: str = "case_id",
                   k: int = ADASYN_NEIGHBOURS) -> DataFrame:
    """R6, first half: ``key, majority`` (majority rows among the k nearest of all rows), ``share`` of it, ``copies``
    (synthetic rows to make) of every minority row.

    The copies are the nearest integers to ``majority / sum(majority) * G``, G = int(ratio * majority rows - minority
    rows); none where no minority row has a majority neighbour.  ``key`` is a unique integer; a null or NaN feature is 0.
    """
    counts = sampling.class_counts(df, label)
    minority, majority = _classes(counts)
    wanted = max(0, int(counts[majority] * ratio - counts[minority]))
    points = _points(df.where(F.col(label).isNotNull()), features, key)
    queries = _points(df.where(F.col(label) == F.lit(minority)), features, key)
    labels = df.select(F.col(key).cast("long").alias("neighbour"), F.col(label).alias("_label"))
    met = nearest(points, queries, k).join(labels, "neighbour").groupBy("query").agg(
        F.count_if(F.col("_label") == F.lit(majority)).alias("majority"), F.count(F.lit(1)).alias("n"))
    own = _kept(df.where(F.col(label) == F.lit(minority)).select(key).join(
        met, F.col(key).cast("long") == F.col("query"), "left").select(
        key, F.coalesce("majority", F.lit(0)).cast("long").alias("majority"), F.col("n")))
    total = own.agg(F.sum("majority")).first()[0] or 0
    copies = F.rint(F.col("majority") * F.lit(float(wanted)) / F.lit(float(total))) if total else F.lit(0)
    return own.select(key, "majority", F.coalesce(F.try_divide(F.col("majority").cast("double"), F.col("n")), F.lit(0.0)).alias("share"),
                      copies.cast("int").alias("copies"))


def _classes(counts: dict) -> tuple:
    if len(counts) != 2:
        raise ValueError(f"two classes are needed, not {len(counts)}")
    minority = min(counts, key=lambda c: (counts[c], -c))
    return minority, next(c for c in counts if c != minority)


def adasyn_rows(df: DataFrame, features: Sequence[str], ratio: float = 0.5, label: str = "target", key: str = "case_id",
                k: int = ADASYN_NEIGHBOURS, seed=sampling.SEED) -> DataFrame:
    """R6, second half: the synthetic rows ``key`` (of the row they start from), ``copy`` (from 1), ``neighbour``, features.

    Copy j of a minority row lies between it and one of its k nearest minority rows, both chosen by hash: x + u (z - x).
    A minority row without another one gives no copies.
    """
    density = adasyn_density(df, features, ratio, label, key, k).where(F.col("copies") > 0)
    minority, _ = _classes(sampling.class_counts(df, label))
    points = _kept(_points(df.where(F.col(label) == F.lit(minority)), features, key))
    starts = points.join(density.select(F.col(key).cast("long").alias("id"), "copies"), "id")
    met = nearest(points, starts.select("id", "x"), k).groupBy("query").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda r: r["neighbour"]).alias("near"))
    made = starts.join(met, F.col("id") == F.col("query")).select(
        "id", "x", "near", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).withColumn(
        "_name", F.concat_ws("-", "id", "copy"))
    made = made.withColumn("neighbour", F.element_at("near", (hash_uniform("_name", f"{seed}-near") % F.size("near") + 1).cast("int")))
    made = made.withColumn("_u", hash_uniform("_name", f"{seed}-step") / F.lit(4294967296.0))
    other = points.select(F.col("id").alias("neighbour"), F.col("x").alias("_z"))
    between = F.zip_with("x", "_z", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    moved = made.join(other, "neighbour").withColumn("_both", between)
    return moved.select(F.col("id").alias(key), "copy", "neighbour", *[
        (F.col("_both")[i]["a"] + F.col("_u") * (F.col("_both")[i]["b"] - F.col("_both")[i]["a"])).alias(f)
        for i, f in enumerate(features)])


def adasyn(df: DataFrame, features: Sequence[str], ratio: float = 0.5, label: str = "target", key: str = "case_id",
           k: int = ADASYN_NEIGHBOURS, seed=sampling.SEED) -> DataFrame:
    """``df`` (key, label, features) with its synthetic minority rows, which have a null key."""
    df = _kept(df.select(key, label, *features))
    minority, _ = _classes(sampling.class_counts(df, label))
    types = {f.name: f.dataType for f in df.schema.fields}
    new = adasyn_rows(df, features, ratio, label, key, k, seed).select(
        F.lit(None).cast(types[key]).alias(key), F.lit(minority).cast(types[label]).alias(label), *features)
    return df.select(key, label, *[F.col(f).cast("double").alias(f) for f in features]).unionByName(new)
