"""Whitening of embeddings by distributed block matrices (Spark MLlib ``BlockMatrix``).

1. Every vector becomes integers x = floor(64 c) + 1000000.  The fit list holds each distinct x once (a map-side
   combined ``distinct``, so a vector with a third of all rows is one entry).
2. Rows are numbered (partition, place in it, sums of earlier partitions) and dealt into blocks of consecutive numbers.
3. Scatter: the centred fit list as a column of blocks, A; transpose(A) x A, its middle dimension split over many tasks
   (``numMidDimSplits``, which the Python method leaves out: one task would get all rows).
4. ``numpy.linalg.eigh`` on the driver: the covariance has dimension squared entries, whatever the number of rows.
5. Projection: the blocks of centred rows are laid out as a square grid and multiplied by the block-diagonal matrix of
   whitening matrices; a grid that is square is dealt evenly by MLlib's partitioner, a single column is not.

Counts, sums and deviations are exact integers; vectors are centred as (n x - S) / n.  The driver holds the keys of at
most ``MAX_BLOCKS`` blocks, the covariance and the components.

Defined results: null vectors and vectors with a null or non-finite entry are dropped, as are vectors without entries;
null and repeated vec_ids are rows of their own; components stop before eigenvalues that are zero to rounding (below
1e-12 of the largest), so a table of one distinct vector, or none, gives no rows; further columns are ignored.  Vectors
of different lengths and values that 64-bit integers can't hold exactly are errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import pieces, shared_path, table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
MAX_BLOCKS = 200_000
#: Blocks multiplied by one task of the scatter.
BLOCKS_A_TASK = 8
MAX_DIMENSION = 8192
ZERO = 1e-12
_ROW = (1 << 33) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (64-bit integers, little-endian) of all rows with a finite vector."""
    entries = F.col("embedding").cast("array<double>")
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = batch.column("embedding")
            values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            if len(values) and np.abs(values).max() >= 1 << 53:
                raise OverflowError("an entry beyond 2**47 has no exact integer")
            x = (values.astype("<i8") + SHIFT).tobytes()
            ends = 8 * np.cumsum(lists.value_lengths().to_numpy())
            own = [x[e - 8 * n:e] for e, n in zip(ends, lists.value_lengths().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.binary())], names=["vec_id", "x"])

    return vectors.filter(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), entries.alias("embedding")).mapInArrow(run, "vec_id long, x binary")


def blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` (vec_id, x) dealt into blocks of consecutive numbers: block, vec_ids, x (one after the other)."""
    numbered = written(rows.withColumn("at", F.monotonically_increasing_id()), "whitening-rows").withColumn(
        "part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(_ROW)))
    parts = written(numbered.groupBy("part").agg(F.count("*").alias("n")), "whitening-parts")  # a row per partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = numbered.join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("at")).alias("number"), "vec_id", "x").withColumn(
        "block", F.floor(F.col("number") / block_rows))

    def run(batches):
        block, ids, xs = None, [], []

        def done():
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "vec_ids": pa.array([ids], pa.list_(
                pa.int64())), "x": pa.array([b"".join(xs)], pa.binary())})

        for batch in pieces(batches):
            for b, i, x in zip(*(batch.column(c).to_pylist() for c in ("block", "vec_id", "x"))):
                if b != block and ids:
                    yield done()
                    ids, xs = [], []
                block = b
                ids.append(i)
                xs.append(x)
        if ids:
            yield done()

    dealt = numbered.repartition("block").sortWithinPartitions("block", "number")
    return written(dealt.mapInArrow(run, "block long, vec_ids array<bigint>, x binary"), "whitening-blocks")


def stored_matrix(values: np.ndarray) -> dict:
    """A dense matrix as MLlib stores one (column by column)."""
    return {"type": 1, "numRows": values.shape[0], "numCols": values.shape[1], "colPtrs": None, "rowIndices": None,
            "values": values.ravel(order="F"), "isTransposed": False}


def _block_matrix(dealt: DataFrame, make, name: str, sizes: tuple[int, int, int, int]) -> BlockMatrix:
    """MLlib matrix of the blocks that ``make`` (row to block row, block column, array) makes of ``dealt``.

    The blocks are written with MLlib's own storage type and read in the JVM by every pass, never through Python.
    """
    def run(batches):
        for batch in pieces(batches, 1):
            for row in batch.to_pylist():
                i, j, values = make(row)
                yield pa.RecordBatch.from_pylist(
                    [{"blockIndex": {"_1": i, "_2": j}, "subMatrix": stored_matrix(values)}], schema=_ARROW_MATRIX)

    path = shared_path(dealt.sparkSession, f"whitening-{name}")
    dealt.mapInArrow(run, _MATRIX).write.parquet(path)
    typed = StructType([StructField("blockIndex", StructType([StructField("_1", LongType()), StructField("_2", LongType())])),
                        StructField("subMatrix", MatrixUDT())])
    return BlockMatrix(callMLlibFunc("createBlockMatrix", dealt.sparkSession.read.schema(typed).parquet(path), *sizes), *sizes[:2])


_MATRIX = ("blockIndex struct<_1:bigint,_2:bigint>, subMatrix struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,"
           "rowIndices:array<int>,values:array<double>,isTransposed:boolean>")
_ARROW_MATRIX = pa.schema([
    ("blockIndex", pa.struct([("_1", pa.int64()), ("_2", pa.int64())])),
    ("subMatrix", pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
                             ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())]))])


def scatter(dealt: DataFrame, make, n_blocks: int, block_rows: int, width: int) -> np.ndarray:
    """transpose(A) x A of the matrix whose blocks (``make``: row to array) stand in one column."""
    a = _block_matrix(dealt, lambda r: (r["block"], 0, make(r)), "column", (block_rows, width, n_blocks * block_rows, width))
    product = a.transpose()._java_matrix_wrapper.call(
        "multiply", a._java_matrix_wrapper._java_model, max(1, math.ceil(n_blocks / BLOCKS_A_TASK)))
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def product(dealt: DataFrame, make, n_blocks: int, block_rows: int, right: np.ndarray) -> DataFrame:
    """A x ``right``, A as in ``scatter``: block, y (its rows, doubles, one after the other), written."""
    side = max(1, math.isqrt(max(n_blocks - 1, 0)) + 1)
    width, out = right.shape
    spark = dealt.sparkSession
    a = _block_matrix(dealt, lambda r: (r["block"] // side, r["block"] % side, make(r)), "grid",
                      (block_rows, width, side * block_rows, side * width))
    # MLlib deals the grid to about as many tasks as either factor has partitions
    shared = DenseMatrix(width, out, right.ravel(order="F"))
    diagonal = spark.sparkContext.parallelize(range(side), side).map(lambda i: ((i, i), shared)).repartition(max(side, n_blocks))
    w = BlockMatrix(diagonal, width, out, side * width, side * out)
    path = shared_path(spark, "whitening-product")
    callMLlibFunc("getMatrixBlocks", a.multiply(w)._java_matrix_wrapper._java_model).toDF("blockIndex", "subMatrix").write.parquet(path)

    def run(batches):
        for batch in pieces(batches, 1):
            for row in batch.to_pylist():
                m = row["subMatrix"]
                values = np.array(m["values"]).reshape(m["numRows"], m["numCols"], order="C" if m["isTransposed"] else "F")
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["blockIndex"]["_1"] * side + row["blockIndex"]["_2"]], pa.int64()),
                    "y": pa.array([values.astype("<f8").tobytes()], pa.binary())})

    return spark.read.schema(_MATRIX).parquet(path).mapInArrow(run, "block long, y binary")


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, components (rows), their eigenvalues, the trace and the identity's error."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def matrix(self) -> np.ndarray:
        return (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def _sums(dealt: DataFrame, column: str, dtype: str, width: int) -> np.ndarray:
    """Sums per dimension of the rows in ``column``, summed in their tasks and then by dimension."""
    kind = "long" if dtype == "<i8" else "double"

    def run(batches):
        total = np.zeros(width, dtype=dtype)
        for batch in pieces(batches, 1):
            for x in batch.column(column).to_pylist():
                total += np.frombuffer(x, dtype=dtype).reshape(-1, width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"d": pa.array(range(width), pa.int32()), "s": pa.array(total)})

    rows = dealt.select(column).mapInArrow(run, f"d int, s {kind}").groupBy("d").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width, dtype=dtype)
    for r in rows:
        out[r.d] = r.s
    return out


def _centred(n: int, sums: np.ndarray):
    """A block's centred rows."""
    return lambda row: (n * np.frombuffer(row["x"], dtype="<i8").reshape(-1, len(sums)) - sums) / n


def block_rows_of(n: int) -> int:
    return max(BLOCK_ROWS, math.ceil(n / MAX_BLOCKS))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (vec_id, x) by their distinct vectors; None if there are no rows."""
    distinct = written(rows.select("x").distinct().withColumn("vec_id", F.lit(None).cast("long")), "whitening-fit")
    n, low, high = distinct.agg(F.count("*"), F.min(F.octet_length("x")), F.max(F.octet_length("x"))).first()
    if not n:
        return None
    if low != high or high > 8 * MAX_DIMENSION:
        raise ValueError(f"vectors of {low // 8} to {high // 8} entries; one length of at most {MAX_DIMENSION} is needed")
    width, block_rows = high // 8, block_rows_of(n)
    n_blocks = math.ceil(n / block_rows)
    dealt = blocks(distinct, block_rows)
    sums = _sums(dealt, "x", "<i8", width)
    covariance = scatter(dealt, _centred(n, sums), n_blocks, block_rows, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1].T
    kept = min(components, int((values > ZERO * max(values[0], 0.0)).sum()))
    vectors = vectors[:kept] * np.sign(vectors[np.arange(kept), np.abs(vectors[:kept]).argmax(axis=1)])[:, None]
    model = Whitening(n, sums, vectors, values[:kept], float(np.trace(covariance)))
    if kept:
        y = product(dealt, _centred(n, sums), n_blocks, block_rows, model.matrix())
        mean = _sums(y, "y", "<f8", kept) / n
        white = scatter(y, lambda r: np.frombuffer(r["y"], dtype="<f8").reshape(-1, kept) - mean, n_blocks, block_rows, kept)
        model.identity_error = float(np.abs(white / n - np.eye(kept)).max())
    return model


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (exact), whitened (doubles) of all ``rows`` (vec_id, x)."""
    count = rows.count()
    block_rows, width, kept = block_rows_of(count), len(model.sums), len(model.components)
    dealt = blocks(rows, block_rows)
    y = product(dealt, _centred(model.n, model.sums), math.ceil(count / block_rows), block_rows, model.matrix())
    n, sums = model.n, model.sums

    def deviations(batches):
        for batch in pieces(batches, 1):
            out = []
            for x in batch.column("x").to_pylist():
                own = n * np.frombuffer(x, dtype="<i8").reshape(-1, width) - sums
                if (own.astype(float) ** 2).sum(axis=1).max() >= 2.0 ** 63:
                    raise OverflowError("a deviation beyond 64 bits")
                out.append((own ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("vec_ids"), pa.array([v.tolist() for v in out], pa.list_(pa.int64()))],
                names=["block", "vec_ids", "deviations"])

    def rows_of(batches):
        for batch in pieces(batches, 1):
            for r in batch.to_pylist():
                values = np.frombuffer(r["y"], dtype="<f8").reshape(-1, kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["vec_ids"], pa.int64()), pa.array(r["deviations"], pa.int64()),
                     pa.array(list(values), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    beside = dealt.mapInArrow(deviations, "block long, vec_ids array<bigint>, deviations array<bigint>")
    return beside.join(y, "block").mapInArrow(rows_of, "vec_id long, deviation long, whitened array<double>")


_SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """All rows of ``vectors`` (vec_id, embedding), a line per component."""
    rows = written(integers(vectors.select("vec_id", "embedding")), "whitening-integers")
    model = fit(rows, components)
    if model is None or not len(model.components):
        return vectors.sparkSession.createDataFrame([], _SCHEMA)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    return transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all embeddings projected on the 16 leading components, whitened."""
    return report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
