"""Helpers shared by the training-data operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir`` (every executor sees it), written
as Parquet and read again.  That cuts the lineage: a lost executor costs a re-read, never a recomputation of the chain.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskroll.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns of one input table (all of them if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (with the writer's ``options``) and read it back: one computation, durable, no
    lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages now (its cleaner follows garbage collection, which is due
    every half hour at the latest); what was written to the shared folder stays."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_rows(df: DataFrame, *columns: str) -> DataFrame:
    """``row`` (the untouched input row as a struct) beside the named columns: no internal name can clash with it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column inside the ``row`` structs of a batch (sent once, not beside them)."""
    return batch.column("row").field("text")


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``max_bytes`` (at least one row, however long it is)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * max_bytes / max(batch.nbytes, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, step)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; more is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments (empty ones sum to 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


#: An odd number, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, kept per worker and grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            up, down = (np.full(n, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of segments of a byte array: polynomials in the base, from one running sum over all bytes."""
    up, down = _POWERS.of(len(data) + 1)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=running[1:])
    h = (running[ends] - running[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (as ``--py-files`` would), once per Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="riskroll-code-")) / "riskroll.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
