"""Quality classifier by compression: zstandard dictionaries of good and bad labelled text.

Two dictionaries are trained, one on texts labelled good and one on texts labelled bad.  A whole text is cut into
chunks (a dictionary helps most at the start of a stream) and each chunk is compressed with either dictionary and
with none; the summed sizes give normalised differences, which a logistic regression turns into a calibrated score.

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not 0, on bounded samples by hash order:
``DICTIONARY_ROWS`` rows a class (at most ``DICTIONARY_BYTES`` of text) train the dictionaries, and
``CALIBRATION_ROWS`` other rows the calibration.  Label, language, source and id are no inputs of a score.

How it scales: the documents are scanned twice (sampled rows, then scores) and never shuffled; the labelled sample is
broadcast with its documented bound; a dictionary is trained inside a task and only its bytes reach the driver.

Defined results: null text is scored as the empty one; without labels of both classes every score is the share of good
labels (0.5 without any); several labels of a doc_id count each; repeated rows are scored each; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_collect, pieces, table, utf8, whole_rows, written

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
DICTIONARY_ROWS, DICTIONARY_BYTES, DICTIONARY_SIZE = 2000, 16 << 20, 64 << 10
CALIBRATION_ROWS = 8000
CHUNK = 2048
LEVEL = 3


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def labelled_sample(labels: DataFrame, label: str, train: Column, rows: int, seed: int) -> DataFrame:
    """doc_id and label (0 or 1) of at most ``rows`` training rows of each class, by hash order."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        train & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    key = F.xxhash64(F.lit(seed), "doc_id")
    return known.filter("label = 1").orderBy(key, "doc_id").limit(rows).union(
        known.filter("label = 0").orderBy(key, "doc_id").limit(rows))


def sampled_texts(docs: DataFrame, sample: DataFrame, rows: int) -> DataFrame:
    """label and text of at most ``rows`` documents of each label whose doc_id is in ``sample``, by hash order; written
    once.  The bound holds for documents too: a doc_id that many rows carry doesn't widen the sample."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")
    # a look at the doubled ids only, so that texts are sorted where there are any
    if docs.select("doc_id").join(F.broadcast(sample), "doc_id").count() > sample.count():
        key = F.xxhash64("doc_id", "text")
        found = found.filter("label = 1").orderBy(key, "text").limit(rows).union(
            found.filter("label = 0").orderBy(key, "text").limit(rows)).repartition(16)
    return written(found, "labelled")


class Compressors:
    """Compressed sizes of a text by chunks: with no dictionary, with the good one and with the bad one."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        self.all = [zstd.ZstdCompressor(level=LEVEL)]
        for data in (good, bad):
            own = zstd.ZstdCompressionDict(data)
            own.precompute_compress(level=LEVEL)
            self.all.append(zstd.ZstdCompressor(dict_data=own))

    def sizes(self, text: bytes) -> list[int]:
        out = [0, 0, 0]
        for i in range(0, len(text), CHUNK):
            chunk = text[i:i + CHUNK]
            for k, c in enumerate(self.all):
                out[k] += len(c.compress(chunk))
        return out


def differences(length: np.ndarray, plain: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Normalised size differences per text, and a constant: the inputs of the calibration."""
    n = np.maximum(length, 1)
    d = (bad - good) / np.maximum(bad + good, 1)
    saved = (plain - good) / np.maximum(plain, 1)
    saved_bad = (plain - bad) / np.maximum(plain, 1)
    rate = plain / n
    return np.stack([d, d * np.abs(d), (bad - good) / n, saved, saved_bad, rate, rate ** 2, 1 / np.sqrt(n), np.ones(len(n))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-2,
                 rounds: int = 40) -> np.ndarray:
    """Coefficients by Newton steps on the penalised likelihood (the last column is the constant)."""
    weight = np.ones(len(y)) if weight is None else weight
    beta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    share: float

    def score(self, sizes: np.ndarray) -> np.ndarray:
        """Scores of rows (length, plain, good, bad)."""
        if not len(self.beta):
            return np.full(len(sizes), self.share)
        x = (differences(*sizes.T.astype(np.float64)) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _dictionary(texts) -> bytes:
    """A trained dictionary; the plain text where there is too little of it to train one."""
    import zstandard as zstd

    chunks = [data[i:i + CHUNK] for data in (t.encode() for t in texts) for i in range(0, len(data), CHUNK)]
    try:
        return zstd.train_dictionary(DICTIONARY_SIZE, chunks, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(chunks)[:DICTIONARY_SIZE]


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Model:
    spark = docs.sparkSession
    train = ~held_out(F.col("doc_id")) if train is None else train
    for_dictionary = F.xxhash64(F.lit(11), "doc_id") % 2 == 0
    first = sampled_texts(docs, labelled_sample(labels, "quality", train & for_dictionary, DICTIONARY_ROWS, 1), DICTIONARY_ROWS)

    def make(batches):
        import pandas as pd

        held, size = {0: [], 1: []}, {0: 0, 1: 0}
        for frame in batches:  # by label and hash; a text beyond the bound on bytes is passed over
            for label, text in zip(frame.label, frame.text):
                n = len(text.encode())
                if not held[label] or size[label] + n <= DICTIONARY_BYTES:
                    held[label].append(text)
                    size[label] += n
        for label, own in held.items():
            if own:
                yield pd.DataFrame({"label": [label], "data": [_dictionary(own)]})

    keyed = first.withColumn("key", F.xxhash64("doc_id", "text"))
    trained = {r.label: bytes(r.data) for r in keyed.repartition(1).sortWithinPartitions("label", "key").mapInPandas(make, "label int, data binary").collect()}
    second = sampled_texts(docs, labelled_sample(labels, "quality", train & ~for_dictionary, CALIBRATION_ROWS // 2, 2),
                           CALIBRATION_ROWS // 2)
    none = np.zeros(0)
    if len(trained) < 2:
        count, share = second.agg(F.count("*"), F.avg("label")).first()
        return Model(b"", b"", none, none, none, float(share) if count else float(max(trained, default=0.5)))
    bare = Model(trained[1], trained[0], none, none, none, 0.5)
    rows = bounded_collect(_measured(second, spark.sparkContext.broadcast(bare), ["label"])
                           .select("label", "sizes"), 4 * CALIBRATION_ROWS, "calibration rows")
    y = np.array([r.label for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        bare.share = float(y.mean()) if len(y) else 0.5
        return bare
    x = differences(*np.array([r.sizes for r in rows], dtype=np.float64).T)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    centre[-1], scale[scale == 0] = 0, 1
    # both classes were sampled alike; the weights restore their shares among the labels
    good = labels.filter(train).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    weight = np.where(y == 1, good / y.mean(), (1 - good) / (1 - y.mean()))
    bare.centre, bare.scale = centre, scale
    bare.beta = fit_logistic((x - centre) / scale, y, weight)
    return bare


def _measured(df: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns, sizes (length, plain, good, bad) and score of each text."""
    def run(batches):
        tools = Compressors(model.value.good, model.value.bad) if model.value.good else None
        for batch in pieces(batches):
            texts = utf8(batch.column("text"))
            sizes = np.array([[len(t), *(tools.sizes(t) if tools else (0, 0, 0))] for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes.tolist(), pa.list_(pa.int64())),
                 pa.array(model.value.score(sizes), pa.float64())], names=[*keep, "sizes", "score"])

    df = df.select(*keep, "text")
    schema = df.select(*keep, F.array().cast("array<bigint>").alias("sizes"), F.lit(0.0).alias("score")).schema
    return df.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (the whole input row) and its score."""
    return _measured(whole_rows(docs, "text"), docs.sparkSession.sparkContext.broadcast(model), ["row"]).select("row", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: a calibrated quality score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score(docs, model).select(
        "row.doc_id", F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
