"""Token-id binary output: a static range asymmetric numeral system (rANS) with shared frequency tables.

File format: a Parquet table whose rows are independent blocks, beside a one-row Parquet table with the shared
frequencies.  A block holds whole documents in ascending doc_id order: their ids and lengths, the 64-bit states of
``LANES`` interleaved coders, a checkpoint (place in the word stream and all states) every ``CHECKPOINT_STEPS`` steps,
the 32-bit word stream and CRC-32 checksums of words and ids.  Symbol i of a block belongs to lane i mod LANES; one
numpy step codes LANES symbols.  Blocks decode independently, and ``decode`` can start at any checkpoint.

How it scales: rows are range-partitioned by (doc_id, text hash), so a doc_id with a third of all rows still spreads;
each text is tokenized once; frequencies are counted over all ids with a map-side sum (at most one row per symbol
reaches the driver).  The ids lie in the shared folder between counting and coding.  A block ends at ``block_ids`` ids
or after one longer document.

Defined results: null text is empty (only the end id); null doc_ids come first; rows of one doc_id keep an order by
text hash; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_collect, free_shuffles, pieces, shared_path, table
from .tokens import Encoder, default_path

SCALE = 20
LANES = 2048
CHECKPOINT_STEPS = 256
BLOCK_IDS = 1 << 20
MAX_SYMBOLS = 1 << (SCALE - 1)
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << SCALE) - 1)
_S, _W = np.uint64(SCALE), np.uint64(32)


class Frequencies:
    """Counts of symbols scaled to 2**SCALE; every counted symbol keeps at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        if len(symbols) > MAX_SYMBOLS:
            raise ValueError(f"more than {MAX_SYMBOLS} symbols")
        total = max(int(counts.sum()), 1)
        scaled = np.maximum(1, (counts.astype(np.float64) * ((1 << SCALE) / total)).astype(np.int64))
        order = np.argsort(-counts, kind="stable")
        rest = (1 << SCALE) - int(scaled.sum())
        if rest > 0 and len(scaled):
            scaled[order[0]] += rest
        for i in order:  # rounding up the rare ones is paid for by the frequent ones
            if rest >= 0:
                break
            give = min(-rest, max(int(scaled[i]) // 2, int(scaled[i]) - 1 if scaled[i] < 4 else 0))
            scaled[i] -= give
            rest += give
        self.symbols, self.freq = symbols.astype(np.uint32), scaled.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.number = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, dtype=np.int32)
        self.number[symbols] = np.arange(len(symbols))

    def slots(self) -> np.ndarray:
        """Symbol number of each of the 2**SCALE slots."""
        return np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))


def encode(ids: np.ndarray, table_: Frequencies) -> dict[str, bytes]:
    """One block: final states, checkpoints (step, word offset, states) and the word stream, in decoding order."""
    number = table_.number[ids]
    freq, start = table_.freq[number], table_.start[number]
    steps = -(-len(ids) // LANES)
    x = np.full(LANES, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    n_words = 0
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * LANES:(s + 1) * LANES], start[s * LANES:(s + 1) * LANES]
        own = x[:len(f)]
        full = own >= f << np.uint64(63 - SCALE)
        out = own[full]
        words.append(out.astype("<u4"))
        n_words += len(out)
        own[full] = out >> _W
        q = own // f
        own[:] = (q << _S) + (own - q * f) + c
        if s and s % CHECKPOINT_STEPS == 0:
            marks.append((s, n_words, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, dtype="<u4")
    checkpoint = b"".join(np.array([s, n_words - n], dtype="<u8").tobytes() + states for s, n, states in marks[::-1])
    return {"states": x.astype("<u8").tobytes(), "checkpoints": checkpoint, "words": stream.tobytes()}


def decode(block: dict, table_: Frequencies, slots: np.ndarray, n_ids: int, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block from ``checkpoint`` on (0: from its start); raises if the words don't match their checksum."""
    if zlib.crc32(block["words"]) != block["words_crc32"]:
        raise ValueError("damaged block: checksum of the words")
    words = np.frombuffer(block["words"], dtype="<u4").astype(np.uint64)
    first, at, states = 0, 0, block["states"]
    if checkpoint:
        size = 16 + 8 * LANES
        mark = block["checkpoints"][(checkpoint - 1) * size:checkpoint * size]
        first, at = map(int, np.frombuffer(mark[:16], dtype="<u8"))
        states = mark[16:]
    x = np.frombuffer(states, dtype="<u8").copy()
    out = np.empty(n_ids - first * LANES, dtype=np.int32)
    for s in range(first, -(-n_ids // LANES)):
        n = min(LANES, n_ids - s * LANES)
        own = x[:n]
        slot = own & _MASK
        number = slots[slot]
        own[:] = table_.freq[number] * (own >> _S) + slot - table_.start[number]
        low = np.flatnonzero(own < _LOW)
        own[low] = (own[low] << _W) | words[at:at + len(low)]
        at += len(low)
        out[(s - first) * LANES:(s - first) * LANES + n] = number
    return table_.symbols[out]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows in ascending doc_id order: part (range partition), seq (place in it), doc_id, ids (unsigned 32-bit)."""
    ordered = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
               .withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encoder = Encoder.shared(tokenizer)
        for batch in pieces(batches):
            ids = [x + end for x in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(range(seq, seq + len(ids)), pa.int64()),
                 batch.column("doc_id").cast(pa.int64()), pa.array(map(_planes, ids), pa.binary())],
                names=["part", "seq", "doc_id", "ids"])
            seq += len(ids)

    return ordered.mapInArrow(run, "part int, seq long, doc_id long, ids binary")


def _planes(ids: bytes) -> bytes:
    """Byte planes of the ids (all lowest bytes first, and so on); the empty upper ones compress to nothing."""
    return np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def symbol_counts(ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their counts over all ids, ascending."""

    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in pieces(batches):
            found = np.bincount(np.concatenate([_from_planes(x) for x in batch.column("ids").to_pylist()]))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), dtype=np.int64)])
            total[:len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    summed = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted(bounded_collect(summed, MAX_SYMBOLS, "symbols"))
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


_BLOCK = ("part int, first long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, states binary, "
          "checkpoints binary, words binary, words_crc32 long, ids_crc32 long")


def encode_blocks(ids: DataFrame, table_: Frequencies, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of whole documents, in the order of (part, first)."""
    shared = ids.sparkSession.sparkContext.broadcast(table_)

    def block(part, first, doc_ids, parts):
        all_ids = np.concatenate(parts)
        coded = encode(all_ids, shared.value)
        row = {"part": part, "first": first, "doc_ids": doc_ids, "lengths": [len(p) for p in parts],
               "n_ids": len(all_ids), **coded, "words_crc32": zlib.crc32(coded["words"]),
               "ids_crc32": zlib.crc32(all_ids.astype("<u4").tobytes())}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCK)

    def run(batches):
        part = first = due = None
        doc_ids, parts, held = [], [], 0
        for batch in pieces(batches):
            for p, seq, doc, planes in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "ids"))):
                if parts and ((p, seq) != (part, due) or held >= block_ids):
                    yield block(part, first, doc_ids, parts)
                    doc_ids, parts, held = [], [], 0
                if not parts:
                    part, first = p, seq
                due = seq + 1
                doc_ids.append(doc)
                parts.append(_from_planes(planes))
                held += len(parts[-1])
        if parts:
            yield block(part, first, doc_ids, parts)

    return ids.mapInArrow(run, _BLOCK)


_ARROW_BLOCK = pa.schema([
    ("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("states", pa.binary()), ("checkpoints", pa.binary()), ("words", pa.binary()),
    ("words_crc32", pa.int64()), ("ids_crc32", pa.int64())])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Tokenize ``docs`` (doc_id, text) and write ``path``/blocks and ``path``/frequencies."""
    spark = docs.sparkSession
    ids = tokenized(docs, tokenizer or default_path(), end_id)
    between = shared_path(spark, "rans-ids")
    ids.write.option("compression", "zstd").parquet(between)
    ids = spark.read.schema(ids.schema).parquet(between)
    free_shuffles(spark)
    symbols, counts = symbol_counts(ids)
    spark.createDataFrame([(symbols.tolist(), counts.tolist())], "symbols array<bigint>, counts array<bigint>").write.parquet(
        f"{path}/frequencies")
    encode_blocks(ids, Frequencies(symbols, counts)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32, ids (unsigned 32-bit), one row per document."""
    row = spark.read.parquet(f"{path}/frequencies").first()
    shared = spark.sparkContext.broadcast(Frequencies(np.array(row.symbols, dtype=np.int64),
                                                      np.array(row.counts, dtype=np.int64)))
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")

    def run(batches):
        slots = shared.value.slots()
        for batch in pieces(batches, 1):
            block = batch.to_pylist()[0]
            ids = decode(block, shared.value, slots, block["n_ids"]).astype("<u4")
            if zlib.crc32(ids.tobytes()) != block["ids_crc32"]:
                raise ValueError("damaged block: checksum of the ids")
            ends = np.cumsum(block["lengths"])
            own = [ids[e - n:e].tobytes() for e, n in zip(ends, block["lengths"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block["part"]] * len(own), pa.int32()), pa.array([block["first"]] * len(own), pa.int64()),
                 pa.array(block["doc_ids"], pa.int64()), pa.array(ends - block["lengths"], pa.int64()),
                 pa.array(block["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()),
                 pa.array(own, pa.binary())],
                names=["part", "first", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    docs = blocks.mapInArrow(run, "part int, first long, doc_id long, within long, n_tokens long, ids_crc32 long, "
                                  "ids binary")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    in_part = blocks.select("part", "first", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("first"))
                                              - F.col("n_ids")).alias("ahead"))
    offsets = in_part.join(before_part, "part").select("part", "first", (F.col("before") + F.col("ahead")).alias("offset"))
    return docs.join(offsets, ["part", "first"]).select(
        "doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents written as rANS blocks in ascending doc_id order, read back from the files."""
    path = shared_path(spark, "rans")
    write(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read(spark, path).drop("ids")
