"""Best-fit packing by minimum bin slack over the counts of piece lengths.

Per bin, bitset subset-sum dynamic programming over the lengths still available finds the fullest feasible combination
around the longest piece left; it is then removed, as often at once as all its lengths last.  The plan depends on
nothing but the histogram (at most ``capacity`` numbers), so the driver's work is the same at every input size: it
yields runs of equal bins.  Pieces then get a rank among those of their length and look up bin and offset.

How it scales: each text is tokenized once and only lengths and checksums (or, if wanted, ids) are kept, in the shared
folder.  Ranks come from counts per (length, salt) and a window inside each of them, so a length with a third of all
pieces is spread over the salts; nothing is collected but the histogram.  The look-up table is broadcast: it has at
most a few entries per length and run (checked).

Defined results: null text is empty (a piece of only the end id); an empty table packs into nothing; repeated rows are
packed each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_collect, pieces, table, written
from .tokens import Encoder, default_path

CAPACITY = 1024
END_ID = 2
MAX_RUN_ENTRIES = 1_000_000


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths (with repeats up to their counts) whose sum is the largest not over ``room``."""
    reach, trail = 1, []
    within = (1 << (room + 1)) - 1
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        left, size = counts[length], 1
        while left:  # binary splitting of the multiplicity: every number of copies up to the count can be made
            copies = min(size, left)
            if copies * length > room:
                break
            grown = (reach | reach << (copies * length)) & within
            if grown != reach:
                trail.append((length, copies, reach))
                reach = grown
            left, size = left - copies, size * 2
        if reach >> room & 1:
            break
    best, chosen = reach.bit_length() - 1, []
    for length, copies, before in reversed(trail):
        if not before >> best & 1:
            chosen += [length] * copies
            best -= copies * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), until no piece is left."""
    counts = {k: n for k, n in histogram.items() if n}
    runs = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        need = Counter(chosen)
        times = min(counts[k] // n for k, n in need.items())
        for k, n in need.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        runs.append((chosen, times))
    return runs


def run_table(runs: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first bin, copies in a bin, offset of the first copy), by first rank."""
    used, out, first_bin = Counter(), {}, 0
    for lengths, times in runs:
        offset = 0
        for length, copies in Counter(lengths).items():
            out.setdefault(length, []).append((used[length], first_bin, copies, offset))
            used[length] += copies * times
            offset += copies * length
        first_bin += times
    if sum(map(len, out.values())) > MAX_RUN_ENTRIES:
        raise ValueError("too many runs to broadcast")
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of each piece; only the first of a longer text is short."""
    path = tokenizer or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches):
        encoder = Encoder.shared(path)
        for batch in pieces(batches):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[4 * a:4 * b]
                    for c, v in zip(out, (doc, i, a, b - a, zlib.crc32(own), own)):
                        out[c].append(v)
            if not keep_ids:
                del out["ids"]
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a ``length`` of 1 to capacity; written here once) with sequence_id and offset added.

    The order within a length, and so its split over tasks, is a hash of a row's place in its partition, not of its
    content: repeated rows spread like any others."""
    salts = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = written(items.select(F.struct("*").alias("row"), F.col("length").cast("int").alias("size"),
                                  F.xxhash64(F.monotonically_increasing_id()).alias("tie")), "pieces")
    salted = salted.withColumn("salt", F.pmod("tie", F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("size", "salt").count()
    histogram = {r[0]: r[1] for r in bounded_collect(by_salt.groupBy("size").agg(F.sum("count").alias("n")), capacity,
                                                     "lengths")}
    if any(not 1 <= k <= capacity for k in histogram):
        raise ValueError(f"lengths must be 1 to {capacity}")
    ahead = by_salt.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt"))
                                            - F.col("count")).alias("ahead"))
    ranked = (salted.withColumn("place", F.row_number().over(Window.partitionBy("size", "salt").orderBy("tie")) - 1)
              .join(ahead, ["size", "salt"]).select("row", "size", (F.col("ahead") + F.col("place")).alias("rank")))
    shared = items.sparkSession.sparkContext.broadcast(run_table(plan_bins(histogram, capacity)))

    def run(batches):
        for batch in pieces(batches):
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            sequence, offset = np.empty(len(size), dtype=np.int64), np.empty(len(size), dtype=np.int64)
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                runs = shared.value[length]
                r = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                within = rank[own] - r[:, 0]
                sequence[own] = r[:, 1] + within // r[:, 2]
                offset[own] = r[:, 3] + within % r[:, 2] * length
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)],
                                             names=["row", "sequence_id", "offset"])

    schema = ranked.select("row", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(run, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents; with ``keep_ids`` each piece carries its ids."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its concatenated ids, from ``pack_documents(..., keep_ids=True)`` (a sequence has 1 to 1024 ids)."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(own, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents packed into sequences of at most 1024 tokens, a row per piece."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
