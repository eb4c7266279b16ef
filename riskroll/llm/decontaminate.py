"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over the words of every document.

Words: A-Z lower-cased, every run of characters other than ASCII non-alphanumerics (all characters from U+0080 on
belong to words).  A window is 13 consecutive words of an item; an item of fewer words (but not none) is one window.
A document word inside any occurrence of a window is hit.

How it scales: documents are read once and never shuffled; a task holds a few MB of text.  The benchmark is broadcast
only in blocks of at most ``block_bytes`` of text of distinct items (counted first; one item alone may be larger), one
scan per block, so its size is not bounded by memory.  Candidate windows are found by a 64-bit rolling hash over runs of benchmark words and verified
word by word.

Defined results: null text has no words; an empty benchmark or table gives no hits; repeated items count once per
item_id, repeated documents give repeated rows; a null item_id counts as the empty id; other columns are untouched.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, segment_sums, table, text_of, utf8, whole_rows, written

WINDOW = 13
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _WORD_BYTES else 0x20 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text (multi-byte characters are word characters, so bytes suffice)."""
    return text.translate(_NORMAL).split()


class WindowIndex:
    """Windows of some benchmark items: vocabulary, rolling hashes by window length, and the exact windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        number = self.vocabulary.setdefault
        for item, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                self.windows.setdefault(size, {}).setdefault(ids[i:i + size].tobytes(), []).append(item)
        for of_size in self.windows.values():
            for key, owners in of_size.items():
                of_size[key] = sorted(set(owners))
        self.hashes = {
            size: np.unique(self._roll(np.frombuffer(b"".join(of_size), dtype=np.int32).reshape(-1, size)))
            for size, of_size in self.windows.items()}

    @staticmethod
    def _roll(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        for j in range(rows.shape[1]):
            h = (h + rows[:, j].astype(np.uint64)) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """Hit flags of the word numbers ``ids`` (0: not a benchmark word), and (position, items) per verified window."""
        hit, found = np.zeros(len(ids), dtype=bool), []
        if not len(ids):
            return hit, found
        place = np.arange(len(ids))
        next_zero = np.minimum.accumulate(np.where(ids == 0, place, len(ids))[::-1])[::-1]
        run = next_zero - place
        for size, of_size in self.windows.items():
            at = np.flatnonzero(run >= size)
            if not len(at):
                continue
            at = at[np.isin(self._roll(ids[at[:, None] + np.arange(size)]), self.hashes[size])]
            for p in at.tolist():
                owners = of_size.get(ids[p:p + size].tobytes())
                if owners is not None:
                    hit[p:p + size] = True
                    found.append((p, owners))
        return hit, found


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan_block(df: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    index = df.sparkSession.sparkContext.broadcast(WindowIndex(items, window))

    def scan(batches):
        number = index.value.vocabulary.get
        for batch in pieces(batches):
            numbered, spans, owners = [], [], []
            before_spans, before_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for text in utf8(text_of(batch)):
                found = words(text)
                numbered.append(np.fromiter(map(number, found, repeat(0)), dtype=np.int32, count=len(found)))
            lengths = np.array([len(x) for x in numbered], dtype=np.int64)
            padded = [x for ids in numbered for x in (ids, np.zeros(1, dtype=np.int32))]
            hit, found = index.value.scan(np.concatenate(padded))
            starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            hits = segment_sums(hit, lengths + 1)
            by_doc: dict[int, set[str]] = {}
            for p, who in found:
                by_doc.setdefault(int(np.searchsorted(starts, p, side="right")) - 1, set()).update(who)
            for d, (start, length) in enumerate(zip(starts, lengths)):
                own = hit[start:start + length]
                if before_spans[d]:
                    own = own.copy()
                    for s in before_spans[d]:
                        own[s["start"]:s["end"]] = True
                spans.append(_runs(own) if hits[d] or before_spans[d] else [])
                owners.append(sorted({*before_items[d], *by_doc.get(d, ())}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lengths, pa.int64()), pa.array(spans, _SPANS),
                 pa.array(owners, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return df.mapInArrow(scan, df.schema)


def _blocks(items: DataFrame, block_bytes: int) -> list[Column]:
    """Conditions that cut distinct ``items`` (item, text) into blocks of at most ``block_bytes`` of text each.

    Hash classes are counted first and put together up to the bound; a class beyond it is cut finer until it holds one
    item alone.  The driver sees class sizes only, a few per block."""
    key = F.xxhash64("item", "text")
    size = F.octet_length("text").cast("long")
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= block_bytes:
        return [F.lit(True)]
    classes, blocks = 4 * (total // block_bytes + 1), []
    open_classes = [(classes, r[0], r[1], r[2]) for r in items.groupBy(F.pmod(key, F.lit(classes))).agg(
        F.sum(size), F.count("*")).collect()]
    condition, held = None, 0
    while open_classes:
        modulus, remainder, weight, n = open_classes.pop()
        own = F.pmod(key, F.lit(modulus)) == remainder
        if weight > block_bytes and n > 1:
            open_classes += [(8 * modulus, r[0], r[1], r[2]) for r in items.filter(own).groupBy(
                F.pmod(key, F.lit(8 * modulus))).agg(F.sum(size), F.count("*")).collect()]
            continue
        if condition is not None and held + weight > block_bytes:
            blocks.append(condition)
            condition, held = None, 0
        condition, held = own if condition is None else condition | own, held + weight
    return blocks + [condition]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of ``docs`` (needs ``text``): ``row`` (the whole input row), n_words, spans (hit word ranges), items.

    An index takes some 50 bytes a byte of benchmark text in every worker: about 400 MB for a block of 8 MB."""
    spans = "array<struct<start:int,end:int>>"
    df = whole_rows(docs).withColumns({
        "n_words": F.lit(None).cast("long"), "spans": F.array().cast(spans), "items": F.array().cast("array<string>")})
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text")).distinct()
    blocks = _blocks(items, block_bytes)
    for b, condition in enumerate(blocks):  # one block but for a benchmark beyond block_bytes
        df = _scan_block(df, [(r.item, r.text.encode()) for r in items.filter(condition).collect()], window)
        if b + 1 < len(blocks):
            df = written(df, "decontaminate")
    return df


def _n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def _contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract, one row per document."""
    return (scan_documents(docs, benchmark).withColumn("n_hit", _n_hit())
            .select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                    _contaminated().alias("contaminated")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated documents; columns and other rows as they were."""
    return (scan_documents(docs, benchmark).withColumn("n_hit", _n_hit())
            .filter(~_contaminated()).select("row.*"))


def brute_force(documents: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Reference for tests: (doc_id, n_words, n_hit, n_items, sha256, contaminated) by direct comparison."""
    grams = []
    for item, text in items:
        w = words((text or "").encode())
        size = min(window, len(w))
        grams += [(str("" if item is None else item), w[i:i + size]) for i in range(len(w) - size + 1 if size else 0)]
    out = []
    for doc, text in documents:
        w = words((text or "").encode())
        hit, owners = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    owners.add(item)
        digest = hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(owners), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: benchmark windows found in every document."""
    return report(table(spark, sf_dir, "documents", "doc_id", "text"),
                  table(spark, sf_dir, "benchmark", "item_id", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s.size, i, array_to_string(w[i:i + s.size - 1], ' ') AS gram
  FROM (SELECT d.doc_id, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM g) s WHERE len(d.w) >= s.size) s),
m AS (SELECT dw.doc_id, dw.size, dw.i, g.item_id FROM dw JOIN g USING (size, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, size, i FROM m)) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       coalesce(o.items_sha256, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""
