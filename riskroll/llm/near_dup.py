"""MinHash near-duplicates by min-max hashing.

Words: A-Z lower-cased, runs of non-space characters.  A document's set: its distinct 5-word shingles (64-bit hashes);
a shorter text is one shingle; without words the set is empty.  Documents are linked if
100 * |intersection| >= 85 * |union|; the 85 is op8's, callers may name another percentage.

Every permutation gives two signature values, the minimum and the maximum, so ``PERMUTATIONS`` hash evaluations make
twice as many values.  Bands of ``ROWS`` values (half minima, half maxima) are bucket keys: a linked pair (similarity
0.85 or more) shares none of the 44 bands with a probability below 1e-9, one of 0.80 with about 2e-6.

1. Documents with equal sets form a class (grouped by a 128-bit digest, combined map-side), so copies cost one row.
2. Classes meet in buckets; each bucket links its members to its smallest one (never all pairs), and the connected
   components are candidate clusters: every pair that shares a band lies in one cluster.
3. The sets of cluster members are built from their whole texts, and links are confirmed on them (``links_within``).

How it scales: texts are read twice and not shuffled while the members' keys stay under a counted broadcast bound (by
shuffle join beyond); buckets are slim rows; a hot bucket, class or cluster is split as described in ``linking``.

Defined results: null and empty texts have an empty set, are linked with nothing and are kept; component_id is the
smallest doc_id of the component, null if it has none; rows of one doc_id and text are one document; an empty table
gives no rows; other columns are ignored or, in ``keep_first``, untouched.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, pieces, segment_hashes, table, utf8, whole_rows, written
from .linking import Forest, components, links_within, small_side

SHINGLE = 5
PERMUTATIONS = 132
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 85
BLOCK_WEIGHT = 200_000


_rng = np.random.default_rng(20_261)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


#: Bytes of words; the others, x20 and x09-x0D, part them.
_WORD_BYTE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    blob = b"\n".join(texts).lower()  # bytes: changes A-Z only
    data = np.frombuffer(blob, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _WORD_BYTE[data], [False]]).view(np.int8)))
    starts = edges[::2]
    h = segment_hashes(data, starts, edges[1::2])
    cuts = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return [_shingles(h[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def _shingles(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        total += _mix(h[j:j + n] * _PLACES[j])
    return np.unique(_mix(total))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys (documents x BANDS, signed 64-bit) of non-empty sets by min-max hashing."""
    ends = np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]])
    x = np.concatenate(sets)
    signature = np.empty((2 * PERMUTATIONS, len(sets)), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        h = x * _FACTORS[k] + _ADD[k]
        h ^= h >> np.uint64(32)
        signature[2 * k] = np.minimum.reduceat(h, starts)
        signature[2 * k + 1] = np.maximum.reduceat(h, starts)
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        total = np.full(len(sets), b, dtype=np.uint64)
        for value in signature[b * ROWS:(b + 1) * ROWS]:
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + value)
        keys[:, b] = total
    return keys.view(np.int64)


def digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set; null if empty) and band keys of every document."""
    def run(batches):
        for batch in pieces(batches, 1 << 20):
            sets = shingle_sets(utf8(batch.column("text")))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            if full:
                for i, keys in zip(full, band_keys([sets[i] for i in full]).tolist()):
                    bands[i] = keys
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()),
                 pa.array(map(digest, sets), pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, node binary, bands array<bigint>")


def candidate_clusters(classes: DataFrame) -> DataFrame:
    """key, cluster, degree of the classes (key, bands) that share a bucket with another one."""
    buckets = classes.select("key", F.explode("bands").alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1"),
                     "buckets")
    met = written(buckets.join(small_side(shared, shared.count()), "bucket").groupBy("key", "first").agg(F.sum("n").alias("n")), "met")
    free_shuffles(classes.sparkSession)
    cluster = components(met.select(F.col("key").alias("a"), F.col("first").alias("b")))
    degree = met.groupBy("key").agg(F.sum("n").alias("degree"))
    return written(cluster.select(F.col("node").alias("key"), F.col("component").alias("cluster")).join(degree, "key"),
                   "clusters")


def set_links(payload: dict[str, list], left: list[int], right: list[int], forest: Forest, percent: int = PERCENT):
    """Linked pairs of sets, by exact intersection sizes."""
    sets = [np.asarray(s, dtype=np.int64) for s in payload["shingles"]]
    sizes = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 64:
        for i in left:
            for j in right:
                if (i < j or left is not right and i != j and left != right) and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                        yield i, j
        return
    both = np.unique(np.array(left + right))
    rows = np.repeat(both, sizes[both])
    _, column, count = np.unique(np.concatenate([sets[i] for i in both]), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # a shingle of one set only is in no intersection
    keep = count[column] > 1
    rows, column = rows[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    at_left, at_right = (np.full(len(sets), -1) for _ in range(2))
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 1024
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        r, c = rows[a:b], column[a:b] % width
        x, y = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        x[at_left[r][at_left[r] >= 0], c[at_left[r] >= 0]] = 1
        y[at_right[r][at_right[r] >= 0], c[at_right[r] >= 0]] = 1
        common += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    for i, j in np.argwhere((100 * common >= percent * union) & (union > 0)).tolist():
        if left[i] != right[j]:
            yield left[i], right[j]


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signatures, groups): groups has node, component (a node) and first (smallest doc_id) of every class."""
    signed = written(signatures(docs), "signatures")
    classes = signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("own"),
        F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("key", F.xxhash64("node")), "classes")
    clusters = candidate_clusters(classes)
    members = written(classes.drop("bands").join(small_side(clusters, clusters.count()), "key"), "members")
    links = links_within(_with_sets(docs, members), partial(set_links, percent=percent), BLOCK_WEIGHT)
    linked = components(links)
    free_shuffles(docs.sparkSession)
    group = classes.select("node", "doc_id").join(small_side(linked, linked.count()), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    first = group.groupBy("component").agg(F.min("doc_id").alias("first"))
    return signed, written(group.join(first, "component").select("node", "component", "first"), "groups")


def _with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members with the shingles of their whole texts (a row for each repeat of the document)."""
    n = members.count()
    wanted = members.select(F.col("own.doc_id").alias("id"), F.col("own.text_hash").alias("hash"), "node", "cluster", "degree")
    texts = docs.select(F.col("doc_id").cast("long").alias("id2"), F.xxhash64("text").alias("hash"), "text").join(
        small_side(wanted, n), "hash").filter(F.col("id2").eqNullSafe(F.col("id")))

    def run(batches):
        for batch in pieces(batches):
            sets = shingle_sets(utf8(batch.column("text")))
            own = [i for i, (s, node) in enumerate(zip(sets, batch.column("node").to_pylist())) if digest(s) == node]
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "cluster", "degree")],
                                              names=["node", "cluster", "degree"]).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([len(sets[i]) + 64 for i in own], pa.int64()),
                 pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))],
                names=["node", "cluster", "degree", "weight", "shingles"])

    found = texts.select("node", "cluster", "degree", "text").mapInArrow(
        run, "node binary, cluster long, degree long, weight long, shingles array<bigint>")
    return written(found, "member-sets")


def report(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed, groups = near_duplicates(docs, percent)
    return signed.join(groups.select("node", "first"), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group of near-duplicates.

    What goes is a doc_id with its text: other texts of a repeated doc_id stay."""
    signed, groups = near_duplicates(docs, percent)
    gone = signed.join(groups.select("node", "first"), "node").filter(F.col("doc_id") != F.col("first"))
    dropped = written(gone.select("doc_id", "text_hash").distinct(), "dropped")
    rows = whole_rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    return rows.join(small_side(dropped, dropped.count(), 24), ["doc_id", "text_hash"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the near-duplicate component of every document."""
    return report(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
         ELSE list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS grams FROM d),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, hash(gram) AS gram FROM (SELECT doc_id, unnest(grams) AS gram FROM s)),
c AS (SELECT list_sort(list(gram)) AS k, doc_id FROM g GROUP BY doc_id),
r AS (SELECT k, min(doc_id) AS rep FROM c GROUP BY k),
m AS (SELECT c.doc_id, r.rep FROM c JOIN r USING (k)),
gr AS (SELECT g.* FROM g JOIN r ON g.doc_id = r.rep),
f AS (SELECT gram, count(*) AS f FROM gr GROUP BY gram),
o AS (SELECT gr.doc_id, gr.gram, n.n, row_number() OVER (PARTITION BY gr.doc_id ORDER BY f.f, gr.gram) AS p
      FROM gr JOIN f USING (gram) JOIN n USING (doc_id)),
x AS (SELECT doc_id, gram, n FROM o WHERE 100 * (p - 1) <= 15 * n),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b USING (gram)
      WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
v AS (SELECT q.a, q.b, q.na, q.nb, count(*) AS common
      FROM q JOIN gr ga ON ga.doc_id = q.a JOIN gr gb ON gb.doc_id = q.b AND gb.gram = ga.gram GROUP BY ALL),
e AS (SELECT a, b FROM v WHERE 100 * common >= 85 * (na + nb - common) UNION ALL
      SELECT b, a FROM v WHERE 100 * common >= 85 * (na + nb - common)),
t AS (
  WITH RECURSIVE walk(node, low) AS (
    SELECT rep, rep FROM r UNION SELECT e.b, walk.low FROM walk JOIN e ON e.a = walk.node WHERE walk.low < e.b)
  SELECT node, min(low) AS low FROM walk GROUP BY node)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(t.low, n.doc_id) AS component_id,
       n.doc_id = coalesce(t.low, n.doc_id) AS kept
FROM n LEFT JOIN m USING (doc_id) LEFT JOIN t ON t.node = m.rep
"""
