"""Approximate nearest neighbours: a hierarchical navigable small-world (HNSW) graph per shard, flat neighbour arrays.

Nearness is the largest inner product.  Within a shard each vector gets one more coordinate that brings all of them to
the same length; the nearest by distance is then the one with the largest inner product, so the graph is an ordinary
one.  That coordinate is taken less the length, so that it is small for short vectors and no rounding hides them beside
a long one, and the vectors are scaled by their largest component.  Queries walk by the inner product itself, from the
nearest of the upper layers and from the longest points.  Points enter in batches: a batch is searched in the graph so far (from the nearest point of the upper layers),
compared within itself, linked to a diverse choice of what was found, and linked back.  Layers are arrays of shape
points x links (-1: none).

Equal vectors are one point that carries its ``k`` + 1 smallest vec_ids: no query can need more of them, and a vector
that fills a third of the table doesn't clog the graph.  Every row is indexed.

How it scales: shards of about ``SHARD_POINTS`` points by hash are built and searched independently; queries come in
blocks of ``QUERY_BLOCK``; a task holds one shard and one block.  Results of the shards are merged per query by rank.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
vec_id or with a length other than the most common one; a repeated row counts once; with fewer than k candidates all
are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .linking import _groups

K = 20
SHARD_POINTS = 8192
QUERY_BLOCK = 1024
LINKS, BASE_LINKS = 16, 32
BUILD_WIDTH, SEARCH_WIDTH = 64, 160
BATCH = 512
_EXPAND = 4


class Graph:
    """Flat HNSW layers over ``points`` (rows of equal length)."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.points, self.layers, self.members = points, layers, members

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        points = even(vectors)
        rng = np.random.default_rng(n)
        level = np.floor(-np.log(rng.random(n)) / math.log(LINKS)).astype(int)
        order = rng.permutation(n)
        top = int(level.max())
        own = cls(points, [np.full((n, BASE_LINKS if k == 0 else LINKS), -1, dtype=np.int32) for k in range(top + 1)],
                  [np.flatnonzero(level >= k) for k in range(top + 1)])
        own.entry = int(order[0])
        done = np.zeros(n, dtype=bool)
        at, size = 0, 32
        while at < n:  # batches grow with the graph
            batch = order[at:at + size]
            own._insert(batch, level, done)
            done[batch] = True
            best = int(batch[np.argmax(level[batch])])
            if level[best] > level[own.entry] or not at:
                own.entry = best
            at += len(batch)
            size = min(BATCH, max(32, at // 4))
        return own

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances from points; of queries (without the last coordinate) the inner products, negated."""
        near = self.points[np.maximum(ids, 0)]
        if queries.shape[1] < near.shape[2]:
            return np.where(ids < 0, np.inf, -np.einsum("qij,qj->qi", near[:, :, :-1], queries))
        return np.where(ids < 0, np.inf, np.einsum("qij,qij->qi", near - queries[:, None, :], near - queries[:, None, :]))

    def _walk(self, queries: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest points found for each query from its ``entry`` points: ids (-1: none) and distances."""
        q = len(queries)
        links = self.layers[layer]
        seen = np.zeros((q, len(self.points)), dtype=bool)
        ids = np.full((q, width), -1, dtype=np.int64)
        ids[:, :entry.shape[1]] = entry
        distance = self._distances(queries, ids)
        order = np.argsort(distance, axis=1)
        ids, distance = np.take_along_axis(ids, order, 1), np.take_along_axis(distance, order, 1)
        open_ = ids >= 0
        rows = np.arange(q)[:, None]
        seen[np.broadcast_to(rows, ids.shape)[open_], ids[open_]] = True
        active = np.arange(q)
        while len(active):
            ranked = np.where(open_[active], distance[active], np.inf)
            pick = np.argsort(ranked, axis=1, kind="stable")[:, :_EXPAND]
            valid = np.isfinite(np.take_along_axis(ranked, pick, 1))
            going = valid.any(axis=1)
            active, pick, valid = active[going], pick[going], valid[going]
            if not len(active):
                break
            r = active[:, None]
            open_[r, pick] &= ~valid
            found = np.where(valid[:, :, None], links[ids[r, pick]], -1).reshape(len(active), -1).astype(np.int64)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[r, np.maximum(found, 0)]] = -1
            fresh = found >= 0
            seen[np.broadcast_to(r, found.shape)[fresh], found[fresh]] = True
            all_ids = np.concatenate([ids[active], found], axis=1)
            all_distances = np.concatenate([distance[active], self._distances(queries[active], found)], axis=1)
            all_open = np.concatenate([open_[active], fresh], axis=1)
            keep = np.argsort(all_distances, axis=1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            distance[active] = np.take_along_axis(all_distances, keep, 1)
            open_[active] = np.take_along_axis(all_open, keep, 1) & np.isfinite(distance[active])
        return np.where(np.isfinite(distance), ids, -1), distance

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entry points for layer ``to``: the nearest found on the layer above."""
        entry = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            entry = self._walk(queries, entry, layer, 8)[0][:, :1]
        return entry

    def _insert(self, batch: np.ndarray, level: np.ndarray, done: np.ndarray) -> None:
        for layer in range(len(self.layers) - 1, -1, -1):
            new = batch[level[batch] >= layer]
            if not len(new):
                continue
            queries = self.points[new]
            found = np.full((len(new), 0), -1, dtype=np.int64)
            if done.any() and level[self.entry] >= layer:
                found = self._walk(queries, self._descend(queries, layer), layer, BUILD_WIDTH)[0]
            beside = np.broadcast_to(new, (len(new), len(new))).copy()
            np.fill_diagonal(beside, -1)
            gap = self._distances_to(queries, new)
            np.fill_diagonal(gap, np.inf)
            near = np.argsort(gap, axis=1, kind="stable")[:, :BUILD_WIDTH]
            candidates = np.concatenate([found, np.take_along_axis(beside, near, 1)], axis=1)
            chosen = self._diverse(queries, candidates)
            self.layers[layer][new, :chosen.shape[1]] = chosen
            self._link_back(layer, new, chosen)

    def _distances_to(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        other = self.points[ids]
        return np.maximum((queries ** 2).sum(1)[:, None] + (other ** 2).sum(1)[None, :] - 2 * queries @ other.T, 0)

    def _diverse(self, queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to LINKS of the candidates: nearest first, each nearer to the query than to those chosen before."""
        distance = self._distances(queries, candidates)
        order = np.argsort(distance, axis=1, kind="stable")[:, :BUILD_WIDTH]
        ids, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
        points = self.points[np.maximum(ids, 0)]
        square = (points ** 2).sum(2)
        between = square[:, :, None] + square[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        chosen = np.full((len(queries), LINKS), -1, dtype=np.int32)
        number = np.zeros(len(queries), dtype=int)
        taken = np.zeros(ids.shape, dtype=bool)
        for c in range(ids.shape[1]):
            nearest = np.where(taken, between[:, c, :], np.inf).min(axis=1)
            ok = (ids[:, c] >= 0) & (distance[:, c] < nearest) & (number < LINKS)
            taken[ok, c] = True
            chosen[ok, number[ok]] = ids[ok, c]
            number[ok] += 1
        for c in range(ids.shape[1]):  # what room is left goes to the nearest others
            ok = (ids[:, c] >= 0) & ~taken[:, c] & (number < LINKS)
            chosen[ok, number[ok]] = ids[ok, c]
            number[ok] += 1
        return chosen

    def _link_back(self, layer: int, new: np.ndarray, chosen: np.ndarray) -> None:
        source = np.repeat(new, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        gap = ((self.points[source] - self.points[target]) ** 2).sum(1)
        order = np.lexsort((gap, target))
        source, target = source[order], target[order]
        points, first, count = np.unique(target, return_index=True, return_counts=True)
        links = self.layers[layer]
        room = links.shape[1]
        place = np.arange(len(target)) - np.repeat(first, count)
        added = np.full((len(points), min(room, int(count.max()))), -1, dtype=np.int64)
        ok = place < added.shape[1]
        added[np.repeat(np.arange(len(points)), count)[ok], place[ok]] = source[ok]
        both = np.concatenate([links[points].astype(np.int64), added], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        distance = self._distances(self.points[points], both)
        keep = np.argsort(distance, axis=1, kind="stable")[:, :room]
        links[points] = np.take_along_axis(both, keep, 1)

    def search(self, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Ids of the ``width`` nearest points found (-1: none) per query, nearest first."""
        asked = queries / np.abs(queries).max(axis=1, keepdims=True)
        width = min(width, max(len(self.points), 1))
        longest = np.argsort(self.points[:, -1], kind="stable")[:width // 2]
        first = self._descend(asked, 0)
        entry = np.concatenate([first, np.where(longest == first, -1, longest)], axis=1)
        return self._walk(asked, entry, 0, width)[0]


def even(vectors: np.ndarray) -> np.ndarray:
    """The vectors, scaled, with one more coordinate that brings them to the same length, less that length."""
    scaled = vectors / np.abs(vectors).max()
    squares = np.einsum("ij,ij->i", scaled, scaled)
    length = np.sqrt(squares.max())
    return np.concatenate([scaled, (-squares / (length + np.sqrt(np.maximum(squares.max() - squares, 0))))[:, None]], axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of doubles) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    df = df.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = df.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return df.filter(F.size(v) == (size["size"] if size else 0))


def points(vectors: DataFrame, k: int) -> DataFrame:
    """vector and the k + 1 smallest vec_ids of each distinct vector."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return (vectors.dropDuplicates(["vec_id", "vector"]).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
            .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


_GRAPH = "shard int, ids array<array<bigint>>, dimensions int, vectors binary, links binary, widths array<int>, entry int"


def build(vectors: DataFrame, k: int = K, shard_points: int = SHARD_POINTS) -> DataFrame:
    """One row per shard: ids of its points, their vectors, and the flat neighbour arrays of its layers; written."""
    distinct = written(points(vectors, k), "points")
    shards = max(1, -(-distinct.count() // shard_points))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def run(batches):
        for g in _groups(batches, ["shard"]):
            order = sorted(range(len(g["ids"])), key=lambda i: g["ids"][i])
            own = np.array([g["vector"][i] for i in order], dtype=np.float64)
            graph = Graph.build(own)
            yield pa.RecordBatch.from_pylist([{
                "shard": g["shard"][0], "ids": [g["ids"][i] for i in order], "dimensions": own.shape[1],
                "vectors": own.tobytes(), "links": b"".join(x.tobytes() for x in graph.layers),
                "widths": [x.shape[1] for x in graph.layers], "entry": graph.entry}], schema=pa.schema([
                    ("shard", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64()))), ("dimensions", pa.int32()),
                    ("vectors", pa.binary()), ("links", pa.binary()), ("widths", pa.list_(pa.int32())), ("entry", pa.int32())]))

    return written(dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, _GRAPH), "graphs")


def _load(row: dict) -> tuple[Graph, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, row["dimensions"])
    layers, at = [], 0
    for width in row["widths"]:
        layers.append(np.frombuffer(row["links"], dtype=np.int32, count=len(vectors) * width, offset=at).reshape(-1, width))
        at += 4 * len(vectors) * width
    graph = Graph(even(vectors), layers, [])
    graph.entry = row["entry"]
    return graph, vectors


def search(graphs: DataFrame, queries: DataFrame, k: int = K, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each query (vec_id, vector)."""
    shards = graphs.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    sent = (queries.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("block"))
            .agg(F.collect_list("vec_id").alias("query_ids"), F.collect_list("vector").alias("queries"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0)))))).repartition("shard", "block")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                graph, vectors = _load(row)
                asked = np.array(row["queries"], dtype=np.float64)
                found = graph.search(asked, width)
                for q, query, own in zip(row["query_ids"], asked, found):
                    own = own[own >= 0]
                    scores = (vectors[own] * query).sum(axis=1)
                    best = sorted(((-s, i) for s, p in zip(scores.tolist(), own.tolist()) for i in row["ids"][p] if i != q))[:k]
                    if best:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([q] * len(best), pa.int64()), pa.array([i for _, i in best], pa.int64()),
                             pa.array([-s for s, _ in best], pa.float64())], names=["query_id", "vec_id", "score"])

    pairs = sent.join(graphs, "shard").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the 20 nearest of every vector whose vec_id is divisible by 20, among all vectors."""
    vectors = usable(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return search(build(vectors), vectors.filter("vec_id % 20 = 0").dropDuplicates(["vec_id"]))
