"""Near-duplicate linking without all pairs: connected components, and exact links inside candidate clusters.

``components`` contracts a graph: every node takes its smallest neighbour, pointers are jumped, edges are rewritten
and made distinct, until none is left.  Every step is a join or a map-side-combined sum on slim rows.

``links_within`` verifies candidate clusters.  A cluster is cut by hash into blocks of bounded weight; a block is
compared with itself and with the cluster's hub (the member that meets most others).  What is linked to the hub needs
no further comparison with one another, so a cluster of true near copies costs linear work.  Only the members left
outside are compared with the other blocks.  A task holds two blocks at most and reports a spanning forest of the
links it finds (never all pairs), so no link that joins two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Most bytes of a side that is sent to all executors (and built on the driver).
BROADCAST_BYTES = 48 << 20


def small_side(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """Broadcast hint for a side whose counted ``rows`` of at most ``width`` bytes each are few; beyond that Spark joins
    by shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it is connected with) of all nodes with an edge in ``edges`` (a, b)."""
    def ordered(df: DataFrame) -> DataFrame:
        return df.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, labels = written(ordered(edges), "edges"), None
    nothing = left.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("up"))
        up = written(up, "up")
        for _ in range(2):
            onward = up.select(F.col("node").alias("up"), F.col("up").alias("onward"))
            up = up.join(onward, "up").select("node", F.col("onward").alias("up"))
        up = written(up, "up")
        left = written(ordered(
            left.join(up.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
            .select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "edges")
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            labels = written(labels.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")), "labels")
    return nothing if labels is None else labels


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


#: (payload columns of the members, left members, right members, forest) to linked pairs; pairs already joined in the
#: forest may be skipped.  Left and right are equal for a block against itself.
Compare = Callable[[dict[str, list], list[int], list[int], Forest], Iterable[tuple[int, int]]]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Consecutive rows with the same keys, as columns."""
    held: dict[str, list] = {}
    current = None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        marks = list(zip(*(columns[k] for k in keys)))
        start = 0
        for i in range(len(marks) + 1):
            if i < len(marks) and marks[i] == current:
                continue
            if i > start:
                for c, v in columns.items():
                    held.setdefault(c, []).extend(v[start:i])
            if i < len(marks):
                if current is not None and held:
                    yield held
                held, current, start = {}, marks[i], i
    if held:
        yield held


def links_within(members: DataFrame, compare: Compare, block_weight: int) -> DataFrame:
    """Links (a, b) that join the linked members of each cluster.

    ``members``: a written table of ``node`` (repeats do no harm) with ``cluster``, ``weight`` (memory it takes), ``degree`` (the hub
    has the highest) and payload columns.
    """
    totals = members.groupBy("cluster").agg(
        F.ceil(F.sum("weight") / block_weight).cast("int").alias("blocks"),
        F.max(F.struct("degree", "node"))["node"].alias("hub")).filter("blocks > 1")
    totals = written(totals, "clusters")  # a row per block weight at most: all other clusters are one block
    placed = members.join(small_side(totals, totals.count()), "cluster", "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    hubs = placed.filter(F.col("node") == F.col("hub")).withColumn("own", F.col("block")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block != own").drop("own")
    names = [c for c in placed.columns if c not in ("cluster", "block", "blocks", "hub", "node", "weight", "degree")]
    node_type = members.schema["node"].dataType.simpleString()
    out = f"cluster {members.schema['cluster'].dataType.simpleString()}, block int, node {node_type}, inside boolean, a {node_type}, b {node_type}"
    arrow = members.select("cluster", F.lit(0).alias("block"), "node", F.lit(True).alias("inside"),
                           F.col("node").alias("a"), F.col("node").alias("b")).limit(0).toArrow().schema

    def own_block(batches):
        for g in _groups(batches, ["cluster", "block"]):
            n = len(g["node"])
            forest = Forest(n)
            found = [(i, j) for i, j in compare({c: g[c] for c in names}, list(range(n)), list(range(n)), forest)
                     if forest.join(i, j)]
            hub = next((i for i in range(n) if g["node"][i] == g["hub"][i]), 0)
            rows = [{"cluster": g["cluster"][0], "block": g["block"][0], "node": g["node"][i],
                     "inside": forest.root(i) == forest.root(hub), "a": None, "b": None}
                    for i in range(n) if g["blocks"][0] > 1]
            rows += [{"cluster": g["cluster"][0], "block": None, "node": None, "inside": None, "a": g["node"][i],
                      "b": g["node"][j]} for i, j in found]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def in_groups(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

    first = written(in_groups(placed.unionByName(hubs), ["cluster", "block"], own_block, out), "block-links")
    links = first.filter("a is not null").select("a", "b")
    outside = first.filter("node is not null and not inside").select("cluster", "node", "block")
    if outside.isEmpty():
        return links
    # the members outside against every other block of their cluster
    n_outside = outside.count()
    left = (placed.join(small_side(outside.select("cluster", "node"), n_outside), ["cluster", "node"], "left_semi")
            .withColumn("i", F.col("block"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("i != j").withColumn("side", F.lit(0)))
    blocks_left = outside.select("cluster", F.col("block").alias("i")).distinct()
    right = (placed.join(small_side(blocks_left, n_outside), "cluster").withColumn("j", F.col("block")).filter("i != j")
             .withColumn("side", F.lit(1)))

    def two_blocks(batches):
        for g in _groups(batches, ["cluster", "i", "j"]):
            sides = [[k for k, s in enumerate(g["side"]) if s == side] for side in (0, 1)]
            forest = Forest(len(g["node"]))
            rows = [{"a": g["node"][i], "b": g["node"][j]}
                    for i, j in compare({c: g[c] for c in names}, *sides, forest) if forest.join(i, j)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([arrow.field("a"), arrow.field("b")]))

    more = in_groups(left.unionByName(right), ["cluster", "i", "j"], two_blocks, f"a {node_type}, b {node_type}")
    return links.union(written(more, "far-links"))
