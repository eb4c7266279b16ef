"""Merkle manifest of a dataset: a tree of fan-out 8 per language and one over their roots, stored every third level.

Checkpoint and recompute: ``write_manifest`` stores the leaves and then only every ``STEP``-th level above them, as
Parquet.  A stored row is an *aligned subtree*: the ``SPAN`` consecutive nodes under one node of the next stored level.
The levels in between are never stored.  Proofs go from the top down: a task takes one subtree and the siblings above
it, regenerates the missing levels from the stored nodes, emits the siblings of every node and forgets them.  What a
task holds is one subtree (512 nodes) and one path (seven siblings a level), at any size of the table.

Order: leaves ascend by doc_id within their language; range partitions are cut on (language, doc_id, leaf, row
number), so no language, repeated doc_id or repeated row gathers in one task.  A place in the tree is the place in the
partition plus the rows of the language in earlier partitions; those sums have a row per partition and language.

Defined results: a null field counts as ``-``; the null language is a tree of its own, first; null doc_ids come first
in their tree, and tampering never touches them; equal doc_ids are ordered by leaf, so repeated rows are leaves of
their own; an empty text is the field ``0:``; an empty table has no leaf, no root and no proof; further columns are
ignored whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_path, table

FANOUT = 8
STEP = 3
SPAN = FANOUT ** STEP
#: A table of offsets up to so many rows (of under 100 bytes each, long names of languages aside) is broadcast.
SMALL_ROWS = 200_000
_ROW = (1 << 33) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings on the way up: those left of the node and those right of it, digests one after the other, per level.
PATH = "array<struct<left:binary,right:binary>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a document's row (``text`` in place of its own text, if given)."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"),
              F.col("text") if text is None else text]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed(nodes: DataFrame, order: list[str], path: str) -> DataFrame:
    """``nodes`` with n (the nodes of their tree) and pos (place in it by ``order``, from 0)."""
    salted = _stored(nodes.withColumn("salt", F.monotonically_increasing_id()), f"{path}/unordered")
    keys = ["tree", *order, "salt"]
    ordered = _stored(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
                      .withColumn("at", F.monotonically_increasing_id()), f"{path}/ordered")
    ordered = ordered.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(_ROW)))
    runs = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")
    runs = _stored(runs.select(
        "tree", "part", F.sum("rows").over(of_tree).alias("n"),
        (F.sum("rows").over(of_tree.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift")), f"{path}/runs")
    runs = F.broadcast(runs) if runs.count() <= SMALL_ROWS else runs
    return ordered.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def digest(nodes: list[bytes]) -> bytes:
    """Digest of a run of nodes: their digests as hex text, one after the other."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def regenerate(nodes: list[bytes], alone: bool) -> list[list[bytes]]:
    """The levels of a subtree from its stored nodes up to its top; ``alone`` if it is a whole tree."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= STEP:
        below = levels[-1]
        levels.append([digest(below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _subtrees(nodes: DataFrame, carried: list[str]) -> DataFrame:
    node = F.struct("pos", "digest", *carried)
    return nodes.groupBy("tree", "n", F.floor(F.col("pos") / SPAN).cast("long").alias("subtree")).agg(
        F.sort_array(F.collect_list(node)).alias("nodes"))


def _tops(subtrees: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            tops = []
            for n, nodes in zip(batch.column("n").to_pylist(), batch.column("digests").to_pylist()):
                tops.append(regenerate(nodes, n <= SPAN)[-1][0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("n"), batch.column("subtree"), pa.array(tops, pa.binary())],
                names=["tree", "n", "subtree", "digest"])

    return subtrees.select("tree", "n", "subtree", F.col("nodes.digest").alias("digests")).mapInArrow(
        run, "tree string, n long, subtree long, digest binary")


def _grow(leaves: DataFrame, order: list[str], carried: list[str], path: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels of all trees over ``leaves`` (tree, digest), bottom first, and their roots (tree, digest)."""
    nodes, levels, roots = _placed(leaves, order, path), [], None
    largest = 1
    while largest:
        level = _stored(_subtrees(nodes, [] if levels else carried), f"{path}/level-{STEP * len(levels)}")
        levels.append(level)
        tops = _stored(_tops(level), f"{path}/tops-{STEP * len(levels)}")
        whole = tops.filter(F.col("n") <= SPAN).select("tree", "digest")
        roots = whole if roots is None else roots.union(whole)
        nodes = tops.filter(F.col("n") > SPAN).select(
            "tree", F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.col("subtree").alias("pos"), "digest")
        largest = nodes.agg(F.max("n")).first()[0]
    return levels, _stored(roots, f"{path}/roots")


def _paths_down(levels: list[DataFrame], above: DataFrame, path: str, emit, schema: str) -> DataFrame:
    """``emit`` over the lowest level with the path of every subtree; ``above`` (tree, path, ...) holds those of the roots.

    From the top level down, each subtree gets the path of its top and hands every node its own.
    """
    given = above.columns[1:]
    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in above.schema.fields[1:])
    from_above = None
    for k in range(len(levels) - 1, -1, -1):
        wanted = levels[k].filter(F.col("n") <= SPAN).select("tree", F.col("subtree")).join(above, "tree")
        if from_above is not None:
            wanted = wanted.unionByName(from_above)
        level = levels[k].join(wanted, ["tree", "subtree"])
        if not k:
            return level.mapInArrow(emit, schema)
        from_above = _stored(level.mapInArrow(_hand_down(given), f"tree string, subtree long, {inner}"), f"{path}/paths-{k}")
    raise ValueError("a manifest has one level at least")


def node_paths(nodes: list[bytes], alone: bool, above: list[tuple[bytes, bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """The path of every node of a subtree whose top has the path ``above``."""
    levels = regenerate(nodes, alone)
    paths = [above]
    for level in levels[-2::-1]:
        own = []
        for i in range(len(level)):
            start = i - i % FANOUT
            own.append([(b"".join(level[start:i]), b"".join(level[i + 1:start + FANOUT])), *paths[i // FANOUT]])
        paths = own
    return paths


def _pairs(path: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(x["left"], x["right"]) for x in path]


def _hand_down(given: list[str]):
    def run(batches):
        for batch in pieces(batches, 1 << 18):
            for row in batch.to_pylist():
                paths = node_paths([x["digest"] for x in row["nodes"]], row["n"] <= SPAN, _pairs(row["path"]))
                rows = [{"tree": row["tree"], "subtree": x["pos"], **{c: row[c] for c in given},
                         "path": [{"left": a, "right": b} for a, b in p]} for x, p in zip(row["nodes"], paths)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [batch.schema.field("tree"), batch.schema.field("subtree"), *map(batch.schema.field, given)]))

    return run


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = sha256((left + node + right).hex().encode()).digest()
    return node


def path_digest(path: list[tuple[bytes, bytes]]) -> bytes:
    """Digest of all siblings of a proof, level by level, left to right."""
    return sha256(b"".join(a + b for a, b in path).hex().encode()).digest()


def write_manifest(docs: DataFrame, path: str, carry: dict[str, Column] | None = None) -> None:
    """Store the manifest of ``docs`` (doc_id, source, lang, n_chars, text) under ``path``.

    ``path``/trees has the levels of the languages' trees, ``path``/top those of the tree over their roots.  ``carry``
    names values of the documents to keep beside their leaves (slim ones: digests, keys).
    """
    carry = carry or {}
    leaves = docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"),
        *[v.alias(c) for c, v in carry.items()])
    _, roots = _grow(leaves, ["doc_id", "digest"], ["doc_id", *carry], f"{path}/trees")
    _grow(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], ["name"], f"{path}/top")


def _levels(spark: SparkSession, path: str) -> list[DataFrame]:
    names, k = [], 0
    manager = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = manager(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while files.exists(manager(f"{path}/level-{k}")):
        names.append(f"{path}/level-{k}")
        k += STEP
    return [spark.read.parquet(x) for x in names]


def root(spark: SparkSession, path: str) -> bytes | None:
    """The root of a stored manifest; None for an empty table."""
    row = spark.read.parquet(f"{path}/top/roots").first()
    return bytes(row.digest) if row else None


def _extract(spark: SparkSession, path: str, emit, schema: str) -> DataFrame:
    between = shared_path(spark, "merkle-paths")
    top = _levels(spark, f"{path}/top")
    nothing = spark.read.parquet(f"{path}/top/roots").select(
        "tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))

    def roots(batches):
        for batch in pieces(batches):
            for row in batch.to_pylist():
                paths = node_paths([x["digest"] for x in row["nodes"]], row["n"] <= SPAN, _pairs(row["path"]))
                yield pa.RecordBatch.from_pylist(
                    [{"tree": x["name"], "path": [{"left": a, "right": b} for a, b in p], "subroot": x["digest"],
                      "root": row["root"]} for x, p in zip(row["nodes"], paths)],
                    schema=pa.schema([batch.schema.field("tree"), batch.schema.field("path"),
                                      pa.field("subroot", pa.binary()), batch.schema.field("root")]))

    above = _stored(_paths_down(top, nothing, f"{between}/top", roots, f"tree string, path {PATH}, subroot binary, root binary"),
                    f"{between}/roots")
    return _paths_down(_levels(spark, f"{path}/trees"), above, f"{between}/trees", emit, schema)


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Inclusion proofs of all leaves: doc_id, leaf, subroot, root, path (siblings left and right, leaf level first)."""
    schema = f"doc_id long, leaf binary, subroot binary, root binary, path {PATH}"

    def emit(batches):
        for batch in pieces(batches, 1 << 18):
            for row in batch.to_pylist():
                paths = node_paths([x["digest"] for x in row["nodes"]], row["n"] <= SPAN, _pairs(row["path"]))
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": x["doc_id"], "leaf": x["digest"], "subroot": row["subroot"], "root": row["root"],
                      "path": [{"left": a, "right": b} for a, b in p]} for x, p in zip(row["nodes"], paths)],
                    schema=pa.schema([pa.field("doc_id", pa.int64()), *(pa.field(c, pa.binary()) for c in (
                        "leaf", "subroot", "root")), batch.schema.field("path")]))

    return _extract(spark, path, emit, schema)


def verify(spark: SparkSession, path: str, presented: str) -> DataFrame:
    """Every leaf's proof against the digest carried in ``presented`` (null: the leaf itself).

    doc_id, leaf, subroot, root, proof_sha256, folded_root (hex) and verified.  Siblings are used where they are
    regenerated and never leave the task.
    """
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def emit(batches):
        for batch in pieces(batches, 1 << 20):
            out = {c: [] for c in ["doc_id", *names]}
            for row in batch.to_pylist():
                nodes = row["nodes"]
                root_, sub = row["root"].hex(), row["subroot"].hex()
                for x, p in zip(nodes, node_paths([x["digest"] for x in nodes], row["n"] <= SPAN, _pairs(row["path"]))):
                    out["doc_id"].append(x["doc_id"])
                    out["leaf"].append(x["digest"].hex())
                    out["subroot"].append(sub)
                    out["root"].append(root_)
                    out["proof_sha256"].append(path_digest(p).hex())
                    out["folded_root"].append(fold(x["digest"] if x[presented] is None else x[presented], p).hex())
            yield pa.RecordBatch.from_pydict(
                {**out, "verified": [a == b for a, b in zip(out["folded_root"], out["root"])]},
                schema=pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names), ("verified", pa.bool_())]))

    return _extract(spark, path, emit, "doc_id long, " + ", ".join(f"{c} string" for c in names) + ", verified boolean")


def tampered_leaf() -> Column:
    """Digest of the row with A-Z of its text in lower case where 3 divides the CRC-32 of the doc_id; null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    return F.when(hit, leaf_digest(F.translate("text", UPPER, LOWER)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the manifest of all documents, and the proof of each against its row, tampered with or not."""
    path = shared_path(spark, "merkle")
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    write_manifest(docs, path, {"presented": tampered_leaf()})
    return verify(spark, path, "presented")


def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


SQL = f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, lang, {_sql_leaf('text')} AS leaf, {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS other,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: (xor(a, x) >> 1).xor(3988292384 * (xor(a, x) & 1)))) % 3 = 0 AS hit
  FROM documents),
l AS (
  SELECT *, row_number() OVER () AS uid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, n, lvl, pos, h) AS (
  SELECT lang, n, 0, pos, leaf FROM l
  UNION ALL
  SELECT lang, (n + 7) // 8, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1
  GROUP BY lang, n, lvl, pos // 8),
s AS (SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM t WHERE n = 1),
u(n, lvl, pos, h) AS (
  SELECT n, 0, pos, subroot FROM s
  UNION ALL
  SELECT (n + 7) // 8, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1
  GROUP BY n, lvl, pos // 8),
low AS (
  SELECT l.uid, t.lvl AS step, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < l.pos // (8 ** t.lvl)::BIGINT), '')
         AS a, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > l.pos // (8 ** t.lvl)::BIGINT), '') AS b
  FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.pos // 8 = l.pos // (8 ** (t.lvl + 1))::BIGINT
  GROUP BY ALL),
high AS (
  SELECT s.lang, 1000 + u.lvl AS step, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos < s.pos // (8 ** u.lvl)::BIGINT), '')
         AS a, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos > s.pos // (8 ** u.lvl)::BIGINT), '') AS b
  FROM s JOIN u ON u.n > 1 AND u.pos // 8 = s.pos // (8 ** (u.lvl + 1))::BIGINT GROUP BY ALL),
steps AS (
  SELECT * FROM low UNION ALL
  SELECT l.uid, high.step, high.a, high.b FROM l JOIN high ON high.lang IS NOT DISTINCT FROM l.lang),
p AS (SELECT uid, string_agg(a || b, '' ORDER BY step) AS siblings, list(a || '|' || b ORDER BY step) AS way FROM steps GROUP BY uid),
r AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
         list_reduce(list_concat([CASE WHEN coalesce(l.hit, false) THEN l.other ELSE l.leaf END], coalesce(p.way, [])),
                     lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN p USING (uid))
SELECT *, folded_root = root AS verified FROM r
"""
