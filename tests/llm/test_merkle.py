"""The Merkle manifest against a tree built in Python, and its digests' definition."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from riskroll.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string, salt int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text=None):
    return h(*map(field, [row[0], row[3], row[2], row[4], row[1] if text is None else text]))


def climb(nodes):
    """Per node its siblings (left, right) by level, and the root."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i:i + 8]
            for j in range(len(run)):
                for k in under[i + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(h(*run))
            over.append([k for x in under[i:i + 8] for k in x])
        nodes, under = above, over
    return paths, nodes[0]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[lang] = climb([leaf(r) for r in trees[lang]])
    tops, root = climb([grown[lang][1] for lang in order])
    out = []
    for lang, above in zip(order, tops):
        for row, path in zip(trees[lang], grown[lang][0]):
            path = path + above
            shown = leaf(row)
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                shown = leaf(row, lowered(row[1]))
            for a, b in path:
                shown = h(a, shown, b)
            out.append((row[0], leaf(row), grown[lang][1], root, h(*(a + b for a, b in path)), shown, shown == root))
    return out


def verified(spark, rows, tmp_path, name):
    df = spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], SCHEMA)
    path = str(tmp_path / name)
    merkle.write_manifest(df, path, {"presented": merkle.tampered_leaf()})
    return path, [tuple(r) for r in merkle.verify(spark, path, "presented").collect()]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


ODD = [(None, "Ab", "en", None, 3), (None, "Ab", "en", None, 3), (4, None, None, "s", None), (4, "", None, "s", 0),
       (5, "ÄÖ Z" * 3, "en", "s", 9), (6, "Q" * 200_000, "é", "", 1), (5, "ÄÖ Z" * 3, "en", "s", 9), (7, "x", "", "s", 1),
       (-3, "UP", "en", "s", 2), (12, "UP", "zh", "s", 2)]


@pytest.mark.parametrize("rows", [
    ODD, [(1, "ONE", "en", "s", 3)], [(i, f"Text {i}", "en" if i % 9 else "de", "web", i) for i in range(1, 5300)],
    [(3, "same", "en", "s", 4)] * 700 + [(i, "B", f"l{i}", "s", 1) for i in range(20)]], ids=["odd", "one", "deep", "repeated"])
def test_manifest_equals_the_tree(spark, tmp_path, rows):
    path, got = verified(spark, rows, tmp_path, "m")
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert merkle.root(spark, path).hex() == got[0][3]


def test_only_every_third_level_is_stored(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(1100)]
    path, _ = verified(spark, rows, tmp_path, "m")
    stored = sorted(p.name for p in (tmp_path / "m" / "trees").iterdir() if p.name.startswith("level-"))
    assert stored == ["level-0", "level-3"]
    sizes = spark.read.parquet(f"{path}/trees/level-0").select(F.size("nodes")).collect()
    assert sorted(r[0] for r in sizes) == [76, 512, 512]


def test_proofs_fold_to_the_root(spark, tmp_path):
    path, _ = verified(spark, ODD, tmp_path, "m")
    for r in merkle.proofs(spark, path).collect():
        assert merkle.fold(bytes(r.leaf), [(bytes(x.left), bytes(x.right)) for x in r.path]) == bytes(r.root)


def test_empty_table(spark, tmp_path):
    path, got = verified(spark, [], tmp_path, "m")
    assert got == [] and merkle.root(spark, path) is None
    assert merkle.proofs(spark, path).collect() == []
