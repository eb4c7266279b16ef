"""Benchmark decontamination against direct comparison of every window."""

import random

from riskroll.llm import decontaminate as d
from riskroll.llm.common import ship


def rows():
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta Eta théta iota kappa".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 13, 20, 40])))) for i in range(12)]
    items += [(3, items[3][1]), (None, "only one"), (90, None), (91, "..!"), (92, "Same Passage " * 9), (93, "same passage " * 9)]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)]
    for i in range(30, 45):
        passage = (items[i - 30][1] or "").upper().replace(" ", "-- ")
        docs.append((i, " ".join(word() + "x" for _ in range(rng.randint(0, 300))) + " " + passage + " tail " * rng.randint(0, 9)))
    docs += [(50, None), (51, ""), (52, "é" * 9000), (53, "same  passage\n" * 40), (53, "same  passage\n" * 40), (None, "only, one!"),
             (54, "w " * 20000 + (items[2][1] or ""))]
    return docs, items


def test_against_brute_force(spark):
    ship(spark)
    docs, items = rows()
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(d.brute_force(docs, items), key=str)
    assert sorted(map(tuple, d.report(df, bench).collect()), key=str) == expected
    kept = d.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in expected if not r[-1])


def test_blocks_of_the_benchmark_give_the_same(spark):
    ship(spark)
    docs, items = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = d.scan_documents(df, bench).collect()
    many = d.scan_documents(df, bench, block_bytes=400).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_empty_tables(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in d.report(docs, none).collect()] == [(1, 3, 0, 0)]
    assert d.report(docs.limit(0), none).collect() == []


def test_blocks_hold_distinct_items_up_to_their_bound(spark):
    """Every distinct item is in one block; none is over the bound but for a single item larger than it."""
    texts = [f"{'w' * (i % 40)} item {i}" for i in range(200)] + ["same text"] * 500 + ["long " * 100]
    items = spark.createDataFrame([(str(i % 50), t) for i, t in enumerate(texts)], "item string, text string").distinct()
    blocks = [items.filter(c).collect() for c in d._blocks(items, 300)]
    assert sorted(map(tuple, items.collect())) == sorted(tuple(r) for b in blocks for r in b)
    assert all(len(b) == 1 or sum(len(r.text) for r in b) <= 300 for b in blocks)
    assert len(d._blocks(items, 1 << 20)) == 1
