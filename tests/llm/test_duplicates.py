"""Near-duplicate documents and lines against direct comparison of all pairs."""

import random
import time

import numpy as np

import pytest
from pyspark.sql import functions as F

from riskroll.llm import line_dedup, linking, near_dup
from riskroll.llm.common import ship

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def documents():
    rng = random.Random(9)
    base = [[rng.choice(WORDS) for _ in range(n)] for n in (3, 5, 30, 120, 300, 300, 900)]
    docs = {}
    for k, words in enumerate(base):
        for c in range(12):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 20]) if len(words) > 20 else 0):
                own[rng.randrange(len(own))] = rng.choice(WORDS) + "x"
            docs[100 * k + c] = (" " if c % 2 else "\n").join(own).upper() if c % 3 else " ".join(own)
    docs |= {900: None, 901: "", 902: " \t\n", 903: "one", 904: "ONE", 905: "é É", 906: "w " * 30_000, 907: "w\x0bw w\x1cw w w"}
    return docs


def test_near_duplicates_equal_all_pairs(spark):
    ship(spark)
    docs = documents()
    sets = {d: grams(t) for d, t in docs.items()}
    linked = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = groups(sorted(docs), linked)
    rows = [(d, t, "clash") for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.report(df).collect()}
    assert got == {d: (len(sets[d]), expected[d], expected[d] == d) for d in docs}
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in docs if expected[d] == d)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """A hot group cut into many blocks: hub first, then what is left outside against the other blocks."""
    ship(spark)
    rng = random.Random(12)
    words = [rng.choice(WORDS) for _ in range(150)]
    docs = {}
    for c in range(150):
        own = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(50)}"
        docs[c] = " ".join(own)
    sets = {d: grams(t) for d, t in docs.items()}
    expected = groups(sorted(docs), [(a, b) for a in docs for b in docs if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    monkeypatch.setattr(near_dup, "BLOCK_WEIGHT", 3000)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.report(df).collect()}
    assert got == expected


def test_repeated_rows_and_null_ids(spark):
    ship(spark)
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (None, None), (7, "A b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dup.report(df).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("7", 2, 5, False), ("None", 0, None, True), ("None", 1, None, True), ("None", 2, 5, True)]
    assert near_dup.report(df.limit(0)).collect() == []
    assert near_dup.keep_first(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    expected = groups(sorted({n for e in edges for n in e}), edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in linking.components(df).collect()}
    assert got == {n: c for n, c in expected.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert linking.components(df.limit(0)).collect() == []


def line_texts():
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long = [line(200) for _ in range(4)]
    docs = []
    for d in range(40):
        own = [line(rng.randint(3, 12)) for _ in range(rng.randint(0, 5))]
        for x in long:
            if rng.random() < 0.5:
                words = x.split()
                for _ in range(rng.choice([0, 0, 1, 2, 60])):
                    words[rng.randrange(len(words))] = rng.choice(WORDS)
                own.append(rng.choice([" ", "  "]).join(words).upper() + rng.choice(["", ".", "!"]))
        rng.shuffle(own)
        docs.append((d, "\n".join([*own, "The end.", "", "***"])))
    return [*docs, (50, None), (51, ""), (52, "\n\n"), (7, docs[7][1]), (None, "the END"), (60, "y " * 30_000 + "\n" + "y " * 29_999)]


def line_brute_force(docs):
    """Line groups by comparing every pair of distinct normalised lines."""
    places = {}
    for d, t in docs:
        for i, x in enumerate((t or "").split("\n")):
            w = tuple(line_dedup.line_words(x))
            if w:
                places.setdefault(w, []).append((-1 if d is None else d, i))
    classes = sorted(places)
    _, _, s1, s2 = line_dedup.simhashes(b"\n".join(b" ".join(w) for w in classes))
    number = [(int(a) & (2**64 - 1)) << 32 | int(b) for a, b in zip(s1, s2)]
    linked = [(a, b) for i, a in enumerate(classes) for j, b in enumerate(classes)
              if i < j and (number[i] ^ number[j]).bit_count() <= line_dedup.MAX_BITS and line_dedup.similar(list(a), list(b))]
    of = groups(classes, linked)
    first = {}
    for w, own in places.items():
        first[of[w]] = min(first.get(of[w], (1 << 60, 0)), min(own))
    return {(p, w): first[of[w]] for w, own in places.items() for p in own}, linked


def test_lines_equal_all_pairs(spark):
    ship(spark)
    docs = line_texts()
    expected, linked = line_brute_force(docs)
    assert linked  # there are fuzzy links beside the equal lines
    df = spark.createDataFrame([(*r, 5, "clash") for r in docs], "doc_id long, text string, n_chars int, hash string")
    got = line_dedup.decisions(df).collect()
    by_place = {place: first for (place, _), first in expected.items()}
    for r in got:
        place = (-1 if r.doc_id is None else r.doc_id, r.line)
        first = (-1 if r["first"].doc_id is None else r["first"].doc_id, r["first"].line)
        assert first == by_place[place] and r.kept == (first == place)
    left = line_dedup.drop_repeated(df)
    assert left.columns == df.columns
    texts = {}
    for r in left.collect():
        texts.setdefault(r.doc_id, []).append(r)
    for d, t in docs:
        key = -1 if d is None else d
        own = [x for i, x in enumerate((t or "").split("\n")) if by_place.get((key, i), (key, i)) == (key, i)]
        row = texts[d].pop()
        changed = t is not None and len(own) < len(t.split("\n"))
        assert row.text == ("\n".join(own) if changed else t)
        assert row.n_chars == (len(row.text) if changed else 5)
    assert line_dedup.drop_repeated(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_edit_distance(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        assert line_dedup.edit_distance(a, b, 20) == row[-1]
        assert (line_dedup.edit_distance(a, b, 2) <= 2) == (row[-1] <= 2)
        if a and b and abs(len(a) - len(b)) <= 4:
            x, y = (np.array([ord(w) for w in words]) for words in (a, b))
            assert line_dedup._banded(x, y, 4) == min(row[-1], 5)


def test_edit_distance_of_whole_rows():
    """Lines of more words than a machine word has bits are aligned exactly, and a row costs less than a pass of numpy."""
    rng = random.Random(9)
    for n in (61, 64, 130, 257):
        a = [rng.choice("abcde") for _ in range(n)]
        b = [w if rng.random() < 0.8 else rng.choice("abcde") for w in a if rng.random() < 0.9]
        far = len(a) + len(b)
        x, y = (np.array([ord(w) for w in words]) for words in (a, b))
        d = line_dedup._banded(x, y, far)
        assert line_dedup.edit_distance(a, b, far) == d
        assert line_dedup.edit_distance(a, b, d) == d and line_dedup.edit_distance(a, b, d - 1) > d - 1
    a, b = ([f"{side}{i}" if i % 6 == 0 else f"w{i}" for i in range(150)] for side in "xy")
    start = time.process_time()
    for _ in range(200):
        assert line_dedup.edit_distance(a, b, 30) == 25
    bits = time.process_time() - start
    x, y = np.arange(150), np.array([-i if i % 6 == 0 else i for i in range(150)])
    start = time.process_time()
    for _ in range(20):
        line_dedup._banded(x, y, 30)
    assert bits < 5 * (time.process_time() - start)  # ten times the pairs


def test_block_pairs_cover_three_bits(spark):
    """Any two SimHashes at most 3 bits apart share a bucket key."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x = rng.getrandbits(96)
        y = x
        for b in rng.sample(range(96), 3):
            y ^= 1 << b
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        rows += [(i, signed(v >> 32), v & 0xFFFFFFFF) for v in (x, y)]
    keys = spark.createDataFrame(rows, "i long, s1 long, s2 long").select("i", F.explode(line_dedup.bucket_keys()).alias("k"))
    assert keys.groupBy("i", "k").count().filter("count > 1").select("i").distinct().count() == 300


def test_simhash_bits_are_majorities():
    rng = random.Random(8)
    lines = [[rng.choice(WORDS).encode() for _ in range(n)] for n in (1, 2, 3, 7, 8, 200, 64, 0, 5)]
    text = b"\n".join(b" ".join(w) for w in lines)
    number, counts, s1, _ = line_dedup.simhashes(text)
    assert number.tolist() == [0, 1, 2, 3, 4, 5, 6, 8] and counts.tolist() == [len(w) for w in lines if w]
    alone = {w: int(line_dedup.simhashes(w)[2][0]) for words in lines for w in words}
    for words, got in zip([w for w in lines if w], s1.tolist()):
        for bit in range(64):
            ones = sum(alone[w] >> bit & 1 for w in set(words))
            assert (got >> bit & 1) == (2 * ones > len(set(words)))


def test_lines_of_edit_similarity_are_linked(spark):
    """Lines of 10 to 50 words with as many edits as similarity 0.8 allows, against edit similarity alone."""
    ship(spark)
    rng = random.Random(31)
    lines = [["same"] * 9 + ["x", "y"], ["same"] * 9 + ["u", "v"], "a b c d".split(), "a b c d e".split()]
    for n in [*range(10, 30), 35, 40, 45, 50] * 3:
        words = [rng.choice(WORDS) for _ in range(n)]
        lines.append(words)
        for typos in (False, True):
            own = list(words)
            for at in rng.sample(range(n), n // 5):
                own[at] = f"typo{rng.randrange(10**9)}" if typos else rng.choice(WORDS)
            lines.append(own)
        own = list(words)
        for _ in range(n // 10):
            del own[rng.randrange(len(own))]
            own.insert(rng.randrange(len(own)), rng.choice(WORDS))
        lines.append(own)
    expected = groups(range(len(lines)), [(i, j) for i in range(len(lines)) for j in range(i)
                                          if line_dedup.similar(lines[i], lines[j])])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r["first"].doc_id for r in line_dedup.decisions(df).collect()}
    assert sum(i != f for i, f in expected.items()) > 200
    assert got == expected


def test_common_words_count_every_document(spark, monkeypatch):
    """The order of words follows the lines of all documents, however many there are."""
    monkeypatch.setattr(line_dedup, "SAMPLE_DOCS", 10, raising=False)
    monkeypatch.setattr(line_dedup, "COUNTED_AT_ONCE", 5, raising=False)
    texts = [f"all all\nhalf{i % 2} n{i}" for i in range(60)] + [None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert len(line_dedup.common_words(docs)) == 3
    first = line_dedup.common_words(docs)[0]
    h, _ = line_dedup.word_hashes(b"all")
    assert first == h[0] >> np.uint64(64 - line_dedup._WORD_BITS)


def test_parities_bound_the_edit_distance():
    """No pair of similar lines is left out, and pairs that share a few words by chance are."""
    rng = random.Random(3)
    lines = []
    for n in (1, 4, 9, 31, 33, 64, 65, 130, 400, 1500):
        words = [rng.choice(WORDS) for _ in range(n)]
        for edits in (0, 1, n // 5, n // 4, n):
            own = list(words)
            for _ in range(edits):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice([[], [own[at], "new"], [f"typo{rng.randrange(99)}"]]) if len(own) > 1 else ["new"]
            lines.append(own)
    lines += [["a"] * 40, ["b"] * 40, ["a"] * 30 + ["b"] * 10, ["a"] * 33 + ["b"] * 7]
    h, of = line_dedup.word_hashes(" \n".join(" ".join(words) for words in lines).encode())
    counts = np.array([len(words) for words in lines])
    parity = line_dedup.parities(h, of, counts).to_pylist()
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(lines)), np.arange(len(lines))))
    may = line_dedup.may_be_similar(counts, parity, left, right)
    similar = np.array([line_dedup.similar(lines[i], lines[j]) for i, j in zip(left, right)])
    assert (may | ~similar).all() and similar.sum() > len(lines) and may.sum() < 2 * similar.sum()


def test_classes_of_parts_meet(monkeypatch):
    """Packed entries of several tasks give every bucket's set of classes once."""
    rng = random.Random(4)
    entries = sorted({(rng.randrange(200) << 33 | rng.randrange(5), rng.randrange(150)) for _ in range(600)})
    own = {}
    for key, bucket in entries:
        own.setdefault(bucket, set()).add(key)
    cut = [entries[:200], [], entries[200:] + entries[200:210]]
    packed = [[line_dedup._packed(x) for x in (np.diff(np.array([k for k, _ in c], dtype=np.int64), prepend=0),
                                                np.array([b for _, b in c], dtype=np.uint64))] for c in cut if c]
    got = line_dedup.shared_buckets(*zip(*packed))
    assert sorted(map(sorted, got.column("keys").to_pylist())) == sorted(map(list, {tuple(sorted(s)) for s in own.values() if len(s) > 1}))
    assert got.column("n").to_pylist() == [len(k) for k in got.column("keys").to_pylist()]


def test_clusters_are_cut_where_no_pair_may_be_similar():
    """Two pairs and a chain in one cluster, and nothing of one with chance members."""
    rng = random.Random(5)
    base = [[rng.choice(WORDS) for _ in range(20)] for _ in range(6)]
    chain = [base[2], [*base[2][3:], "c1", "c2", "c3"], [*base[2][6:], "c1", "c2", "c3", "d1", "d2", "d3"]]
    lines = [base[0], base[1], chain[2], [*base[0], "x"], [*base[1][1:], "y"], chain[0], chain[1], base[3], base[4], base[5]]
    h, of = line_dedup.word_hashes("\n".join(map(" ".join, lines)).encode())
    counts = np.array([len(words) for words in lines])
    parity = line_dedup.parities(h, of, counts).to_pylist()
    keys = np.arange(10) * 7
    found = line_dedup.near_members(np.array([1] * 8 + [2] * 2), keys, counts, parity).column("keys").to_pylist()
    assert sorted(map(sorted, found)) == [[0, 21], [7, 28], [14, 35, 42]]
    label = line_dedup._joined(np.arange(60), np.arange(0, 50, 2), np.arange(2, 52, 2))
    assert label.tolist() == [0 if i % 2 == 0 and i <= 50 else i for i in range(60)]


def test_words_of_chance_meetings_are_not_fetched(spark, monkeypatch):
    """Lines that share their two rarest words and nothing else cost no words on disk; similar ones do."""
    ship(spark)
    rng = random.Random(6)
    texts = [f"rare{i % 40} odd{i % 40} " + " ".join(rng.choice(WORDS) for _ in range(18)) for i in range(400)]
    texts += [texts[0] + " more"]
    tables = {}
    plain = line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name, **o: tables.setdefault(name, plain(df, name, **o)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r["first"].doc_id for r in line_dedup.decisions(df).collect()}
    assert got == {i: 0 if i == 400 else i for i in range(401)}
    assert {r.words for r in tables["member-lines"].collect()} == {texts[0], texts[400]}
