"""Token pieces, packing and rANS output against the tokenizer itself and exact round trips."""

import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from riskroll.llm import packing, rans, tokens
from riskroll.llm.common import ship, shared_path
from riskroll.llm.tokens import Encoder, default_path

TEXTS = [None, "", " ", "a", "The cat, the cat.\nThe cat!", "x  y\t z", "\n\nfoo \n bar", "l'été  où 12.5 <|endoftext|>",
         "word " * 3000, "one-two " * 700, "0", "a\x00b c"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, "a", "clash", 7), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, part int")


def plain(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_tokenizer():
    rng = random.Random(3)
    letters = " \n\t\x00\r 　abc'é12.,!?ß"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = list(Encoder.shared(default_path()).encode(texts))
    t = Encoder.shared(default_path())
    assert got == [t._whole([x])[0] for x in texts]


def test_full_cache_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 40)
    encoder, learned, whole = Encoder(default_path()), [], Encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: learned.extend(texts) or whole(encoder, texts))
    for i in range(60):
        text = "the frequent words, again.\nand " + " ".join(f"w{i}x{j}" for j in range(15))
        learned.clear()
        assert list(encoder.encode([text])) == whole(encoder, [text])
        assert not i or not any("frequent" in x or "again" in x for x in learned)
        assert len(encoder.cache) + len(encoder.old) < 150


def test_cache_of_long_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHARACTERS", 1000)
    encoder = Encoder(default_path())
    for i in range(40):
        text = f"{i}" + "ab" * 300 + " end"
        assert list(encoder.encode([text])) == encoder._whole([text])
        assert sum(map(len, [*encoder.cache, *encoder.old])) < 5000


def test_pieces_and_packing(spark, docs):
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in [*enumerate(TEXTS), (None, "no id")]:
        ids = plain(text, 2)
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        if doc == 3:
            assert len(got) == 2 and all(r.length == len(ids) for r in got)  # a repeated row is packed twice
            continue
        assert [r.piece for r in got] == list(range(len(got)))
        assert b"".join(r.ids for r in got) == np.array(ids, dtype="<u4").tobytes()
        assert all(r.length == 1024 for r in got[1:]) and got[0].length <= 1024
        assert all(r.ids_crc32 == crc(ids[r.start:r.start + r.length]) for r in got)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 1024) + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack_documents(docs, keep_ids=True)).collect()}
    assert sum(map(len, whole.values())) == 4 * total


def test_plan_is_whole_and_tight():
    rng = random.Random(5)
    histogram = {rng.randint(1, 1024): rng.randint(1, 400) for _ in range(300)}
    runs = packing.plan_bins(histogram)
    used = {}
    for lengths, times in runs:
        assert sum(lengths) <= 1024 and times > 0
        for k in lengths:
            used[k] = used.get(k, 0) + times
    assert used == histogram
    least = max(-(-sum(k * n for k, n in histogram.items()) // 1024), sum(n for k, n in histogram.items() if k > 512))
    assert sum(t for _, t in runs) <= least * 1.02 + 1


def test_fullest_against_enumeration():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * c for s in sums for c in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(k) <= counts[k] for k in got)


def test_rans_files(spark, docs):
    path = shared_path(spark, "test-rans")
    rans.write(docs, path)
    got = rans.read(spark, path).orderBy("start").collect()
    expected = sorted([(None, "no id"), *enumerate(TEXTS), (3, "a")], key=lambda r: (-1 if r[0] is None else r[0]))
    at = 0
    for r, (doc, text) in zip(got, expected, strict=True):
        ids = plain(text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_rans_block_round_trip_and_checkpoints():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2047, 2048, 2049, 1_200_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int64)
        symbols, counts = np.unique(ids, return_counts=True)
        f = rans.Frequencies(symbols, counts)
        assert n == 0 or (int(f.freq.sum()) == 1 << rans.SCALE and f.freq.min() >= 1)
        if not n:
            continue
        block = rans.encode(ids, f)
        block["words_crc32"] = zlib.crc32(block["words"])
        assert (rans.decode(block, f, f.slots(), n) == ids).all()
        marks = len(block["checkpoints"]) // (16 + 8 * rans.LANES)
        for m in range(1, marks + 1):
            tail = rans.decode(block, f, f.slots(), n, checkpoint=m)
            assert (tail == ids[m * rans.CHECKPOINT_STEPS * rans.LANES:]).all()
        if block["words"]:
            block["words"] = bytes([block["words"][0] ^ 1]) + block["words"][1:]
            with pytest.raises(ValueError, match="checksum"):
                rans.decode(block, f, f.slots(), n)


def test_empty_tables(spark):
    ship(spark)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none).collect() == []
    path = shared_path(spark, "test-rans-empty")
    rans.write(none, path)
    assert rans.read(spark, path).collect() == []


def test_repeated_rows_are_dealt_over_the_salts(spark):
    """Equal rows (and null ids) of one length don't meet in one task, and each gets a place of its own."""
    items = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"),
                                              F.lit(100).alias("length"))
    ties = spark.range(0, 4000, 1, 4).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8)).alias("salt"))
    assert ties.groupBy("salt").count().agg(F.max("count")).first()[0] < 700
    rows = packing.pack(items).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4000
    assert len({r.sequence_id for r in rows}) == 400
