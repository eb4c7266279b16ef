"""The pipeline's stages: columns, effects, and its run against the same steps done by hand."""

import shutil

import corpus_pipeline
from riskroll.llm import catalog, near_dup
from riskroll.llm.common import ship

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    ship(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == columns and after.schema.simpleString() == docs.schema.simpleString()
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            assert len(kept) == docs.count()
        raw = spark.read.parquet(f"{SMALL}/documents.parquet")
        if name != "line_dedup":  # on its own, each of the others drops some of the raw documents
            assert stage(spark, raw, SMALL).count() < before
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert 0 < docs.count() < before
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_documents(spark, tmp_path):
    ship(spark)
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))


def test_near_dup_stage_takes_similarity_of_80_percent(spark):
    ship(spark)
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    others = {1: words, 2: words[:40] + ["x"] + words[41:60] + ["y"] + words[61:],
              3: words[:20] + ["u"] + words[21:70] + ["v"] + words[71:80] + ["t"] + words[81:]}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in others.items()}
    of = {i: len(sets[1] & sets[i]) / len(sets[1] | sets[i]) for i in (2, 3)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in others.items()], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dup"]
    assert 0.80 <= of[2] < 0.85 and of[3] < 0.80
    assert sorted(r.doc_id for r in stage(spark, df, SMALL).collect()) == [1, 3]
    assert near_dup.keep_first(df).count() == 3  # op8's 85
