"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import (decontaminate, hnsw, line_dedup, merkle, near_dup, packing, pii, quality, rans, sharding, toxicity,
               warc, whitening)
from .common import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


QUERIES = {name: _shipped(query) for name, query in {
    "op1_line_dedup": line_dedup.query,
    "op2_best_fit_packing": packing.query,
    "op3_rans_output": rans.query,
    "op4_pii": pii.query,
    "op5_compression_quality": quality.query,
    "op6_hnsw": hnsw.query,
    "op7_toxicity": toxicity.query,
    "op8_min_max_near_dup": near_dup.query,
    "op9_decontamination": decontaminate.query,
    "op10_sharding": sharding.query,
    "op11_merkle_manifest": merkle.query,
    "op12_zip_warc": warc.query,
    "op13_whitening": whitening.query,
}.items()}

ORACLE = {"op8_min_max_near_dup": near_dup.SQL, "op9_decontamination": decontaminate.SQL,
          "op11_merkle_manifest": merkle.SQL, "op12_zip_warc": warc.SQL}
