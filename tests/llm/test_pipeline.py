"""The pipeline's stages: each works on all its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tracelode.llm import decontaminate, pii, quality, simhash
from tracelode.llm.common import staged

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    columns, before = docs.columns, docs
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, DATA), name)
        after.append(docs)
        if len(after) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns and docs.dtypes == before.dtypes
    good, single, clean, redacted, encoded = after
    kept = {r["doc_id"] for r in quality.quality(before, labels=spark.read.parquet(f"{DATA}/labels.parquet")).collect() if r["kept"]}
    assert {r["doc_id"] for r in good.collect()} == kept and kept
    heads = {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    assert {r["doc_id"] for r in single.collect()} == heads and len(heads) < len(kept)
    assert decontaminate.contamination(single, benchmark).where("n_hit > 0").count()
    assert not decontaminate.contamination(clean, benchmark).where("n_hit > 0").count()
    untouched = dict(single.join(decontaminate.contamination(single, benchmark).where("n_hit = 0"), "doc_id", "left_semi").select("doc_id", "text").collect())
    texts = dict(clean.select("doc_id", "text").collect())
    assert all(texts[i] == t for i, t in untouched.items())
    assert pii.find(clean).where("n_email + n_ip + n_card + n_phone > 0").count()
    assert not pii.find(redacted).where("n_email + n_ip + n_card + n_phone > 0").count()
    final = dict(redacted.select("doc_id", "text").collect())
    rows = encoded.collect()
    assert {r["doc_id"] for r in rows} == final.keys() == texts.keys()
    assert all(r["lossless"] and r["decoded_sha256"] == hashlib.sha256(final[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_token_ids_say_what_was_verified(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{k} other{k}" for k in range(900))), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_verified"], r["n_mismatched"]) for r in corpus_pipeline.token_ids(spark, docs, DATA).collect()}
    assert found[1][0] > 0 and found[1][1] == 0 and found[2] == (0, None)
