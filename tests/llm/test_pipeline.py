import os

import pytest

import corpus_pipeline
from mnemo.llm import pieces, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            kept = simhash.near_duplicates(docs)
            assert kept.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] and docs.where("not round_trip").count() == 0
    texts = spark.read.parquet(f"{tmp_path}/3")
    want = sorted(tuple(r.ids) for r in pieces.encoded(texts.select("doc_id", "text")).collect())
    assert sorted(tuple(r.ids) for r in docs.collect()) == want
