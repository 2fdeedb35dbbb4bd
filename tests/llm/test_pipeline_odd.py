"""The pipeline's stages on odd rows, clashing columns and empty tables; op1's tree on the registered query."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemo.llm import queries

CLASH = ("_hash", "_id", "_nth", "_row", "_of", "_own", "_rest", "_text", "_key", "_block", "size", "fp", "key", "set", "text_id", "component", "bands", "taken", "shard", "e", "kind", "_secret", "n")


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_take_clashing_columns_odd_and_empty_tables(spark, odd, rows, tmp_path):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), *[F.lit("mine").alias(c) for c in CLASH])
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("mine").alias(c) for c in CLASH])
    docs = docs.limit(0) if rows == "empty" else docs.unionByName(real)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where(" or ".join(f"`{c}` <> 'mine'" for c in CLASH)).count() == 0
    assert (docs.count() == 0) == (rows == "empty")


def test_the_registered_mix_has_several_shards(spark):
    rows = queries.op1_mix_sources(spark, "/root/testdata/sf0.01").collect()
    shards = {s for r in rows for s in r.shards.split(",") if s}
    assert len(shards) >= 4
    for source in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == source) - source * len({r.source_size for r in rows if r.target == source})) <= len({r.source_size for r in rows if r.target == source})
    again = {(r.doc_id, r.taken, r.shards) for r in queries.op1_mix_sources(spark, "/root/testdata/sf0.01").collect()}
    assert again == {(r.doc_id, r.taken, r.shards) for r in rows}
