"""The queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import licenses, media, mixing, pieces, pii, quality, ranking, repeats, sharding, simhash, tokens, urls, whitening
from mnemo.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), with_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


_ALL = (op1_mix_sources, op2_sentencepiece, op3_token_counts, op4_quality_rules, op5_simhash, op6_license_scan, op7_repeated_passages, op8_media_columns, op9_pii_surrogates, op10_url_filters, op11_embedding_whitening, op12_lexical_search, op13_sharding)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op12_lexical_search": ranking.ORACLE}
