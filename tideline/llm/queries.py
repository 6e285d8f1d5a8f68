"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import oracles
from tideline.llm.align import align_tokenizers
from tideline.llm.ann import nearest_neighbours
from tideline.llm.bpe import encode_decode
from tideline.llm.decontaminate import find_items
from tideline.llm.lang_id import identify
from tideline.llm.license_scan import scan_licenses
from tideline.llm.line_dedup import dedup_lines
from tideline.llm.minhash_forest import near_duplicates
from tideline.llm.ngram_join import join_components
from tideline.llm.prefix_trie import conversation_trie
from tideline.llm.quality import score_quality
from tideline.llm.shard import hash_tree_shards
from tideline.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), byte_bpe_path(), with_ids=False)


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_chunks").alias("n_chunks"), F.col("_removed").alias("n_removed"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree_shards(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(_table(spark, sf_dir, "documents")).drop("row")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"), every=20)


def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_segment_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), byte_bpe_path(), piece_bpe_path(), with_groups=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scan, op2_language_id, op3_decontaminate, op4_url_trust, op5_bpe_codec, op6_line_chunks, op7_multi_index, op8_hash_tree_shards, op9_ngram_jaccard, op10_quality, op11_prefix_trie, op12_minhash_forest, op13_segment_align]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others hold learnt scores, iterated graphs, chunks or digests of BPE: see tests/llm. That of op7 is for tables that its queries open whole."""
    return {"op1_license_scan": oracles.LICENSES, "op3_decontaminate": oracles.DECONTAMINATE, "op7_multi_index": oracles.NEIGHBOURS, "op8_hash_tree_shards": oracles.SHARDS, "op9_ngram_jaccard": oracles.JACCARD, "op11_prefix_trie": oracles.TRIE, "op12_minhash_forest": oracles.NEAR}
