"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from ridestats.llm import bpe, content, jaccard, layouts, licenses, lines, lm, packer, phrases, quality, sql, topk, urls, variants, vectors
from ridestats.llm.common import file_of, table

def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).drop("removed")


# Host and path rules of the URL query.
URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = file_of("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return digests(encoded, ranks)


def digests(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Digest of the ids, and of the bytes that they decode to, in one pass over the ids."""
    keyed = encoded.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                    F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")).alias("key"), "ids")
    return bpe.decode(keyed, ranks, "key").select(
        "key.doc_id", "key.n_tokens", "key.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    weights = content.fit(layouts.labelled_layouts() + content.labelled_sample(pages))
    return content.extract(pages, weights)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packer.pack(packer.pieces(table(spark, sf_dir, "documents"), file_of("word_bpe_49k.json"), 2048), 2048)


LM_ORDER = 3


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    scored, model = lm.fit_and_score(table(spark, sf_dir, "documents"), remainder != 2, LM_ORDER)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, words=5, top=2000)


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_url_filter": op2_url_filter,
        "op3_embedding_near_dedup": op3_embedding_near_dedup,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_html_extraction": op6_html_extraction,
        "op7_license_scan": op7_license_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_lm_score": op10_lm_score,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_phrase_mining": op12_phrase_mining,
        "op13_topk_search": op13_topk_search,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": sql.LINES,
        "op2_url_filter": urls.urls_sql(URL_RULES),
        "op3_embedding_near_dedup": sql.VECTORS,
        "op4_jaccard_join": sql.JACCARD,
        "op7_license_scan": sql.LICENSES,
        "op8_quality_rules": sql.QUALITY,
        "op11_spelling_variants": sql.VARIANTS,
        "op12_phrase_mining": sql.PHRASES,
        "op13_topk_search": sql.TOP_PRODUCTS,
    }
