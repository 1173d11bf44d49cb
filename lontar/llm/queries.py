"""The numbered queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import anisotropic, bit_sliced, divergence, fill_middle, jaccard_join, language_spans, license_scan, mixture, page_text, sentencepiece_codec, substring_dedup, token_counts, url_cascade

#: Model of the SentencePiece query, in the folder of public tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"
#: Tokenizer of the token counts, in the same folder, and the number of tokens that a text should not go beyond.
WORD_TOKENIZER, TOKEN_LIMIT = "word_bpe_49k.json", 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model_path() -> str:
    return tokenizer_path(PIECE_MODEL)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op2_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_products(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op3_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, sf_dir, "documents"), piece_model_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("factors")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_spans.held_out(F.col("doc_id"))
    model = language_spans.train(docs.where(~held))
    return language_spans.identify(docs, model).select("doc_id", language_spans.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixture.mix(docs, **mixture.PRODUCTION).select("row.doc_id", "at.domain", "at.lang", "at.source", "n_tokens", "copies")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_main_text(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform_digests(table(spark, sf_dir, "documents"), rate=50, spm_rate=80, seed=42)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), TOKEN_LIMIT)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least_documents=3, top_terms=200)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_bit_sliced_topk": op2_bit_sliced_topk,
    "op3_anisotropic_ann": op3_anisotropic_ann,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_mixture": op8_mixture,
    "op9_html_text": op9_html_text,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_source_divergence": op13_source_divergence,
}
