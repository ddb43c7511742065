"""Registered queries of the corpus operators; thin, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parcelsight.llm import (
    bpe, exact, extraction, langid, minhash, packing, pii, quality, secret_scan, spelling, vectors,
    warc, whitening)
from parcelsight.llm.shared import documents

WORD_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir, "doc_id", "text"),
                       public_tokenizers.path(BYTE_RANKS))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.decide(rows.select("vec_id", "label", "embedding"), least=0.93)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.decide(documents(spark, sf_dir, "doc_id", "text"), percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"),
                        public_tokenizers.path(WORD_TOKENIZER), with_ids=False,
                        cache_bytes=176 << 20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.score(docs, quality.train(docs, labels))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages.select("page_id", "url", "html"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir, "doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with exact.new_index(spark) as index:
        return exact.decide(documents(spark, sf_dir, "doc_id", "text"), index)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(rows.select("vec_id", "embedding"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extraction.extract(pages.select("page_id", "url", "html"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_byte_bpe, op3_vector_dedup, op4_minhash, op5_packing, op6_quality,
    op7_warc, op8_pii, op9_language_id, op10_exact_dedup, op11_whitening, op12_html_extraction,
    op13_spelling)}
