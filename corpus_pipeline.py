"""The corpus pipeline: documents of known language, deduplicated, without secrets, packed.

Each stage takes (spark, docs, sf_dir) and gives the next one its documents; the last one gives
sequences for training. All stages take rows with null ids or texts, empty and very long texts,
repeated rows, columns of any further name, and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.llm import exact, langid, minhash, packing, secret_scan
from parcelsight.llm.shared import written

TOKENIZER = "word_bpe_49k.json"
#: Of the packing, whose workers share an executor with what the stages before it left in its heap.
CACHE_BYTES = 24 << 20
SLICE_CHARS = 1 << 18


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rest goes.

    Null and empty texts, those without a letter, and all where no document has a language to
    learn from have none. Repeated rows are decided alike.
    """
    return langid.keep_identified(docs, langid.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    That of the longest text and then the smallest id stays, a null id last; null texts are empty
    ones, and a row repeated with its id and text stays once.
    """
    with exact.new_index(spark) as index:
        return exact.keep_first(docs, index)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at a similarity of 0.8.

    That of the smallest id stays; rows with a null id or a text without words stay. Rows with one
    id and several texts are decided by their own text.
    """
    return minhash.keep_one(docs, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their length counted again.

    Null texts stay null, with the length they came with; a table without ``n_chars`` gets none.
    """
    clean = secret_scan.masked(docs, secret_scan.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(
        F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of powers of two ids, none of which crosses documents.

    Null and empty texts are one id, their end; repeated rows are packed each.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), cache_bytes=CACHE_BYTES,
                        slice_chars=SLICE_CHARS)


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("minhash", minhash_dedup),
    ("secret_scan", secrets), ("packing", pack)]

#: Learned models and a tokenizer: no SQL says what they keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
