"""Each stage of the pipeline on hard rows, and the whole of it against its stages."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog went to the old house by the river with all of their friends and "
ROWS = [
    (1, EN * 3 + "stayed", "en"), (2, (EN * 3 + "stayed").replace(" ", "  "), "en"),
    (3, EN * 3 + "stayed there", "en"), (4, None, "en"), (5, "", None), (6, "12 !!", None),
    (7, EN + "password=hunter2hunter2 x", "en"), (7, "another text under the same number of the house", "en"),
    (8, "un chat et le chien sont dans la maison avec les amis de la rue " * 4, "fr"),
    (8, "un chat et le chien sont dans la maison avec les amis de la rue " * 4, "fr"),
    (None, "the row without any number is a text as well and it is kept", "en"), (9, EN * 3000, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "web", None if t is None else len(t)) for i, t, lang in ROWS * 1]
    rows += [(100 + k, f"{EN} number {k} is a {'the of and ' * (k % 5)} text", "en", "web", 1) for k in range(40)]
    rows += [(200 + k, f"le chien {k} est dans la rue avec des amis et une {'maison ' * (k % 4)}", "fr", "web", 1)
             for k in range(40)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("found", F.lit(1)).withColumn(
        "digest_key", F.lit("x")).repartition(4)


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.collect())


def test_language_id(spark, docs):
    kept = pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {4, 5, 6}
    assert pipeline.language_id(spark, docs.limit(0), "").count() == 0


def test_exact_dedup(spark, docs):
    kept = pipeline.exact_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and 2 in ids and ids.count(8) == 1 and ids.count(7) == 2
    assert ids.count(4) + ids.count(5) == 1 and ids.count(None) == 1
    assert pipeline.exact_dedup(spark, docs.limit(0), "").count() == 0


def test_minhash(spark, docs):
    hard = docs.where("doc_id < 100 OR doc_id IS NULL")
    kept = pipeline.minhash_dedup(spark, hard, "")
    assert kept.columns == docs.columns
    assert texts(kept) == texts(hard.where("doc_id NOT IN (2, 3, 9) OR doc_id IS NULL"))
    assert pipeline.minhash_dedup(spark, docs.limit(0), "").count() == 0


def test_secrets(spark, docs):
    before = {(r.doc_id, r.text) for r in docs.collect()}
    got = pipeline.secrets(spark, docs, "")
    assert got.columns == docs.columns and got.count() == docs.count()
    changed = [r for r in got.collect() if (r.doc_id, r.text) not in before]
    assert [(r.doc_id, r.text, r.n_chars) for r in changed] == [
        (7, EN + "[SECRET] x", len(EN) + len("[SECRET] x"))]
    assert pipeline.secrets(spark, docs.drop("n_chars"), "").columns == docs.drop("n_chars").columns
    assert pipeline.secrets(spark, docs.limit(0), "").count() == 0


def test_pack(spark, docs):
    got = pipeline.pack(spark, docs, "").toPandas()
    assert (got["length"] & (got["length"] - 1) == 0).all() and (got["offset"] == 0).all()
    assert got["sequence_id"].is_unique and (got["ids"].map(len) == got["length"]).all()
    once = got[got["doc_id"].isin([1, 3, 9, 200])].groupby("doc_id").agg({"length": "sum", "doc_tokens": "max"})
    assert (once["length"] == once["doc_tokens"]).all()
    assert pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_run(spark, folder):
    """The whole pipeline keeps what its stages keep, one after another, and packs every id of it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, folder), "stage")
    got = pipeline.run(spark, folder)
    want = pipeline.pack(spark, docs, folder)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert got.select("doc_id").distinct().count() == docs.count() < spark.read.parquet(
        f"{folder}/documents.parquet").count()
