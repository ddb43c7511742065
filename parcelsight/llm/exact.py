"""Exact deduplication against a persistent digest index, with DataFrame functions only.

The index is a table bucketed and sorted by digest. A batch is first reduced to one row per
digest, so neither side of the sort-merge anti-join against the index holds a key twice; digests
the index lacks are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelsight.llm.shared import fresh, maybe_in, remove_folder, shared_root, written

#: Characters that don't count when texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
INDEX_COLUMNS = "digest string, keep_id bigint, code_points bigint, batch string"


def digest_of(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without its blanks (null: empty), in UTF-8."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, each with the document that stays for it.

    A batch has an id that its rows are appended under, after all it returns has been written. A
    batch that is given again, since its first run was lost at whatever point, finds the same: rows
    under its own id don't count as known, and none is appended twice.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        """``name``: a table; it is made, bucketed by digest, where it doesn't exist yet."""
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], INDEX_COLUMNS))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame) -> None:
        (rows.write.format("parquet").mode("append")
         .option("path", f"{shared_root(self.spark)}/{self.name}")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def stays(self, firsts: DataFrame, batch: str) -> DataFrame:
        """``firsts`` with the documents that stay; nothing is appended.

        ``firsts`` holds a digest once at most, with keep_id, code_points and any further
        columns. A digest known from an earlier batch (``known``) keeps its earlier document,
        even if the new text is longer.
        """
        earlier = self.table().where(F.col("batch") != batch).hint("merge").select(
            "digest", F.col("keep_id").alias("earlier_id"), F.lit(True).alias("known"))
        return firsts.join(earlier, "digest", "left").select(
            *[c for c in firsts.columns if c != "keep_id"],
            F.when(F.col("known"), F.col("earlier_id")).otherwise(F.col("keep_id")).alias(
                "keep_id"), F.coalesce("known", F.lit(False)).alias("known"))

    def add(self, firsts: DataFrame, batch: str) -> None:
        """Append the digests that no batch has appended yet: sort-merge anti-join."""
        new = firsts.join(self.table().hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", "keep_id", "code_points", F.lit(batch).alias("batch"))
                     .repartition(self.buckets, "digest"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_folder(self.spark, f"{shared_root(self.spark)}/{self.name}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def new_index(spark: SparkSession) -> DigestIndex:
    """An index for one batch alone; used in a ``with`` block it is dropped at its end."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")


def decide(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text",
           batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``batch`` names the batch in the index; a run that may be repeated must give its own name.

    Null texts are empty ones. Of equal texts the row with the most code points stays, then the
    smallest id (null ids last), unless an earlier batch holds the text. ``group_size`` counts
    the batch's rows. A row repeated with the same id counts each time, and one of them stays.
    No rows: no rows. Further columns are left out.
    """
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias("digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("code_points"),
    ).withColumn("row", F.monotonically_increasing_id()), "digests")
    order = F.struct((-F.col("code_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"),
                     F.col("doc_id").alias("id"), F.col("row").alias("row"))
    firsts = written(rows.groupBy("digest").agg(
        F.min(order).alias("first"), F.count("*").alias("group_size")).select(
        "digest", F.col("first.id").alias("keep_id"), (-F.col("first.n")).alias("code_points"),
        F.col("first.row").alias("keep_row"), "group_size"), "firsts")
    batch = batch or uuid.uuid4().hex
    stays = written(index.stays(firsts, batch), "stays")
    index.add(firsts, batch)  # the last step: all that is returned has been written
    # both sides are plain scans: a digest with very many rows is a skewed join, which is split
    return rows.join(stays, "digest").select(
        "doc_id", "keep_id", "group_size",
        (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text",
               batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row repeated with the same id and text is returned once.
    """
    key, kid, flag = (fresh(docs, c) for c in ("digest_key", "digest_id", "crowded"))
    decided = written(decide(docs, index, doc_id, text, batch), "decided")
    crowded = decided.where("group_size > 1 OR NOT kept").select("text_sha256").distinct()
    winners = decided.where("kept").select(
        F.col("text_sha256").alias(key), F.col("doc_id").alias(kid))
    # texts that occur once stay without a shuffle
    tagged = maybe_in(docs.withColumn(key, digest_of(F.col(text))), key, crowded, "text_sha256",
                      flag)
    shared = tagged.where(flag)
    same = (shared[key] == winners[key]) & shared[doc_id].eqNullSafe(winners[kid])
    chosen = shared.join(winners, same, "left_semi").dropDuplicates([doc_id, key])
    return tagged.where(~F.col(flag)).unionByName(chosen).select(*docs.columns)
