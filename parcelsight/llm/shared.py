"""Helpers the corpus operators have in common: written tables, folds, fresh column names."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none gets a temporary one, removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return root.rstrip("/")


@functools.cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="corpus-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own in the shared one, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe when executors go."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Only the named columns of ``documents``; further columns never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no classifier learns from (a null id: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: Bits of the filter of ``maybe_in``; so its broadcast takes 16 MB at most, whatever the input.
FILTER_BITS = 1 << 27
_BYTES = 4096  # of a row of the filter, as Spark's bitmap functions make it


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, id_column: str, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: true wherever the key is among ``ids``, and seldom else.

    A bitmap of hashed ids, of fixed size, is broadcast. With very many ids it fills and flags
    all rows, so it may only save work, never decide.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = written(
        ids.select(place(id_column).alias("h")).groupBy(
            F.bitmap_bucket_number("h").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")), "filter")
    at, bucket, bitmap = (fresh(rows, c) for c in ("filter_at", "filter_bucket", "filter_bits"))
    bits = bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(bitmap))
    position = F.bitmap_bit_position(F.col(at))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (position / 8).cast("int") + 1, F.lit(1))),
                  16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0
    return (
        rows.withColumn(at, place(key))
        .join(F.broadcast(bits), F.bitmap_bucket_number(F.col(at)) == F.col(bucket), "left")
        .withColumn(flag, F.coalesce(hit, F.lit(False))).drop(at, bucket, bitmap))


def likely(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose key may be among ``ids``: so wide rows without a partner aren't shuffled."""
    flag = fresh(rows, "likely")
    return maybe_in(rows, key, ids, id_column, flag).where(flag).drop(flag)


_HELD: dict = {}


def held(key: tuple, make: Callable):
    """What ``make`` returns, kept by this Python worker until it is asked for something else.

    Workers go on from stage to stage; so they hold the memory of one operator at a time.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what earlier operators hold in this Python worker."""
    _HELD.clear()


#: Bytes of a batch that Python workers get at once; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches be bounded by bytes and not only by rows: texts may be very long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).lower().rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
