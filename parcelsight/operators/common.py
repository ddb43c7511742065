"""Small building blocks shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_whole(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Add ``_whole``, a struct of aggregates over the whole frame, as a scalar subquery.

    Hashing every column keeps the subquery's column set equal to the frame's own, so both
    read the same shuffle and the input is scanned once. No cross join, no one-task window.
    """
    same_columns = F.max(F.xxhash64(*df.columns)).alias("_same")
    whole = df.agg(F.struct(same_columns, *[c.alias(k) for k, c in aggregates.items()])
                   .alias("_whole"))
    return df.withColumn("_whole", whole.scalar())


def attach_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add the single row of ``row`` as one struct column."""
    packed = row.select(F.struct(*[F.col(c) for c in row.columns]).alias(name))
    return df.withColumn(name, packed.scalar())


#: Bits of the filter of `maybe_in`: its broadcast takes 16 MB at most, whatever the input.
FILTER_BITS = 1 << 27


def maybe_in(rows: DataFrame, key: Column, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: true wherever the key is an ``id`` of ``ids``, and seldom else.

    A bitmap of hashed ids, of fixed size, is broadcast. With very many ids it fills and flags all rows,
    so it may only save work, never decide.
    """
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    bits = ids.select(place(F.col("id")).alias("_h")).groupBy(
        F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    position = F.bitmap_bit_position(F.col("_at"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    hit = byte.cast("int").bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0
    return rows.withColumn("_at", place(key)).join(
        F.broadcast(bits), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left").withColumn(
        flag, F.coalesce(hit, F.lit(False))).drop("_at", "_bucket", "_bits")


def spread_blank(key: Column, salt: Column) -> Column:
    """Join key whose blank values are spread over many values that match nothing.

    A third of all rows may lack the key; left alone they would meet in one task.
    """
    spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(salt), F.lit(8192)).cast("string"))
    return F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(spread)
