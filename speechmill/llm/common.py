"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and no lineage to lose."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """The low ``bits`` bits of a long key as a set, in at most ``2 ** (bits - 6)`` rows.

    The size is bounded whatever the number of keys, so the set may be broadcast. It has false
    positives, never false negatives; a full set only filters less.
    """
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    return (
        keys.select(slot.alias("_slot"))
        .select(F.shiftright("_slot", 6).alias("_word"), F.expr("shiftleft(1L, cast(_slot & 63 as int))").alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_mask"))
    )


def possibly_in(df: DataFrame, key: str, keys: DataFrame, bits: int, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be in the bitmap (or, with ``keep=False``, surely is not)."""
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    hit = F.expr(f"coalesce(_mask, 0L) & shiftleft(1L, cast({key} & 63 as int))") != 0
    joined = df.withColumn("_word", F.shiftright(slot, 6)).join(F.broadcast(keys), "_word", "inner" if keep else "left")
    return joined.filter(hit if keep else ~hit).drop("_word", "_mask")

