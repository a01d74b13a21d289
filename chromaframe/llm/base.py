"""Shared steps of the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.scale import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is; ASCII texts take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_finished(df: DataFrame) -> DataFrame:
    """The same rows; shuffle files and checkpoints that nothing refers to any more leave the disks now.

    Spark drops them when the driver's JVM collects its garbage, which a driver with room to spare seldom does by itself.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def join_small(df: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner",
               max_rows: int = 20_000, max_bytes: int = 32 << 20, salts: int = 32) -> DataFrame:
    """Join a side that is usually small, at any size and with any share of rows under one key.

    The side is checkpointed and measured. Within ``max_rows`` and ``max_bytes`` it is
    broadcast. Beyond them each of its rows is repeated ``salts`` times and ``spread``
    (a well-mixed row column) deals the rows of a hot key to as many tasks. Keys compare
    null-safely.
    """
    key = F.struct(*keys)
    side = cut_lineage(table.select(key.alias("__key"), *[c for c in table.columns if c not in keys]))
    size = side.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    left = df.withColumn("__key", key)
    if size["n"] <= max_rows and size["b"] <= max_bytes:
        return left.join(F.broadcast(side), "__key", how).drop("__key")
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, ["__key", "__salt"], how).drop("__key", "__salt")
