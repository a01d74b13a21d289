"""Building blocks that keep a plan sound when one key holds a large share of the rows."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 32 << 20


def measured_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; otherwise leave ``df`` alone.

    Meant for library-like sides (profiles, presets, weights). The measure is one
    aggregate; a side above the bound is joined by Spark's shuffle join instead.
    """
    row = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    if row["rows"] <= max_rows and row["bytes"] <= max_bytes:
        return F.broadcast(df)
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if sc.master.split("[")[0] != "local":  # "local-cluster" has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="chromaframe-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive a lost executor and the plan stays short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column,
                rank: str = "rank", total: str | None = None) -> DataFrame:
    """Exact 1-based position of each row inside its key, without one task per key.

    ``bucket`` must grow with ``order``. Rows are ranked inside (key, bucket) and
    shifted by the count of earlier buckets, so only bucket counts meet per key.
    """
    # Structs compare null-safely, and one pair of columns serves window and join alike,
    # so the rows are shuffled once.
    tagged = df.withColumns({"__key": F.struct(*keys), "__bucket": F.struct(bucket.alias("b"))})
    counts = tagged.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__key", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                            F.sum("__n").over(W.partitionBy("__key")).alias("__total"))
    inside = W.partitionBy("__key", "__bucket").orderBy(*order)
    out = (tagged.withColumn("__pos", F.row_number().over(inside))
           .join(offsets, ["__key", "__bucket"])
           .withColumn(rank, (F.col("__before") + F.col("__pos")).cast("long")))
    if total:
        out = out.withColumn(total, F.col("__total").cast("long"))
    return out.drop("__key", "__bucket", "__pos", "__before", "__total")


def sum_before(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key that come before, without one task per key.

    As ``rank_within``: rows are summed inside (key, bucket) and shifted by the sums of earlier buckets.
    """
    tagged = df.withColumns({"__key": F.struct(*keys), "__bucket": F.struct(bucket.alias("b")), "__v": value.cast("long")})
    sums = tagged.groupBy("__key", "__bucket").agg(F.sum("__v").alias("__s"))
    before = W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__key", "__bucket", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__key", "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = tagged.withColumn("__own", F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(offsets, ["__key", "__bucket"])
    return out.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__key", "__bucket", "__v", "__before", "__own")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1,
                    rank: str | None = None) -> DataFrame:
    """Top ``n`` rows per key; Spark prunes to ``n`` per key before the shuffle."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    out = out.where(F.col(name) <= n)
    return out if rank else out.drop(name)


def cover_cells(df: DataFrame, x: Column, y: Column, w: Column, h: Column, size: float) -> DataFrame:
    """One row per grid cell that the closed box [x, x+w] x [y, y+h] touches."""
    def span(lo, hi):
        return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return (df.withColumn("__cx", F.explode(span(x, x + w)))
              .withColumn("__cy", F.explode(span(y, y + h))))


def point_cell(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    return df.withColumns({"__cx": F.floor(x / size).cast("long"),
                           "__cy": F.floor(y / size).cast("long")})


def join_library(df: DataFrame, library: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner",
                 salts: int = 32) -> DataFrame:
    """Join rows to their (small) library by ``keys``, whatever share of rows one key holds.

    A library within the measured bound is broadcast. A larger one is repeated per
    salt and ``spread`` (any well-mixed row column) sends each row to one of them.
    Without keys every row meets the whole library, by salt.
    """
    hinted = measured_broadcast(library)
    if hinted is not library:
        if keys:
            return df.join(hinted, list(keys), how)
        salts = 1  # one copy is sent, not one per salt
    copies = hinted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def id_blocks(library: DataFrame, keys: Sequence[str], id_col: str, fields: Sequence[Column],
              size: int = 64) -> tuple[DataFrame, int]:
    """Pack library rows into arrays of at most ``size`` ids; also the most blocks a key has."""
    packed = (library.withColumn("__block", F.floor(F.col(id_col) / size))
              .groupBy(*keys, "__block")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(id_col), *fields))).alias("block")))
    top = packed.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return packed.drop("__block"), int(top or 0)
