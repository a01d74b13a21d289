"""A table of latest rows as a log of small commits, merged on read and compacted by size."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Latest = Callable[[DataFrame], DataFrame]


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)


def commits(spark: SparkSession, path: str) -> list[int]:
    """Committed batch numbers that are still kept, in order."""
    names = [n for n in _children(spark, f"{path}/manifest") if n.isdigit()]
    return sorted(int(n) for n in names if _exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def manifest(spark: SparkSession, path: str, number: int) -> list:
    """The parts of a commit (name, rows), oldest first: a base and the deltas after it."""
    return spark.read.parquet(f"{path}/manifest/{number}").orderBy("nth").collect()


def _merged(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{n}") for n in names])


def append_latest(batch: DataFrame, path: str, number: int, latest: Latest, key: str = "page_id", buckets: int = 16, fan: int = 8) -> None:
    """Commit one batch: its own latest rows become a delta, in ``buckets`` by a hash of ``key``.

    ``latest`` reduces rows to one per key and may be applied again to its own results. What is
    written follows the keys of the batch. ``fan`` deltas are merged into one; once they hold
    half as many rows as the base, everything becomes a new base, so a row is rewritten a number of times that grows with the
    logarithm of the table. The manifest is written last and is the commit. A batch that is
    run again starts from the commit before it and writes the same parts, and parts that neither
    this commit nor the one before names are removed.
    """
    spark = batch.sparkSession
    earlier = [n for n in commits(spark, path) if n < number]
    parts = [(r["name"], r["rows"]) for r in manifest(spark, path, earlier[-1])] if earlier else []

    def write(rows: DataFrame, name: str) -> tuple[str, int]:
        placed = rows.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        return (name, spark.read.schema(placed.schema).parquet(f"{path}/{name}").count())
    delta = write(latest(batch), f"delta-{number}")
    if delta[1]:
        parts = [*parts, delta]
    base = [p for p in parts if p[0].startswith("base-")]
    deltas = [p for p in parts if not p[0].startswith("base-")]
    if len(deltas) >= fan:
        whole = 2 * sum(n for _, n in deltas) >= sum(n for _, n in base)
        old = parts if whole else deltas
        new = write(latest(_merged(spark, path, [n for n, _ in old]).drop("bucket")), f"{'base' if whole else 'merged'}-{number}")
        parts = [new] if whole else [*base, new]
    listed = [(i, n, r) for i, (n, r) in enumerate(parts)]
    spark.createDataFrame(listed, "nth int, name string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
    kept = {n for n, _ in parts} | ({r["name"] for r in manifest(spark, path, earlier[-1])} if earlier else set())
    for n in earlier[:-1]:
        _remove(spark, f"{path}/manifest/{n}")
    for name in _children(spark, path):
        if name != "manifest" and name not in kept:
            _remove(spark, f"{path}/{name}")


def read_latest(spark: SparkSession, path: str, latest: Latest, number: int | None = None) -> DataFrame:
    """The table after a commit (the last one, by default). Spark prunes buckets and columns of every part."""
    known = commits(spark, path)
    parts = [r["name"] for r in manifest(spark, path, known[-1] if number is None else number)] if known else []
    if not parts:
        raise ValueError(f"no rows are committed in {path}")
    return latest(_merged(spark, path, parts).drop("bucket"))
