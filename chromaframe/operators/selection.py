"""Exact percentiles of many-valued numbers without a value map per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.scale import cut_lineage

#: Groups up to this size use Spark's exact percentile, whose buffer is then bounded.
SMALL_GROUP = 10_000
#: Bins of a pass over a larger group.
BINS = 4096


def _exponent(c: str) -> Column:
    """Grows with a double as its bits do: the signed binary logarithm, moved so that it is positive for every positive double."""
    v = F.col(c)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "percentile",
                     small: int = SMALL_GROUP, bins: int = BINS) -> DataFrame:
    """``keys`` and the exact ``p``-quantile (0..1, linear between neighbours) of ``value``; null and NaN do not count.

    In a group of more than ``small`` rows, the two rows around the quantile are found by histograms: a pass counts the
    values of an interval in ``bins`` bins, and the bin with the wanted rank is the next interval, until
    all its values are equal. A pass sends at most ``bins`` counts per group, task and rank, so a group may
    hold any share of the rows. Bins part exponents first and then the 52 bits below them, so six passes settle any doubles.
    """
    keys = list(keys)
    if not 0 <= p <= 1:
        raise ValueError("p is between 0 and 1")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.struct(*keys).alias("__key"), F.col(value).cast("double").alias("__v"))
    sizes = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    large = cut_lineage(sizes.where(F.col("n") > small))
    plain = rows.join(large.select("__key"), "__key", "left_anti").groupBy("__key").agg(F.expr(f"percentile(__v, {p!r})").alias(name))
    at = F.col("n").cast("double") * 1.0 - 1
    wanted = large.select("__key", "n", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor(at * p), F.ceil(at * p)))).alias("rank"))
    open_ = cut_lineage(wanted.select("__key", "rank", "lo", "hi", F.lit(0).cast("long").alias("below")))
    done = open_.where("lo = hi")
    open_ = open_.where("lo < hi")
    while not open_.isEmpty():
        inside = rows.join(open_, "__key").where(F.col("__v").between(F.col("lo"), F.col("hi")))
        # Over several powers of two, bins are even in the exponent (a monotone key); below that in the value.
        wide = _exponent("hi") - _exponent("lo") > 2
        share = F.when(wide, (_exponent("__v") - _exponent("lo")) / (_exponent("hi") - _exponent("lo"))).otherwise(
            (F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        middle = F.least(F.greatest(F.floor(F.nanvl(share, F.lit(0.5)) * bins), F.lit(0)), F.lit(bins - 1))  # an end may be infinite
        at_bin = F.when(F.col("__v") == F.col("lo"), F.lit(0)).when(F.col("__v") == F.col("hi"), F.lit(bins - 1)).otherwise(middle).cast("long")
        counts = inside.groupBy("__key", "rank", "below", at_bin.alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        order = W.partitionBy("__key", "rank").orderBy("bin")  # at most ``bins`` rows
        before = F.col("below") + F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        step = cut_lineage(found.select("__key", "rank", "lo", "hi", F.col("before").alias("below")))
        done, open_ = done.unionByName(step.where("lo = hi")), step.where("lo < hi")
    around = done.join(large.select("__key", "n"), "__key").groupBy("__key", "n").agg(F.min_by("lo", "rank").alias("a"), F.max_by("lo", "rank").alias("b"))
    part = at * p - F.floor(at * p)
    exact = around.select("__key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias(name))
    return plain.unionByName(exact).select("__key.*", name)
