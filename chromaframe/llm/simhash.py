"""Near-duplicate style descriptions by SimHash, joined through pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromaframe.llm.base import text_of
from chromaframe.operators.graph import connected_components
from chromaframe.scale import cut_lineage

SHINGLE = 3
RADIUS = 2
DIRECT = 64
#: Reference fingerprints: the empty one and one for each pair of adjacent bits.
PAIR_PIVOTS = tuple(3 << (2 * j) for j in range(32))
#: Pair pivots in five groups; two changed bits leave three groups as they are.
PIVOT_GROUPS = (range(0, 7), range(7, 14), range(14, 20), range(20, 26), range(26, 32))
#: Bits in twelve groups; two changed bits leave ten groups as they are.
BIT_GROUPS = tuple(sum(1 << b for b in range(i, 64, 12)) for i in range(12))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _far_pivots(n: int = 8) -> list[int]:
    """Well-spread reference fingerprints from a fixed linear sequence."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x ^ (x >> 29))
    return out


FAR_PIVOTS = tuple(_far_pivots())


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of a text's word shingles, repeats included; no word gives zero."""
    import xxhash

    def one(text: str | None) -> int:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return 0
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else (b" ".join(words),)
        n = max(1, len(words) - SHINGLE + 1)
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 14):
            part = h[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])
    return pd.Series([one(t) for t in texts], dtype="int64")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _ones(c: Column) -> Column:
    return F.bit_count(c)


def _differ(a: str, b: str) -> Column:
    return _ones(F.col(a).bitwiseXOR(F.col(b)))


def pivot_table(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """``fp``, its distances to the reference fingerprints (``near``) and to eight more, packed (``far``)."""
    refs = F.array(*[F.lit(_signed(p)) for p in (0, *PAIR_PIVOTS)])
    near = F.transform(refs, lambda p: _ones(F.col(fp).bitwiseXOR(p)).cast("int"))
    far = F.lit(0).cast("long")
    for i, p in enumerate(FAR_PIVOTS):
        far = far.bitwiseOR(F.shiftleft(_ones(F.col(fp).bitwiseXOR(F.lit(_signed(p)))).cast("long"), 7 * i))
    return prints.select(fp, near.alias("near"), far.alias("far"))


def _far_gap(a: str, b: str) -> Column:
    """Largest difference of two rows' distances to the far references: a lower bound of their own distance."""
    at = lambda c, i: F.shiftright(F.col(c), 7 * i).bitwiseAND(F.lit(127))
    return F.greatest(*[F.abs(at(a, i) - at(b, i)) for i in range(len(FAR_PIVOTS))])


def _bucket_keys(table: DataFrame) -> DataFrame:
    """One row per fingerprint and choice of three pivot groups: distances within a group agree if no bit of it differs."""
    code = lambda j: ((F.col("near")[0] + 2 - F.col("near")[j + 1]) / 2).cast("long")
    groups = [sum((code(j) * 3 ** k for k, j in enumerate(g)), F.lit(0).cast("long")) for g in PIVOT_GROUPS]
    d = table.select("fp", "far", *[g.alias(f"g{i}") for i, g in enumerate(groups)])
    keys = []
    for t, pick in enumerate(combinations(range(5), 3)):
        key = F.lit(t).cast("long")
        for i in pick:
            key = key * (3 ** len(PIVOT_GROUPS[i])) + F.col(f"g{i}")
        keys.append(key)
    return d.select("fp", "far", F.explode(F.array(*keys)).alias("key"))


def _exact_keys(prints: DataFrame) -> DataFrame:
    """For crowded buckets: all bits but two of twelve groups. A bucket spans at most 12 free bits."""
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(~(BIT_GROUPS[i] | BIT_GROUPS[j]) & (2 ** 64 - 1)))).alias("bits"))
            for t, (i, j) in enumerate(combinations(range(12), 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def fingerprint_links(prints: DataFrame, direct: int = DIRECT) -> DataFrame:
    """All pairs ``a`` < ``b`` of distinct fingerprints ``fp`` that differ in at most two bits.

    Candidates share their distances to the references of three of five groups: two changed
    bits reach two groups at most, so no pair is lost. A bucket of two gives its pair from the
    grouping itself, one of up to ``direct`` is joined with itself. The members of a larger one go to
    buckets by all bits but two of twelve groups, where a fingerprint has at most 78 partners and
    a bucket at most 4,096 members. Candidates whose distances to the far references
    differ by more than two are discarded, and the rest verified bit by bit.
    """
    table = cut_lineage(pivot_table(prints.select("fp").distinct()))
    rows = _bucket_keys(table)
    member = F.struct("fp", "far")
    sizes = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("lo"), F.max(member).alias("hi")).where("n > 1"))
    two = sizes.where("n = 2").select(F.col("lo.fp").alias("a"), F.col("hi.fp").alias("b"), F.col("lo.far").alias("fa"), F.col("hi.far").alias("fb"))
    some = cut_lineage(rows.join(sizes.where("n > 2").select("key", "n"), "key"))
    left = some.where(F.col("n") <= direct).select("key", F.col("fp").alias("a"), F.col("far").alias("fa"))
    right = left.select("key", F.col("a").alias("b"), F.col("fa").alias("fb"))
    near = (_far_gap("fa", "fb") <= RADIUS) & (_differ("a", "b") <= RADIUS)
    mid = left.join(right, ["key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    crowded = _exact_keys(some.where(F.col("n") > direct).select("fp").distinct())
    l2, r2 = crowded.withColumnRenamed("fp", "a"), crowded.withColumnRenamed("fp", "b")
    dense = l2.join(r2, ["key"]).where((F.col("a") < F.col("b")) & (_differ("a", "b") <= RADIUS)).select("a", "b")
    return two.where(near).select("a", "b").unionByName(mid).unionByName(dense).distinct()


def similar_styles(styles: DataFrame, style_key: str = "style_key", description: str = "description") -> DataFrame:
    """One row per style description: ``style_key``, ``fp`` and ``component_id``.

    ``fp`` is the 64-bit SimHash of the description's 3-word shingles (A-Z lower-cased,
    XXH64 with seed 42, a bit is set if it is in over half of them; a shorter text is one
    shingle, a text without words is zero). Fingerprints link at two or fewer differing
    bits; ``component_id`` is the smallest key that can be reached. Copies collapse into
    one fingerprint before any join, null descriptions count as empty, null keys get a component but
    never name one, repeated rows stay, an empty table gives none. A key column that is itself called
    ``fp`` or ``component_id`` comes back with ``_key`` behind its name.
    """
    name = f"{style_key}_key" if style_key in ("fp", "component_id") else style_key
    marked = cut_lineage(styles.select(F.col(style_key).alias("__key"), simhash64(text_of(description)).alias("fp")))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("__key").alias("low")))
    links = fingerprint_links(prints)
    parts = connected_components(prints, links, "fp", "a", "b")
    parts = cut_lineage(parts.select("fp", "low", "component"))
    lows = parts.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # Lone fingerprints carry their own key already.
    many = parts.join(lows.where("n > 1"), "component", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return marked.join(many, "fp").select(F.col("__key").alias(name), "fp", "component_id")


def one_per_component(styles: DataFrame, style_key: str = "style_key", description: str = "description") -> DataFrame:
    """The rows that name their component, with all columns; rows with a null key stay."""
    comps = similar_styles(styles, style_key, description)
    gone = comps.where(F.col(style_key) != F.col("component_id")).select(style_key).distinct()
    return styles.join(gone, style_key, "left_anti")
