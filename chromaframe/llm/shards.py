"""Placing page records on weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.scale import rank_within


def _bid(key: Column, shard: int, weight: float) -> Column:
    """What a shard offers for a key: -weight / ln(u), u in (0, 1) from the key and the shard alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    offer = F.lit(float(weight)) / -F.log(u) if weight > 0 else F.lit(-1.0)
    return F.struct(offer.alias("offer"), F.lit(-shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Rendezvous choice: the shard that offers most for the key (ties: the lower number)."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    offers = [_bid(key, i, w) for i, w in enumerate(weights)]
    best = F.greatest(*offers) if len(offers) > 1 else offers[0]
    return (-best["shard"]).cast("int")


def shard_pages(pages: DataFrame, page_id: str = "page_id", weights: Sequence[float] = (1.0,) * 16,
                grown_weights: Sequence[float] | None = None, slot_buckets: int = 4096) -> DataFrame:
    """Page records with ``shard`` and ``slot``, and ``grown_shard`` under ``grown_weights``.

    The shard depends on the page id and the weights alone, so equal ids share a shard
    wherever they come from; shares follow the weights, and a further shard takes rows
    only into itself. A null id is a key like any other. ``slot`` numbers a shard's rows
    from 0 without gaps: rows are counted in hash buckets of a shard and shifted by the
    buckets before, so no task holds a whole shard. Columns named like the new ones are replaced.
    """
    keep = [c for c in pages.columns if c not in ("shard", "slot", "grown_shard")]
    key = F.coalesce(F.col(page_id).cast("string"), F.lit("\u0000null"))
    out = pages.select(*keep, F.xxhash64(key).alias("__mix"), shard_of(key, weights).alias("shard"),
                       (shard_of(key, grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"))
    bucket = F.pmod("__mix", F.lit(slot_buckets))
    ranked = rank_within(out, ["shard"], ["__mix", page_id], bucket, "__rank")
    return ranked.select(*keep, "shard", (F.col("__rank") - 1).alias("slot"), "grown_shard")
