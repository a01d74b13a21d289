"""Hint points: normalisation, precedence, density limits, composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions.color import clip
from chromaframe.functions.points import (MANUAL_SOURCES, effective_strength, source_priority,
                                          source_strength)
from chromaframe.operators.spatial import suppress_near
from chromaframe.scale import cut_lineage, first_per_group, rank_within


def normalize_hints(df: DataFrame, default_source: str = "auto_instance") -> tuple[DataFrame, DataFrame]:
    """Accepted hints with defaults and clamps, and the rejected rows.

    Input: ``kind`` ('record' or 'tuple'), record fields (``rgb`` or the older ``color``,
    array<int>), and for tuples ``items`` array<string> of x, y, 'r g b'[, radius].
    """
    size = F.coalesce(F.size("items"), F.lit(0))
    tuple_ok = (F.col("kind") == "tuple") & size.isin(3, 4)
    record_ok = (F.col("kind") == "record") & F.col("x_norm").isNotNull() & F.col("y_norm").isNotNull()
    d = df.withColumn("__ok", F.coalesce(tuple_ok | record_ok, F.lit(False)))
    is_t = F.col("kind") == "tuple"
    item = lambda i: F.get("items", F.lit(i))
    rgb = F.when(is_t, F.transform(F.split(item(2), " "), lambda v: v.cast("int"))).otherwise(
        F.coalesce("rgb", "color", F.array(F.lit(128), F.lit(128), F.lit(128))))
    source = F.when(is_t, F.lit(default_source)).otherwise(F.coalesce("source", F.lit(default_source)))
    d = d.withColumns({"__rgb": rgb, "__src": source})
    strength = F.when(is_t, source_strength("__src")).otherwise(F.coalesce("strength", source_strength("__src")))
    drop = {"kind", "items", "color", "rgb", "x_norm", "y_norm", "radius_norm", "strength", "source", "confidence",
            "priority", "__ok", "__rgb", "__src"}
    keep = [c for c in df.columns if c not in drop]
    good = d.where("__ok").select(
        *keep, F.when(is_t, item(0).cast("double")).otherwise(F.col("x_norm")).alias("x_norm"),
        F.when(is_t, item(1).cast("double")).otherwise(F.col("y_norm")).alias("y_norm"),
        *[F.get("__rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")],
        F.coalesce(F.when(is_t, item(3).cast("double")).otherwise(F.col("radius_norm")), F.lit(0.004)).alias("radius_norm"),
        strength.alias("strength"), F.col("__src").alias("source"),
        F.coalesce(F.when(~is_t, F.col("confidence")), F.lit(1.0)).alias("confidence"),
        F.coalesce(F.when(~is_t, F.col("priority")), source_priority("__src")).alias("priority"))
    good = good.withColumns({**{c: clip(c, 0.0, 1.0) for c in ("x_norm", "y_norm", "strength", "confidence")},
                             **{c: clip(c, 0, 255) for c in "rgb"}, "radius_norm": F.greatest(F.lit(0.0005), "radius_norm")})
    return good, d.where(~F.col("__ok")).select(*df.columns)


def override_by_region(auto: DataFrame, overrides: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Automatic points outside overridden regions, and the last override of each region."""
    last = first_per_group(overrides.where(F.col("region_id") > 0), ["page_id", "region_id"], [F.desc(order)], 1)
    kept = auto.join(last.select("page_id", "region_id"), ["page_id", "region_id"], "left_anti")
    return kept.select(*auto.columns), last


def confidence_gate() -> Column:
    src, conf = F.col("source"), F.col("confidence")
    return ~(((src == "character_identity") & (conf < 0.56)) | ((src == "auto_instance") & (conf < 0.36)))


def limit_density(hints: DataFrame, regions: DataFrame | None, page_cap: int = 120, spacing: float = 0.0025) -> DataFrame:
    """Greedy spaced pick of 1, 2 or 3 hints per (region, source, semantic, character).

    At most three hints survive per group, so the greedy pass is three rounds of "best
    hint far enough from those chosen", each an ordinary grouped maximum over rows that
    are written once. Automatic hints are then capped per page. ``regions``: page_id, region_id, frac.
    """
    keys = ["page_id", "region_id", "source", "semantic", "character_id"]
    if regions is not None:
        d = hints.join(regions.select("page_id", "region_id", "frac"), ["page_id", "region_id"], "left")
    else:
        d = hints.withColumn("frac", F.lit(None).cast("double"))
    known = F.col("frac").isNotNull() & (F.coalesce(F.col("region_id"), F.lit(0)) > 0)
    limit = (F.when(~known, 2).when(F.col("frac") <= 0.006, 1).when(F.col("frac") <= 0.04, 2).otherwise(3))
    d = d.withColumns({"__limit": limit, "__eff": effective_strength()})
    best = F.struct(F.col("priority"), F.col("__eff"), -F.col("seq"))
    point = F.struct("hint_id", "x_norm", "y_norm", "__limit")

    def far(i):
        dx, dy = F.col("x_norm") - F.col(f"__c{i}.x_norm"), F.col("y_norm") - F.col(f"__c{i}.y_norm")
        return dx * dx + dy * dy > spacing * spacing
    # Null-safe group keys travel as one struct so that missing values still group.
    d = cut_lineage(d.withColumn("__key", F.struct(*keys)))
    chosen = d.groupBy("__key").agg(F.max_by(point, best).alias("__c1"))
    for i in (2, 3):
        cond = F.lit(True)
        joined = d.join(chosen.where(F.col("__c1.__limit") >= i), "__key")
        for k in range(1, i):
            cond = cond & F.coalesce(far(k), F.lit(False))
        nxt = joined.where(cond).groupBy("__key").agg(F.max_by(point, best).alias(f"__c{i}"))
        chosen = chosen.join(nxt, "__key", "left")
    ids = chosen.select(F.explode(F.filter(F.array(*[F.col(f"__c{i}.hint_id") for i in (1, 2, 3)]),
                                           lambda v: v.isNotNull())).alias("hint_id"))
    picked = d.join(ids, "hint_id", "left_semi").drop("__key", "frac", "__limit")
    manual = picked.where(F.col("source").isin(*MANUAL_SOURCES))
    auto = first_per_group(picked.where(~F.col("source").isin(*MANUAL_SOURCES)), ["page_id"],
                           [F.desc("priority"), F.desc("__eff"), F.asc("seq")], page_cap)
    return auto.unionByName(manual).drop("__eff").select(*hints.columns)


def thin_evenly(df: DataFrame, keys: Sequence[str], k: int, order: str = "seq", width: int = 65_536) -> DataFrame:
    """Keep ``k`` evenly spaced rows of a longer group: positions trunc(i*(n-1)/(k-1)).

    ``order`` is a whole-number sequence; rows are ranked in buckets of ``width`` values,
    so no group is sorted in one task.
    """
    d = rank_within(df, keys, [order], F.floor(F.col(order) / width), "__pos", "__n")
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.floor(
        i.cast("double") * ((F.col("__n") - 1) / float(max(1, k - 1)))).cast("long"))
    keep = (F.col("__n") <= k) | (F.col("__pos") == F.col("__n")) | F.array_contains(spots, F.col("__pos") - 1)
    return d.where(keep).drop("__pos", "__n")


def compose_hints(auto: DataFrame, manual: DataFrame, regions: DataFrame | None = None,
                  manual_strength: float = 1.0) -> DataFrame:
    """Kept automatic hints, region overrides and manual points of every page."""
    s = max(0.0, min(1.0, manual_strength))
    a = auto.where((F.col("source") != "style_only") & (effective_strength() > 0.01))
    if s > 0.001:
        m = manual.withColumns({"strength": clip(F.col("strength") * (0.20 + 1.55 * s), 0.0, 1.0),
                                "radius_norm": F.greatest(F.lit(0.0005), F.col("radius_norm") * (0.65 + 1.10 * s))})
    else:
        m = manual.limit(0)
    whole = (F.col("source") == "manual_region") & (F.coalesce(F.col("region_id"), F.lit(0)) > 0)
    a, regional = override_by_region(a, m.where(whole))
    points = m.where(~whole)
    a = suppress_near(a, points)
    a = limit_density(a.where(confidence_gate()), regions)
    cols = auto.columns
    return (a.select(*cols).withColumn("part", F.lit("automatic"))
            .unionByName(regional.select(*cols).withColumn("part", F.lit("region")))
            .unionByName(points.select(*cols).withColumn("part", F.lit("manual"))))


def expand_region_hints(overrides: DataFrame, tiers: DataFrame, exemplars: DataFrame,
                        manual_strength: float = 1.0) -> DataFrame:
    """A region override becomes its tone-tier points; without exemplars it stays one mid-tone point.

    ``tiers``: page_id, region_id, tier, tier_r, tier_g, tier_b. ``exemplars``: page_id,
    region_id, tier, x_norm, y_norm.
    """
    radius = F.greatest(F.lit(0.002), F.col("radius_norm") * (0.55 + 1.25 * manual_strength))
    at = exemplars.select("page_id", "region_id", "tier", F.col("x_norm").alias("__x"), F.col("y_norm").alias("__y"))
    d = overrides.join(at, ["page_id", "region_id"], "left").withColumn("tier", F.coalesce("tier", F.lit("mid")))
    d = d.join(tiers, ["page_id", "region_id", "tier"])
    return d.select("page_id", "region_id", "hint_id", "tier", F.coalesce("__x", "x_norm").alias("x_norm"),
                    F.coalesce("__y", "y_norm").alias("y_norm"), radius.alias("radius_norm"),
                    F.when(F.col("__x").isNotNull(), F.lit(min(1.0, max(0.0, manual_strength))))
                    .otherwise(F.col("strength")).alias("strength"),
                    F.col("tier_r").alias("r"), F.col("tier_g").alias("g"), F.col("tier_b").alias("b"))


def degrade_for_retry(hints: DataFrame) -> DataFrame:
    """Keep manual hints, shrink identity hints, drop the rest."""
    identity = F.col("source") == "character_identity"
    return hints.where(F.col("source").isin(*MANUAL_SOURCES) | identity).withColumns({
        "radius_norm": F.when(identity, F.greatest(F.lit(0.001), F.col("radius_norm") * 0.55)).otherwise(F.col("radius_norm")),
        "strength": F.when(identity, F.col("strength") * 0.72).otherwise(F.col("strength"))})


def last_by_source(hints: DataFrame, keys: Sequence[str] = ("page_id", "source"), order: str = "seq") -> DataFrame:
    return first_per_group(hints, keys, [F.desc(order)], 1)


def clear_by_source(hints: DataFrame, source: str) -> DataFrame:
    return hints.where(F.col("source") != source)


def cleared_counts(hints: DataFrame, source: str) -> DataFrame:
    return hints.groupBy("page_id").agg(F.count_if(F.col("source") == source).alias("removed"))


def pop_last(hints: DataFrame, keys: Sequence[str] = ("page_id",), order: str = "seq") -> DataFrame:
    """Drop the newest row of every key."""
    newest = hints.groupBy(*keys).agg(F.max(order).alias("__last"))
    d = hints.join(newest, list(keys))
    return d.where(F.col(order) < F.col("__last")).drop("__last")


