"""A page from its labelled regions to colour hints: matching, attribution, colour choice and tiers as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions.style import DESCRIPTOR_FIELDS, style_tiers
from chromaframe.operators.identity import assign_to_owner, choose_color_source, identity_match, identity_match_strict
from chromaframe.scale import measured_broadcast

#: Labels below this confidence take no part.
MIN_CONF = 0.25
_FEATURES = {"hist": "array<double>", "embedding": "array<float>", "lineart": "array<float>", "forced": "int"}


def anchor_instances(regions: DataFrame, features: DataFrame | None = None, min_conf: float = MIN_CONF) -> DataFrame:
    """Hair regions as instances to be matched: tone, aspect and area share, with ``features`` where they are known.

    ``features``: page_id, region_id and any of hist, embedding, lineart, forced.
    """
    hair = regions.where((F.col("label") == "hair") & (F.col("conf") >= min_conf))
    own = hair.withColumns({"inst_id": F.struct("page_id", "region_id"), "tone": F.col("mean_gray").cast("double"), "area_frac": F.col("frac").cast("double"),
                            "aspect": F.col("w").cast("double") / F.greatest(F.lit(1), F.col("h"))})
    have = [c for c in _FEATURES if features is not None and c in features.columns]
    if have:
        own = own.join(features.select("page_id", "region_id", *have), ["page_id", "region_id"], "left")
    return own.withColumns({c: F.lit(None).cast(kind) for c, kind in _FEATURES.items() if c not in have})


def identity_assignments(regions: DataFrame, profiles: DataFrame, features: DataFrame | None = None, faces: DataFrame | None = None,
                         keys: Sequence[str] = ("book_id",), min_conf: float = MIN_CONF) -> tuple[DataFrame, DataFrame]:
    """Regions with the profile that owns them, and the matched anchors.

    A page is matched by its hair anchors, and its other regions go to the anchor that holds them. A page without one falls back on
    ``faces`` (see ``identity_match_strict``), if these are given. Assignments: keys, page_id, region_id, attribute, char_id,
    match_score, lock_allowed, way (anchor or face).
    """
    keys = list(keys)
    anchors = anchor_instances(regions, features, min_conf)
    matched = identity_match(anchors, profiles, keys).where("matched")
    score = F.col("match_score")
    hair = matched.select(*keys, "page_id", "region_id", F.lit("hair").alias("attribute"), F.col("matched_char").alias("char_id"), score, "lock_allowed", F.lit("anchor").alias("way"))
    boxes = matched.select("page_id", F.col("region_id").alias("anchor_id"), F.col("matched_char").alias("char_id"), "distance", "match_score", "margin", "lock_allowed",
                           F.col("was_forced").alias("forced"), "x", "y", "w", "h")
    book = regions.select(*keys, "page_id").distinct()
    held = assign_to_owner(regions, boxes).join(book, "page_id").select(
        *keys, "page_id", "region_id", F.col("label").alias("attribute"), "char_id", score, "lock_allowed", F.lit("anchor").alias("way"))
    out = hair.unionByName(held)
    if faces is not None:
        lost = faces.join(anchors.select("page_id").distinct(), "page_id", "left_anti")
        claimed = identity_match_strict(lost, profiles, keys).join(book, "page_id")
        out = out.unionByName(claimed.select(*keys, "page_id", "region_id", "attribute", "char_id", F.lit(None).cast("double").alias("match_score"), "lock_allowed", F.lit("face").alias("way")))
    return out, matched


def analyze_pages(regions: DataFrame, profiles: DataFrame, palette: DataFrame, memory: DataFrame | None = None, scene: DataFrame | None = None,
                  features: DataFrame | None = None, faces: DataFrame | None = None, styles: DataFrame | None = None, keys: Sequence[str] = ("book_id",),
                  min_conf: float = MIN_CONF, reference_strength: float = 1.0, scene_strength: float = 0.7, style_strength: float = 1.0) -> dict[str, DataFrame]:
    """Lazy tables of a page analysis: ``assignments``, ``colors``, ``hints``, ``diagnostics``.

    ``regions``: keys, page_id, region_id, label, conf, x, y, w, h, mean_gray, frac. ``palette``: keys, char_id, attribute, color. ``memory``:
    page_id, region_id, color. ``scene``: label, color. ``styles``: region (a label) and descriptor fields. A locked identity
    colours a region first, then memory, then the scene; other regions get no colour. Each colour becomes three tiers at the region's centre.
    A page whose labels are all below ``min_conf`` has no hints; a page without regions is in no table.
    """
    keys = list(keys)
    assigned, _ = identity_assignments(regions, profiles, features, faces, keys, min_conf)
    lib = measured_broadcast(palette.select(*keys, "char_id", "attribute", "color"))
    colored = assigned.join(lib, [*keys, "char_id", "attribute"]).where(F.col("color").isNotNull())
    none = lambda ddl: regions.sparkSession.createDataFrame([], ddl)
    page, region = (regions.schema[c].dataType.simpleString() for c in ("page_id", "region_id"))
    memory = none(f"page_id {page}, region_id {region}, color string") if memory is None else memory
    scene = none("label string, color string") if scene is None else scene
    colors = choose_color_source(regions, colored, memory, scene, min_conf, reference_strength, scene_strength)
    styles = none("region string") if styles is None else styles
    plain = styles.select("region", *[F.col(c) if c in styles.columns else F.lit(v).alias(c) for c, v in DESCRIPTOR_FIELDS.items()])
    seeds = colors.select("*", *[v.alias(c) for c, v in zip("rgb", C.hex_to_rgb("color"))]).withColumn(
        "region", F.when(F.col("label") == "clothing", "clothing_primary").otherwise(F.col("label")))
    tiers = style_tiers(seeds, plain, style_strength, on=("region",)).drop("r", "g", "b", "region")
    place = regions.select("page_id", "region_id", (F.col("x") + F.col("w") / 2.0).alias("cx"), (F.col("y") + F.col("h") / 2.0).alias("cy"))
    hints = tiers.join(place, ["page_id", "region_id"])
    many = F.count(F.lit(1))
    found = regions.groupBy("page_id").agg(many.alias("regions"), F.count_if(F.col("conf") >= min_conf).alias("semantic_confident"),
                                           F.count_if((F.col("label") == "hair") & (F.col("conf") >= min_conf)).alias("anchors"))
    given = assigned.groupBy("page_id").agg(many.alias("identity_assignments"))
    sources = [F.count_if(F.col("source") == s).alias(s) for s in ("character_identity", "auto_instance", "scene_palette")]
    told = colors.groupBy("page_id").agg(many.alias("colored"), *sources)
    counts = ("identity_assignments", "colored", "character_identity", "auto_instance", "scene_palette")
    report = found.join(given, "page_id", "left").join(told, "page_id", "left").fillna(0, list(counts))
    reason = F.when(F.col("anchors") == 0, "no_hair_anchor")
    return {"assignments": assigned, "colors": colors, "hints": hints, "diagnostics": report.withColumn("reason", reason)}
