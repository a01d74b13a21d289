"""Identity matching, attribution of regions to matched anchors, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions import geometry as G
from chromaframe.functions import vectors as V
from chromaframe.functions.color import clip
from chromaframe.scale import (cover_cells, first_per_group, id_blocks, join_library, measured_broadcast, point_cell)
from chromaframe.streaming.fold import keyed_fold

# Match threshold, then score, margin and confidence floors of a lock.
GATES = {"match": 0.58, "score": 0.48, "margin": 0.055, "confidence": 0.32}
STRICT_GATES = {"match": 0.42, "score": 0.62, "margin": 0.075, "confidence": 0.30}

_FEATURES = ("tone", "aspect", "area_frac", "hist", "embedding", "lineart")


def two_nearest(instances: DataFrame, profiles: DataFrame, keys: Sequence[str] = ("book_id",),
                id_col: str = "inst_id") -> DataFrame:
    """Add d1, id1, d2, id2: the two nearest profiles of the row's library.

    A library travels as arrays of at most 64 profiles, so an instance meets a block
    in one row instead of one row per pair. Several blocks per key are reduced exactly.
    """
    keys = list(keys)
    fields = [F.col(c) for c in _FEATURES] + [V.norm(c).alias(f"{c}_norm") for c in ("embedding", "lineart")]
    blocks, most = id_blocks(profiles, keys, "char_id", fields)
    rows = instances.withColumns({f"{c}_norm": V.norm(c) for c in ("embedding", "lineart")})
    d = join_library(rows, blocks, keys, F.col(id_col), "left")
    names = (*_FEATURES, "embedding_norm", "lineart_norm")
    mine = {n: F.col(n) for n in names}
    ranked = F.slice(F.array_sort(F.transform("block", lambda p: F.struct(
        V.feature_distance(mine, {n: p[n] for n in names}).alias("d"), p["char_id"].alias("id")))), 1, 2)
    d = d.withColumn("__top", ranked).drop("block", "embedding_norm", "lineart_norm")
    if most > 1:
        best = (d.select(id_col, F.explode_outer("__top").alias("t"))
                .select(id_col, F.col("t.d").alias("d"), F.col("t.id").alias("id")))
        best = first_per_group(best, [id_col], [F.asc_nulls_last("d"), "id"], 2)
        best = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("__top"))
        d = instances.join(best, id_col, "left")
    first, second = F.get("__top", F.lit(0)), F.get("__top", F.lit(1))
    return d.select(*instances.columns, first["d"].alias("d1"), first["id"].alias("id1"),
                    second["d"].alias("d2"), second["id"].alias("id2"))


def decide(d: DataFrame, gates: dict, confidence: str = "conf") -> DataFrame:
    """Turn d1/d2 (and ``forced``, ``forced_known``) into a match decision."""
    never = F.coalesce(F.col("forced") == -1, F.lit(False))
    pinned = F.col("forced").isNotNull() & ~never & F.col("forced_known")
    none = F.col("d1").isNull() & ~pinned
    other = F.when(F.col("id1") != F.col("forced"), F.col("d1")).otherwise(F.col("d2"))
    d1 = F.when(never | none, 1.0).when(pinned, 0.0).otherwise(F.col("d1"))
    d2 = F.when(never | none, 1.0).when(pinned, F.coalesce(other, F.lit(1.0))).otherwise(F.coalesce("d2", F.lit(1.0)))
    blank = never | none
    d = d.withColumns({"distance": d1, "second_distance": d2})
    score = F.when(blank, 0.0).otherwise(clip(F.lit(1.0) - F.col("distance"), 0.0, 1.0))
    second = F.when(blank, 0.0).otherwise(clip(F.lit(1.0) - F.col("second_distance"), 0.0, 1.0))
    margin = F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("second_distance") - F.col("distance")))
    matched = ~blank & (pinned | (F.col("distance") <= gates["match"]))
    d = d.withColumns({"match_score": score, "second_score": second, "margin": margin, "matched": matched,
                       "was_forced": never | pinned})
    lock = (~blank) & (pinned | (F.col("matched") & (F.col("match_score") >= gates["score"])
                                 & (F.col("margin") >= gates["margin"]) & (F.col(confidence) >= gates["confidence"])))
    char = F.when(F.col("matched"), F.when(pinned, F.col("forced")).otherwise(F.col("id1")))
    return d.withColumns({"lock_allowed": lock, "matched_char": char}).drop("d1", "id1", "d2", "id2", "forced_known")


def identity_match(instances: DataFrame, profiles: DataFrame, keys: Sequence[str] = ("book_id",),
                   gates: dict | None = None, id_col: str = "inst_id") -> DataFrame:
    """Match every instance to its library with a top-2 margin gate.

    A known ``forced`` profile overrides the gates; -1 forbids a match.
    """
    d = two_nearest(instances, profiles, keys, id_col)
    known = profiles.select(*keys, F.col("char_id").alias("forced"), F.lit(True).alias("forced_known"))
    d = d.join(measured_broadcast(known), [*keys, "forced"], "left").fillna({"forced_known": False})
    return decide(d, gates or GATES)


def strict_gates(gates: dict) -> dict:
    """The gates of the face fallback: never looser than its own."""
    return {"match": min(gates["match"], STRICT_GATES["match"]), "score": max(gates["score"], STRICT_GATES["score"]),
            "margin": max(gates["margin"], STRICT_GATES["margin"]), "confidence": STRICT_GATES["confidence"]}


def claim_regions(faces: DataFrame, key: str = "page_id") -> DataFrame:
    """Stronger, then larger faces claim regions first; a face without free hair is skipped.

    ``faces``: face_id, confidence, area, matched_char, lock_allowed, was_forced, and
    ``regions`` as array<struct<attribute, region_id, forced>> (at most 16 per face).
    ``forced`` on a hair region pins the face whose anchor it becomes.
    """
    order = {"hair": 0, "skin": 1, "eyes": 2, "clothing": 3}

    def step(state, row):
        free = [r for r in row.regions if int(r["region_id"]) not in state["claimed"]]
        hair = [r for r in free if r["attribute"] == "hair"]
        if not hair:
            return []
        anchor = hair[0]
        pin = anchor["forced"]
        char, lock, forced = row.matched_char, bool(row.lock_allowed), bool(row.was_forced)
        if pin is not None and pin == pin:
            char, lock, forced = (None, False, True) if int(pin) == -1 else (int(pin), True, True)
        if char is None or char != char:
            return []
        out = []
        for r in sorted(free, key=lambda r: order[r["attribute"]]):
            allowed = lock and not (r["attribute"] == "eyes" and not forced and row.confidence < 0.42)
            out.append((getattr(row, key), row.face_id, int(anchor["region_id"]), int(r["region_id"]), r["attribute"],
                        int(char), allowed, forced))
            state["claimed"].add(int(r["region_id"]))
        return out
    typ = faces.schema[key].dataType.simpleString()
    face_typ = faces.schema["face_id"].dataType.simpleString()
    rows = faces.withColumn("__rank_c", -F.col("confidence")).withColumn("__rank_a", -F.col("area"))
    return keyed_fold(rows, [key], ["__rank_c", "__rank_a", "face_id"], lambda: {"claimed": set()}, step,
                      f"{key} {typ}, face_id {face_typ}, anchor_region int, region_id int, attribute string, "
                      "char_id int, lock_allowed boolean, forced boolean")


def identity_match_strict(faces: DataFrame, profiles: DataFrame, keys: Sequence[str] = ("book_id",),
                          gates: dict | None = None) -> DataFrame:
    """Face-geometry matching: tightened gates, then greedy claiming of shared regions."""
    free = faces.withColumn("forced", F.lit(None).cast("int"))
    matched = identity_match(free, profiles, keys, strict_gates(gates or GATES), id_col="face_id")
    return claim_regions(matched.drop("forced"))


def assign_to_owner(regions: DataFrame, matches: DataFrame, min_conf: float = 0.32, cell: float = 256.0) -> DataFrame:
    """Attribute a region to the matched anchor whose head or body box holds its centre.

    Cheapest anchor wins: distance to the anchor centre in box units plus half the match
    distance. Anchor boxes are spread over grid cells, so a page is never one group.
    """
    anchor = ("x", "y", "w", "h")
    hb, bb = G.head_box(anchor), G.body_box(anchor)
    m = matches.select(
        "page_id", "anchor_id", "char_id", "distance", "match_score", "margin", F.col("lock_allowed").alias("__lock"),
        "forced", (F.col("x") + F.col("w") / 2.0).alias("ax"), (F.col("y") + F.col("h") / 2.0).alias("ay"),
        *[c.alias(f"h{n}") for c, n in zip(hb, "xywh")], *[c.alias(f"b{n}") for c, n in zip(bb, "xywh")])
    x0, y0 = F.least("hx", "bx"), F.least("hy", "by")
    m = cover_cells(m, x0, y0, F.greatest(F.col("hx") + F.col("hw"), F.col("bx") + F.col("bw")) - x0,
                    F.greatest(F.col("hy") + F.col("hh"), F.col("by") + F.col("bh")) - y0, cell)
    r = regions.where(F.col("label").isin("skin", "eyes", "clothing")).select(
        "page_id", "region_id", "label", F.col("conf").alias("semantic_confidence"),
        (F.col("x") + F.col("w") / 2.0).alias("cx"), (F.col("y") + F.col("h") / 2.0).alias("cy"))
    d = point_cell(r, F.col("cx"), F.col("cy"), cell).join(m, ["page_id", "__cx", "__cy"])
    in_head, in_body = G.contains(("hx", "hy", "hw", "hh"), "cx", "cy"), G.contains(("bx", "by", "bw", "bh"), "cx", "cy")
    fits = F.when(F.col("label") == "eyes", in_head).when(F.col("label") == "skin", in_head | in_body).otherwise(in_body)
    small = F.col("label").isin("eyes", "skin")
    nw = F.greatest(F.lit(1), F.when(small, F.col("hw")).otherwise(F.col("bw")))
    nh = F.greatest(F.lit(1), F.when(small, F.col("hh")).otherwise(F.col("bh")))
    dx, dy = (F.col("cx") - F.col("ax")) / nw, (F.col("cy") - F.col("ay")) / nh
    d = d.where(fits).withColumn("cost", F.round(F.sqrt(dx * dx + dy * dy) + F.col("distance") * 0.5, 9))
    pick = F.min_by(F.struct("anchor_id", "char_id", "distance", "match_score", "margin", "__lock", "forced"),
                    F.struct("cost", "anchor_id"))
    best = d.groupBy("page_id", "region_id", "label", "semantic_confidence").agg(pick.alias("m"), F.min("cost").alias("cost"))
    floor = F.when(F.col("label") == "eyes", max(0.42, min_conf)).otherwise(min_conf)
    return best.select("page_id", "region_id", "label", "semantic_confidence", "cost", "m.anchor_id", "m.char_id",
                       "m.distance", "m.match_score", "m.margin", "m.forced",
                       (F.col("m.__lock") & (F.col("semantic_confidence") >= floor)).alias("lock_allowed"))


def zero_shot_label(vectors: DataFrame, prototypes: DataFrame, id_col: str = "item_id", scale: float = 100.0) -> DataFrame:
    """Softmax over scaled dot products with the prototypes; best label and its probability."""
    blocks, most = id_blocks(prototypes, [], "label_id", [F.col("embedding")])
    d = join_library(vectors, blocks, [], F.col(id_col))
    sims = F.transform("block", lambda p: F.struct(
        (V.dot(F.col("embedding"), p["embedding"]) * scale).alias("s"), (-p["label_id"]).alias("neg")))
    d = d.select(id_col, sims.alias("sims")).withColumn("best", F.array_max("sims"))
    mass = F.aggregate("sims", F.lit(0.0), lambda t, v: t + F.exp(v["s"] - F.col("best")["s"]))
    d = d.select(id_col, "best", mass.alias("mass"))
    if most > 1:
        d = d.groupBy(id_col).agg(F.max("best").alias("best"), F.collect_list(F.struct(
            F.col("best")["s"].alias("s"), "mass")).alias("parts"))
        d = d.withColumn("mass", F.aggregate("parts", F.lit(0.0), lambda t, v: t + v["mass"] * F.exp(
            v["s"] - F.col("best")["s"])))
    return d.select(id_col, (-F.col("best")["neg"]).alias("label_id"), (F.lit(1.0) / F.col("mass")).alias("probability"))


def resolve_overrides(assignments: DataFrame, profiles: DataFrame, keys: Sequence[str] = ("page_id",),
                      profile_keys: Sequence[str] = ("char_id",)) -> DataFrame:
    """Colour per (character, attribute) over locked or forced rows, one row per distinct region.

    The assignment's colour, else the profile's (columns ``hair_hex``, ``eyes_hex``; found by ``profile_keys``, with
    ``book_id`` among them where a library holds several books); the last forced row wins, else the first row, in ``ord`` order.
    """
    keys = list(keys)
    a = assignments.where(F.col("attribute").isin("hair", "eyes") & (F.col("lock_allowed") | F.col("forced"))
                          & F.col("char_id").isNotNull())
    p = measured_broadcast(profiles.select(*profile_keys, "hair_hex", "eyes_hex"))
    d = a.join(p, list(profile_keys), "left").withColumn("color", F.coalesce(
        "color", F.when(F.col("attribute") == "eyes", F.col("eyes_hex")).otherwise(F.col("hair_hex"))))
    d = d.where(C.hex_channel("color", 0).isNotNull())
    group = [*keys, "char_id", "attribute"]
    order = F.struct(F.col("forced"), F.when(F.col("forced"), F.col("ord")).otherwise(-F.col("ord")))
    chosen = d.groupBy(*group).agg(F.max_by("color", order).alias("target"))
    return d.select(*group, "region_id").distinct().join(chosen, group)


def choose_color_source(regions: DataFrame, identity: DataFrame, memory: DataFrame, scene: DataFrame,
                        min_conf: float = 0.25, reference_strength: float = 1.0,
                        scene_strength: float = 0.7) -> DataFrame:
    """One colour source per region: locked identity, then memory, then scene palette."""
    scene_labels = ("metal", "wood", "sky", "foliage", "stone", "water", "fire", "background")
    r = regions.where((F.col("label") != "bubble") & (F.col("conf") >= min_conf)
                      & (F.col("mean_gray") < 242) & (F.col("mean_gray") >= 55))
    i = identity.where("lock_allowed").select("page_id", "region_id", F.col("color").alias("__i"),
                                              F.col("char_id"), F.col("match_score").alias("__score"))
    m = memory.select("page_id", "region_id", F.col("color").alias("__m"))
    s = measured_broadcast(scene.where(F.col("label").isin(*scene_labels)).select("label", F.col("color").alias("__s")))
    d = r.join(i, ["page_id", "region_id"], "left").join(m, ["page_id", "region_id"], "left").join(s, "label", "left")
    has_i, has_m = F.col("__i").isNotNull(), F.col("__m").isNotNull()
    d = d.withColumns({
        "color": F.coalesce("__i", "__m", "__s"),
        "source": F.when(has_i, "character_identity").when(has_m, "auto_instance").otherwise("scene_palette"),
        "confidence": F.when(has_i, F.least(F.col("conf"), F.coalesce("__score", F.lit(0.0))))
        .when(has_m, F.col("conf") * 0.75).otherwise(F.col("conf")),
        "strength": F.when(has_i, 0.58 * reference_strength).when(has_m, 0.30 * reference_strength)
        .otherwise(0.28 * scene_strength),
        "character_id": F.when(has_i, F.col("char_id"))})
    return d.where(F.col("color").isNotNull()).select(
        "page_id", "region_id", "label", "color", "source", "character_id", "confidence", "strength")


def build_profiles(regions: DataFrame, colors: DataFrame, page_w: int, page_h: int, min_conf: float = 0.20,
                   cell: float = 256.0) -> DataFrame:
    """A profile candidate per coloured hair region, with the best colour of each other attribute.

    Best = greatest area x max(0.1, confidence); the smaller region id wins ties.
    """
    tagged = regions.where((F.col("conf") >= min_conf) & F.col("label").isin("hair", "skin", "eyes", "clothing")) \
        .join(colors.where(F.col("color").isNotNull()), ["page_id", "region_id"])
    hair = tagged.where("label = 'hair'")
    bb = G.body_box(("x", "y", "w", "h"), page_w, page_h)
    a = hair.select("page_id", F.col("region_id").alias("anchor_id"), F.col("color").alias("hair"),
                    F.col("mean_gray").alias("tone"), (F.col("w") / F.greatest(F.lit(1.0), F.col("h").cast("double"))).alias("aspect"),
                    F.col("frac").alias("area_frac"), *[c.alias(f"b{n}") for c, n in zip(bb, "xywh")])
    cells = cover_cells(a.select("page_id", "anchor_id", "bx", "by", "bw", "bh"),
                        F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"), cell)
    other = tagged.where("label <> 'hair'").select(
        "page_id", "region_id", "label", "color", (F.col("x") + F.col("w") / 2.0).alias("cx"),
        (F.col("y") + F.col("h") / 2.0).alias("cy"), (F.col("area") * F.greatest(F.lit(0.1), F.col("conf"))).alias("score"))
    hit = point_cell(other, F.col("cx"), F.col("cy"), cell).join(cells, ["page_id", "__cx", "__cy"]).where(
        G.contains(("bx", "by", "bw", "bh"), "cx", "cy"))
    best = hit.groupBy("page_id", "anchor_id", "label").agg(
        F.max_by("color", F.struct("score", -F.col("region_id"))).alias("color"))
    wide = best.groupBy("page_id", "anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "color"))).alias("rest"))
    d = a.join(wide, ["page_id", "anchor_id"], "left")
    colors_map = F.map_concat(F.create_map(F.lit("hair"), F.col("hair")),
                              F.coalesce("rest", F.create_map().cast("map<string,string>")))
    return d.select("page_id", "anchor_id", "tone", "aspect", "area_frac", colors_map.alias("colors"))


# --- reports -----------------------------------------------------------------

def counts_by_source(hints: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    return hints.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("hints"))


def workspace_stats(pages: DataFrame, colored: Column, keys: Sequence[str] = ()) -> DataFrame:
    s = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(colored).alias("colored"))
    pending = F.greatest(F.lit(0), F.col("total") - F.col("colored"))
    state = F.when(F.col("total") <= 0, "empty").when(pending > 0, "pending").otherwise("done")
    return s.select(*keys, "total", "colored", pending.alias("pending"), state.alias("state"))


# Tolerated Lab drift per attribute.
DRIFT_LIMITS = {"eyes": 16.0, "clothing": 20.0, "skin": 18.0, "hair": 24.0}


def drift_rows(assignments: DataFrame, observed: DataFrame) -> DataFrame:
    """Lab distance of locked regions' observed medians to their targets, with the alert flag.

    ``observed``: page_id, region_id, med_r, med_g, med_b. Target columns: t_r, t_g, t_b.
    """
    locked = assignments.where("lock_allowed")
    obs = observed.select("page_id", "region_id", *[F.col(f"med_{c}").cast("int").alias(f"o_{c}") for c in "rgb"])
    d = locked.join(obs, ["page_id", "region_id"])
    d = C.with_lab(C.with_lab(d, ("t_r", "t_g", "t_b"), ("tl", "ta", "tb")), ("o_r", "o_g", "o_b"), ("ol", "oa", "ob"))
    limit = F.lit(24.0)
    for k, v in DRIFT_LIMITS.items():
        limit = F.when(F.col("attribute") == k, v).otherwise(limit)
    dist = C.lab_distance(("tl", "ta", "tb"), ("ol", "oa", "ob"))
    return d.withColumn("delta_e", dist).withColumn("alert", dist > limit).drop("tl", "ta", "tb", "ol", "oa", "ob")


def drift_report(assignments: DataFrame, observed: DataFrame, profiles: DataFrame, n: int | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Per character: activity, attributes, part counts, alerts, worst drift, in rank order; ``n`` keeps the first.

    Without any assignment the profiles are listed plainly.
    """
    keys = list(keys)
    group = [*keys, "char_id"]
    lib = measured_broadcast(profiles.select("char_id", "name").distinct())
    act = assignments.join(lib, "char_id", "left_semi").groupBy(*group).agg(
        F.count(F.lit(1)).alias("active_regions"), F.count_if("lock_allowed").alias("locked_regions"),
        F.array_sort(F.collect_set("attribute")).alias("attributes"),
        *[F.count_if((F.col("attribute") == "clothing") & (F.col("part") == p)).alias(f"part_{p}")
          for p in ("upper", "lower", "accessory")])
    drift = drift_rows(assignments, observed).groupBy(*group).agg(
        F.count_if("alert").alias("drift_alerts"), F.max("delta_e").alias("max_delta_e"))
    d = act.join(drift, group, "left").fillna({"drift_alerts": 0, "max_delta_e": 0.0})
    d = d.join(lib, "char_id").withColumn("max_delta_e", C.round_even("max_delta_e", 1))
    order = [F.desc("drift_alerts"), F.desc("locked_regions"), F.desc("active_regions"), F.asc("char_id")]
    cut = lambda rows: rows if n is None else rows.limit(n)
    if keys:
        return d if n is None else first_per_group(d, keys, order, n)
    blank = [F.lit(0).cast(d.schema[c].dataType).alias(c) if c != "attributes" else
             F.array().cast("array<string>").alias(c) for c in d.columns if c not in ("char_id", "name")]
    # The plain list stands only where not one profile is active: one row decides.
    some = act.select(F.lit(True).alias("__some")).limit(1)
    plain = profiles.select("char_id", "name", *blank).select(*d.columns).join(F.broadcast(some), F.col("__some"), "left_anti")
    return d.unionByName(plain).orderBy(*order).transform(cut)
