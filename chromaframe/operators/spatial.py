"""Joins by place: points, boxes, masks and runs of one page.

Every join carries the page plus a pixel or a grid cell, so the rows of one busy page
spread over many keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions import geometry as G
from chromaframe.functions import vectors as V
from chromaframe.functions.color import clip
from chromaframe.functions.points import MANUAL_SOURCES, remap_to_crop
from chromaframe.scale import cover_cells, cut_lineage, first_per_group, point_cell


def label_runs(labels: DataFrame) -> DataFrame:
    """Horizontal runs of one region: page_id, y, region_id, x0, x1. One image row is sorted at a time."""
    row = W.partitionBy("page_id", "y", "region_id").orderBy("x")
    p = labels.where("region_id > 0").select("page_id", "y", "region_id", "x", (F.col("x") - F.row_number().over(row)).alias("__g"))
    return p.groupBy("page_id", "y", "region_id", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__g")


def points_to_regions(points: DataFrame, labels: DataFrame, radius: int = 24, near: int = 4, width: int = 64) -> DataFrame:
    """Region under a point; a point off every region snaps to the nearest one.

    Regions within +4 of the smallest squared distance compete by smaller area, then
    lower id. ``points``: page_id, point_id, x, y.

    The distance is separable: in one image row the nearest pixel of a run is known from its ends, so a point asks
    its rows for runs in reach instead of asking for pixels. Off-region points first look ``near`` pixels around;
    only those that this cannot settle look through the whole window.
    """
    runs = cut_lineage(label_runs(labels))
    area = runs.groupBy("page_id", "region_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    under = cut_lineage(points.join(labels.select("page_id", "x", "y", "region_id"), ["page_id", "x", "y"]))
    on = under.where("region_id > 0").select("page_id", "point_id", "region_id")
    off = under.where("region_id = 0").select("page_id", "point_id", "x", "y")
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))
    solid = runs.select("page_id", F.col("y").alias("py"), "region_id", "x0", "x1", bucket(F.col("x0"), F.col("x1")).alias("cell"))

    def around(p, r):
        rows = p.withColumn("dy", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn("py", F.col("y") + F.col("dy"))
        w = rows.withColumn("cell", bucket(F.col("x") - r, F.col("x") + r)).join(solid, ["page_id", "py", "cell"])
        w = w.withColumn("dx", F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0))).where(F.col("dx") <= r)
        return w.groupBy("page_id", "point_id", "region_id").agg(F.min(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"))

    def settle(best):
        best = cut_lineage(best)
        floor = best.groupBy("page_id", "point_id").agg(F.min("d2").alias("__d"))
        pick = best.join(floor, ["page_id", "point_id"]).where(F.col("d2") <= F.col("__d") + 4)
        pick = pick.join(area, ["page_id", "region_id"])
        return pick.groupBy("page_id", "point_id").agg(
            F.min_by("region_id", F.struct("area", "region_id")).alias("region_id"), F.min("__d").alias("__d"))
    close = cut_lineage(settle(around(off, near)).where(F.col("__d") + 4 <= near * near).select("page_id", "point_id", "region_id"))
    rest = off.join(close, ["page_id", "point_id"], "left_anti")
    far = settle(around(rest, radius)).select("page_id", "point_id", "region_id")
    found = on.unionByName(close).unionByName(far)
    return points.join(found, ["page_id", "point_id"], "left").fillna({"region_id": 0})


def hints_to_tiles(hints: DataFrame, tiles: DataFrame, page_w: int, page_h: int, cell: float = 256.0) -> DataFrame:
    """Copy each hint into every tile that contains it, in the tile's coordinates."""
    t = tiles.select("page_id", "tile_id", *[F.col(a).alias(b) for a, b in (
        ("x", "tx"), ("y", "ty"), ("width", "tw"), ("height", "th"))])
    t = cover_cells(t, F.col("tx"), F.col("ty"), F.col("tw"), F.col("th"), cell)
    h = point_cell(hints, F.col("x_norm") * page_w, F.col("y_norm") * page_h, cell)
    d = h.join(t, ["page_id", "__cx", "__cy"])
    return remap_to_crop(d, ("tx", "ty", "tw", "th"), page_w, page_h).select(*hints.columns, "tile_id")


def suppress_near(auto: DataFrame, manual: DataFrame, floor: float = 0.012) -> DataFrame:
    """Drop automatic points within max(0.012, r1 + r2) of a manual point of the page.

    Points belong to size classes by twice their radius. Two points meet in the grid of the larger class, where
    the one of that class visits nine cells and the other its own, so one wide point does not
    make cells wide for all. Whether a point goes depends on its place and radius alone.
    """
    size = lambda k: F.pow(F.lit(2.0), k) * floor
    cls = lambda r: F.ceil(F.log2(F.greatest(F.lit(floor), F.col(r) * 2) / floor)).cast("int")
    place = ["page_id", "x_norm", "y_norm", "radius_norm"]
    a = auto.select(*place).distinct().withColumn("k", cls("radius_norm"))
    m = manual.select("page_id", F.col("x_norm").alias("mx"), F.col("y_norm").alias("my"), F.col("radius_norm").alias("mr")).distinct().withColumn("mk", cls("mr"))
    kinds = lambda d, k, name: d.groupBy("page_id").agg(F.collect_set(k).alias(name))  # noqa: E731  a few classes
    around = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def cell(d, x, y, wide):
        d = d.select("*", F.inline(around)) if wide else d.withColumns({"di": F.lit(0), "dj": F.lit(0)})
        return d.withColumns({"cx": F.floor(F.col(x) / size(F.col("grid"))) + F.col("di"), "cy": F.floor(F.col(y) / size(F.col("grid"))) + F.col("dj")}).drop("di", "dj")
    grids = lambda d, other, k, name, at_least: d.join(kinds(other, name, "ks"), "page_id").withColumn("grid", F.explode(F.filter("ks", at_least))).drop("ks")
    pairs = [(cell(grids(a, m, "k", "mk", lambda g: g >= F.col("k")), "x_norm", "y_norm", False), cell(m.withColumn("grid", F.col("mk")), "mx", "my", True)),
             (cell(a.withColumn("grid", F.col("k")), "x_norm", "y_norm", True), cell(grids(m, a, "mk", "k", lambda g: g > F.col("mk")), "mx", "my", False))]
    dx, dy = F.col("x_norm") - F.col("mx"), F.col("y_norm") - F.col("my")
    rad = F.greatest(F.lit(floor), F.col("radius_norm") + F.col("mr"))
    near = [p.join(q, ["page_id", "grid", "cx", "cy"]).where(dx * dx + dy * dy <= rad * rad).select(*place) for p, q in pairs]
    return auto.join(near[0].unionByName(near[1]).distinct(), place, "left_anti").select(*auto.columns)


def pair_regions(candidates: DataFrame, anchors: DataFrame, cell: float = 256.0) -> DataFrame:
    """Best pair of small regions inside each anchor's head box.

    Pairs must differ by at least 12 % of the box width and at most 12 % of its height;
    cost = level offset / height + 0.25 x size imbalance. Candidates of an anchor meet
    only within neighbouring height bands.
    """
    box = ("bx", "by", "bw", "bh")
    a = anchors.select("page_id", "anchor_id", *[F.col(c).alias(b) for c, b in zip("xywh", box)])
    a = cover_cells(a, *[F.col(b) for b in box], cell)
    c = candidates.where((F.col("frac") <= 0.006) & (F.col("area") >= 3) & F.col("mean_gray").between(25, 225)
                         & (F.col("w") / F.greatest(F.lit(1), F.col("h"))).between(0.25, 4.0))
    c = c.select("page_id", "region_id", "area", (F.col("x") + F.col("w") / 2.0).alias("cx"),
                 (F.col("y") + F.col("h") / 2.0).alias("cy"))
    d = point_cell(c, F.col("cx"), F.col("cy"), cell).join(a, ["page_id", "__cx", "__cy"])
    d = d.where((F.col("region_id") != F.col("anchor_id"))
                & F.col("cx").between(F.col("bx") + F.col("bw") * 0.08, F.col("bx") + F.col("bw") * 0.92)
                & F.col("cy").between(F.col("by") + F.col("bh") * 0.25, F.col("by") + F.col("bh") * 0.70))
    # Copies at one spot with one area can never pair with each other: keep the lowest id.
    d = d.groupBy("page_id", "anchor_id", "bw", "bh", "cx", "cy", "area").agg(F.min("region_id").alias("region_id"))
    d = d.withColumn("band", F.floor(F.col("cy") / (F.col("bh") * 0.12)).cast("long"))
    left = d.select("page_id", "anchor_id", "bw", "bh", F.col("region_id").alias("r1"), F.col("cx").alias("x1"),
                    F.col("cy").alias("y1"), F.col("area").alias("a1"),
                    F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = d.select("page_id", "anchor_id", "band", F.col("region_id").alias("r2"), F.col("cx").alias("x2"),
                     F.col("cy").alias("y2"), F.col("area").alias("a2"))
    level = F.abs(F.col("y1") - F.col("y2"))
    p = left.join(right, ["page_id", "anchor_id", "band"]).where(
        (F.col("r1") < F.col("r2")) & (F.abs(F.col("x1") - F.col("x2")) >= F.col("bw") * 0.12) & (level <= F.col("bh") * 0.12))
    cost = level / F.greatest(F.lit(1), F.col("bh")) + F.abs(F.col("a1") - F.col("a2")) / F.greatest("a1", "a2") * 0.25
    p = p.withColumn("cost", F.round(cost, 9))
    best = p.groupBy("page_id", "anchor_id").agg(F.min(F.struct("cost", "r1", "r2")).alias("b"))
    return best.select("page_id", "anchor_id", F.col("b.r1").alias("first_id"), F.col("b.r2").alias("second_id"),
                       F.col("b.cost").alias("cost"))


# Regions kept per face attribute.
KEEP_PER_FACE = {"hair": 5, "skin": 4, "eyes": 2, "clothing": 5}


def attach_regions(regions: DataFrame, faces: DataFrame, page_w: int, page_h: int, cell: float = 256.0) -> DataFrame:
    """Containment rules attach regions to hair / skin / eyes / clothing of a face."""
    face = ("x", "y", "w", "h")
    hb, bb = G.head_box_from_face(face, page_w, page_h), G.body_box_from_face(face, page_w, page_h)
    f = faces.select("page_id", "face_id", *[F.col(c).alias(f"f{c}") for c in face],
                     *[c.alias(f"h{n}") for c, n in zip(hb, "xywh")], *[c.alias(f"b{n}") for c, n in zip(bb, "xywh")])
    x0, y0 = F.least("fx", "hx", "bx"), F.least("fy", "hy", "by")
    x1 = F.greatest(F.col("fx") + F.col("fw"), F.col("hx") + F.col("hw"), F.col("bx") + F.col("bw"))
    y1 = F.greatest(F.col("fy") + F.col("fh"), F.col("hy") + F.col("hh"), F.col("by") + F.col("bh"))
    f = cover_cells(f, x0, y0, x1 - x0, y1 - y0, cell)
    r = regions.where("area >= 3").select("page_id", "region_id", "area", "frac", "mean_gray",
                                          (F.col("x") + F.col("w") / 2.0).alias("cx"), (F.col("y") + F.col("h") / 2.0).alias("cy"))
    d = point_cell(r, F.col("cx"), F.col("cy"), cell).join(f, ["page_id", "__cx", "__cy"])
    one = F.lit(1.0)
    nx = F.abs(F.col("cx") - (F.col("fx") + F.col("fw") * 0.5)) / F.greatest(one, F.col("fw") * 0.5)
    ny = (F.col("cy") - F.col("fy")) / F.greatest(one, F.col("fh").cast("double"))
    in_face = G.contains(("fx", "fy", "fw", "fh"), "cx", "cy")
    in_head, in_body = G.contains(("hx", "hy", "hw", "hh"), "cx", "cy"), G.contains(("bx", "by", "bw", "bh"), "cx", "cy")
    d = d.withColumns({"nx": nx, "ny": ny, "in_face": in_face, "in_head": in_head, "in_body": in_body})
    g, frac = F.col("mean_gray"), F.col("frac")
    eyes = F.col("in_face") & F.col("ny").between(0.20, 0.68) & (F.col("nx") <= 0.92) & (frac <= 0.007) & (g < 225)
    skin = F.col("in_face") & ~eyes & F.col("ny").between(0.08, 1.05) & (F.col("nx") <= 0.95) & g.between(45, 252)
    core = (F.col("cx").between(F.col("fx") + F.col("fw") * 0.15, F.col("fx") + F.col("fw") * 0.85)
            & F.col("cy").between(F.col("fy") + F.col("fh") * 0.18, F.col("fy") + F.col("fh") * 0.92))
    hair = F.col("in_head") & ~core & (g < 238) & (frac <= 0.09)
    cloth = (F.col("in_body") & (F.col("cy") > F.col("fy") + F.col("fh") * 0.72) & ~F.col("in_head")
             & g.between(25, 250) & (frac <= 0.12))
    tags = F.array(*[F.when(c, F.lit(n)) for n, c in (("eyes", eyes), ("skin", skin), ("hair", hair), ("clothing", cloth))])
    d = d.select("page_id", "face_id", "region_id", "area", F.explode(F.filter(tags, lambda v: v.isNotNull())).alias("attribute"))
    top = first_per_group(d, ["page_id", "face_id", "attribute"], [F.desc("area"), F.desc("region_id")],
                          max(KEEP_PER_FACE.values()), "rank")
    keep = F.lit(0)
    for k, v in KEEP_PER_FACE.items():
        keep = F.when(F.col("attribute") == k, v).otherwise(keep)
    return top.where(F.col("rank") <= keep)


def parent_score(item, head, body) -> Column:
    """How likely a box belongs to one head and body."""
    x, y, w, h = (C._c(v) for v in item)
    hx, hy, hw, hh = (C._c(v) for v in head)
    bx, by, bw, bh = (C._c(v) for v in body)
    cx, cy, one = x + w * 0.5, y + h * 0.5, F.lit(1.0)
    inside = cx.between(bx - bw * 0.08, bx + bw * 1.08) & cy.between(hy - hh * 0.22, by + bh)
    dx = F.abs(cx - (hx + hw * 0.5)) / F.greatest(one, bw * 0.60)
    dy = F.greatest(F.lit(0.0), cy - (hy + hh * 0.45)) / F.greatest(one, bh * 0.82)
    return (F.when(G.bbox_near(item, head, 0.95), 3.0).otherwise(0.0)
            + F.when(G.bbox_near(item, body, 0.18), 0.95).otherwise(0.0)
            + F.when(inside, 0.8).otherwise(0.0) - dx * 0.55 - dy * 0.20)


def best_parent(items: DataFrame, parents: DataFrame, min_score: float = 0.85, cell: float = 256.0) -> DataFrame:
    """Best head/body per item at or above ``min_score``.

    Reaching 0.85 needs contact with the padded head or body, so only boxes that share a
    grid cell with those are scored, in the first of the cells they share. ``parents``: parent_id and boxes h*, b*.
    Tables of a few MB give many rows here, so no side is broadcast by the size of its source.
    """
    head, body = ("hx", "hy", "hw", "hh"), ("bx", "by", "bw", "bh")
    hp, bp = F.greatest("hw", "hh") * 0.95, F.greatest("bw", "bh") * 0.18
    x0 = F.least(F.col("hx") - hp, F.col("bx") - bp)
    y0 = F.least(F.col("hy") - hp, F.col("by") - bp)
    x1 = F.greatest(F.col("hx") + F.col("hw") + hp, F.col("bx") + F.col("bw") + bp)
    y1 = F.greatest(F.col("hy") + F.col("hh") + hp, F.col("by") + F.col("bh") + bp)
    first = lambda x, y, side: {f"__{side}x": F.floor(x / cell).cast("long"), f"__{side}y": F.floor(y / cell).cast("long")}
    p = cover_cells(parents.withColumns(first(x0, y0, "p")), x0, y0, x1 - x0, y1 - y0, cell)
    i = items.select("page_id", "item_id", "x", "y", "w", "h").withColumns(first(F.col("x"), F.col("y"), "i"))
    i = cover_cells(i, F.col("x"), F.col("y"), F.col("w"), F.col("h"), cell)
    once = (F.col("__cx") == F.greatest("__px", "__ix")) & (F.col("__cy") == F.greatest("__py", "__iy"))
    d = i.join(p.hint("merge"), ["page_id", "__cx", "__cy"]).where(once).withColumn(
        "score", F.round(parent_score(("x", "y", "w", "h"), head, body), 9)).where(F.col("score") >= min_score)
    return d.groupBy("page_id", "item_id").agg(
        F.max_by("parent_id", F.struct("score", -F.col("parent_id"))).alias("parent_id"), F.max("score").alias("score"))


def parent_groups(items: DataFrame, owned: DataFrame) -> DataFrame:
    """One merged group per parent: box union, sums, best score plus size bonus."""
    x, y, w, h = G.bbox_union(("x", "y", "w", "h"))
    return (items.join(owned.select("page_id", "item_id", "parent_id").hint("merge"), ["page_id", "item_id"])
            .groupBy("page_id", "parent_id").agg(
                x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.sum("area").alias("area"),
                F.count(F.lit(1)).alias("members"),
                (F.max("item_score") + F.lit(1.6) + F.count(F.lit(1)) * 0.12).alias("score")))


def anchor_similarity(regions: DataFrame, anchors: DataFrame, page_diag: float, ink: DataFrame | None = None) -> DataFrame:
    """Best gated cosine of a region to any anchor of its page, 0 without one.

    Gates: centre distance <= 0.34, box gap <= 0.16 of the diagonal, ink ratio <= 0.42.
    ``ink`` is an optional edge table (page_id, region_id, anchor_id, ink_ratio).
    """
    reach = 0.34 * page_diag
    box = ("x", "y", "w", "h")

    def shaped(d, p, ident):
        return d.select("page_id", F.col("region_id").alias(ident), *[F.col(c).alias(p + c) for c in box],
                        F.col("embedding").alias(p + "e"), (F.col("x") + F.col("w") / 2.0).alias(p + "cx"),
                        (F.col("y") + F.col("h") / 2.0).alias(p + "cy"))
    r = point_cell(shaped(regions, "r_", "region_id"), F.col("r_cx"), F.col("r_cy"), reach)
    a = shaped(anchors, "a_", "anchor_id").where(F.col("a_e").isNotNull())
    a = cover_cells(a, F.col("a_cx") - reach, F.col("a_cy") - reach, F.lit(2 * reach), F.lit(2 * reach), reach)
    d = r.join(a, ["page_id", "__cx", "__cy"])
    dx, dy = F.col("r_cx") - F.col("a_cx"), F.col("r_cy") - F.col("a_cy")
    d = d.withColumns({"spatial": F.sqrt(dx * dx + dy * dy) / max(1.0, page_diag),
                       "gap": G.bbox_gap([f"r_{c}" for c in box], [f"a_{c}" for c in box]) / max(1.0, page_diag)})
    d = d.where((F.col("spatial") <= 0.34) & (F.col("gap") <= 0.16))
    if ink is not None:
        d = d.join(ink, ["page_id", "region_id", "anchor_id"], "left")
    ratio = F.coalesce(F.col("ink_ratio"), F.lit(0.0)) if ink is not None else F.lit(0.0)
    sim = clip(V.dot("r_e", "a_e"), -1.0, 1.0)
    edge = clip(F.lit(1.0) - F.greatest(F.lit(0.0), ratio - 0.20) / 0.22, 0.65, 1.0)
    score = sim * (clip(F.lit(1.0) - F.col("spatial") / 0.34, 0.0, 1.0) * 0.20
                   + clip(F.lit(1.0) - F.col("gap") / 0.16, 0.0, 1.0) * 0.12 + 0.68) * edge
    best = d.where(ratio <= 0.42).withColumn("s", score).groupBy("page_id", "region_id").agg(F.max("s").alias("s"))
    return regions.select("page_id", "region_id").join(best, ["page_id", "region_id"], "left").select(
        "page_id", "region_id", clip(F.coalesce("s", F.lit(0.0)), 0.0, 1.0).alias("similarity"))


# --- masks and runs ----------------------------------------------------------

def mask_overlap(labels: DataFrame, masks: Sequence[str], region: str = "region_id") -> DataFrame:
    """Covered share of each region per mask column."""
    return labels.where(F.col(region) > 0).groupBy("page_id", region).agg(
        F.count(F.lit(1)).alias("area"), *[F.count_if(F.col(m) > 0).alias(f"{m}_pixels") for m in masks],
        *[(F.count_if(F.col(m) > 0) / F.count(F.lit(1))).alias(f"{m}_share") for m in masks])


def snap_to_regions(labels: DataFrame, mask: str, region: str = "region_id", min_overlap: float = 0.34,
                    max_area: float = 0.16, max_growth: float = 1.55) -> DataFrame:
    """Grow a prior to the line-bounded regions it mostly covers; one row per kept pixel.

    A page whose growth exceeds its budget keeps the prior alone.
    """
    page = labels.groupBy("page_id").agg(F.count(F.lit(1)).alias("__page"), F.count_if(F.col(mask) > 0).alias("__before"))
    r = mask_overlap(labels, [mask], region).join(page, "page_id")
    n, area = F.col(f"{mask}_pixels"), F.col("area")
    gate = F.when(area >= 80, min_overlap).otherwise(max(0.24, min_overlap - 0.08))
    ok = ((area <= F.col("__page") * max_area) & (F.col(f"{mask}_share") >= gate)
          & (n >= F.greatest(F.lit(5), (area * 0.20).cast("int"))))
    r = r.where(ok).select("page_id", region, (area - n).alias("__gain"), "__before")
    growth = r.groupBy("page_id").agg(F.sum("__gain").alias("__gain"), F.first("__before").alias("__before"))
    budget = F.floor(F.greatest(F.col("__before") + 16.0, F.col("__before") * max_growth))
    good = growth.where(F.col("__before") + F.col("__gain") <= budget).select("page_id")
    accepted = r.join(good, "page_id", "left_semi").select("page_id", region, F.lit(True).alias("__acc"))
    d = labels.join(accepted, ["page_id", region], "left")
    return d.where((F.col(mask) > 0) | F.coalesce("__acc", F.lit(False))).withColumn(
        "added", F.col(mask) == 0).drop("__acc")


def compare_runs(px: DataFrame, mask: str, target, leaks: Sequence[str] = (), keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Before/after report of one run: changed shares in and out of the mask, distances to a target."""
    d = C.with_lab(C.with_lab(px, out=("bl", "ba", "bb")), ("r2", "g2", "b2"), ("al", "aa", "ab"))
    lin = px.sparkSession.range(1).select(*[F.lit(int(v)).alias(c) for c, v in zip("rgb", target)])
    tl = C.with_lab(lin).first()
    goal = [F.lit(float(tl[c])) for c in ("lab_l", "lab_a", "lab_b")]
    delta = F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in zip(("r2", "g2", "b2"), "rgb")])
    d = d.withColumns({"__in": F.col(mask) > 0, "__ch": delta > 1, "__before": C.lab_distance(("bl", "ba", "bb"), goal),
                       "__after": C.lab_distance(("al", "aa", "ab"), goal)})
    better = F.col("__after") + 0.5 < F.col("__before")
    n_in = F.count_if("__in")
    pct = lambda hit, n: F.try_divide(F.count_if(hit) * 100.0, n)
    aggs = [n_in.alias("mask_pixels"), pct(better & F.col("__in"), n_in).alias("coverage_percent"),
            pct(F.col("__ch") & F.col("__in"), n_in).alias("changed_percent"),
            F.expr("avg(__before) FILTER (WHERE __in)").alias("delta_e_before"),
            F.expr("avg(__after) FILTER (WHERE __in)").alias("delta_e_after"),
            F.count_if(F.col("__in") & ~F.col("__ch")).alias("unchanged_inside"),
            F.count_if(F.col("__ch") & ~F.col("__in")).alias("outside_changed"),
            pct(F.col("__ch") & ~F.col("__in"), F.greatest(F.lit(1), F.count_if(~F.col("__in")))).alias("outside_percent")]
    for m in leaks:
        hit = F.col(m) > 0
        aggs += [F.count_if(hit).alias(f"{m}_pixels"), pct(F.col("__ch") & hit, F.count_if(hit)).alias(f"{m}_leak_percent")]
    return d.groupBy(*keys).agg(*aggs)


def candidate_evidence(px: DataFrame, positive: str, negative: str, target, tolerance: float = 8.0,
                       keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Change and target-distance evidence at reviewed positive and negative pixels."""
    d = C.with_lab(C.with_lab(px, out=("bl", "ba", "bb")), ("r2", "g2", "b2"), ("al", "aa", "ab"))
    tl = C.with_lab(px.sparkSession.range(1).select(*[F.lit(int(v)).alias(c) for c, v in zip("rgb", target)])).first()
    goal = [F.lit(float(tl[c])) for c in ("lab_l", "lab_a", "lab_b")]
    d = d.withColumns({"__d": F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in zip(("r2", "g2", "b2"), "rgb")]),
                       "__gain": C.lab_distance(("bl", "ba", "bb"), goal) - C.lab_distance(("al", "aa", "ab"), goal)})
    avg = lambda v, m: F.expr(f"avg({v}) FILTER (WHERE {m} > 0)")
    return d.groupBy(*keys).agg(
        F.count_if(F.col("__d") > tolerance).alias("changed_pixels"), F.avg("__d").alias("mean_change"),
        avg("__d", positive).alias("positive_change"), avg("__d", negative).alias("negative_change"),
        F.count_if((F.col("__d") > tolerance) & (F.col(negative) > 0)).alias("negative_changed"),
        avg("__gain", positive).alias("target_gain"))


def agreement(px: DataFrame, base, a, b, rough: str, negative: str, positive: str | None = None,
              threshold: float = 10.0, mode: str = "agreement") -> DataFrame:
    """Pixel confidence from two prompted runs against a baseline, with the keep decision."""
    def dist(p):
        return F.sqrt(sum(((F.col(u) - F.col(v)) * (F.col(u) - F.col(v)) for u, v in zip(p, base)), F.lit(0)).cast("double"))
    conf = F.least(dist(a), dist(b)) if mode == "agreement" else dist(a)
    d = px.withColumn("confidence", conf).withColumn("raw", F.col("confidence") > threshold)
    return d.withColumn("selected", F.col("raw") & (F.col(rough) > 0) & (F.col(negative) == 0))


def agreement_counts(d: DataFrame, rough: str, negative: str, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    inside = F.col("raw") & (F.col(rough) > 0)
    return d.groupBy(*keys).agg(
        F.count_if(F.col(rough) > 0).alias("rough_pixels"), F.count_if("raw").alias("raw_pixels"),
        F.count_if("selected").alias("candidate_pixels"), F.count_if(F.col("raw") & (F.col(rough) == 0)).alias("removed_outside"),
        F.count_if(inside & (F.col(negative) > 0)).alias("removed_negative"))


# Sources that apply to the whole page.
GLOBAL_SOURCES = ("global", "global_manual")


def points_in_selection(points: DataFrame, selection: DataFrame, expanded: DataFrame, width: int, height: int,
                        only_inside: bool = True) -> DataFrame:
    """Add ``keep``: global sources always, others when their pixel is in the widened selection.

    Once a manual point is kept on a page, automatic points inside the selection are dropped.
    ``selection`` and ``expanded`` hold page_id, x, y.
    """
    at = points.withColumns({"x": clip(F.bround(F.col("x_norm") * (width - 1)), 0.0, width - 1.0).cast("int"),
                             "y": clip(F.bround(F.col("y_norm") * (height - 1)), 0.0, height - 1.0).cast("int")})
    flag = lambda d, n: d.select("page_id", "x", "y").distinct().withColumn(n, F.lit(True))
    d = at.join(flag(selection, "__in"), ["page_id", "x", "y"], "left").join(flag(expanded, "__near"), ["page_id", "x", "y"], "left")
    hit = F.coalesce("__near", F.lit(False)) | F.lit(not only_inside)
    d = d.withColumns({"__keep": F.col("source").isin(*GLOBAL_SOURCES) | hit, "__manual": F.col("source").isin(*MANUAL_SOURCES)})
    local = d.where("__keep AND __manual").select("page_id").distinct().withColumn("__local", F.lit(True))
    d = d.join(local, "page_id", "left")
    stale = ~F.col("__manual") & F.coalesce("__local", F.lit(False)) & F.coalesce("__in", F.lit(False))
    return d.withColumn("keep", F.col("__keep") & ~stale).select(*points.columns, "x", "y", "keep")


def count_in_selection(kept: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    return kept.groupBy(*keys).agg(F.count_if("keep").alias("points_in"), F.count_if(~F.col("keep")).alias("points_out"))


def delete_in_selection(points: DataFrame, selection: DataFrame, width: int, height: int) -> DataFrame:
    """Remove manual points whose pixel is selected."""
    at = points.withColumns({"x": clip(F.bround(F.col("x_norm") * (width - 1)), 0.0, width - 1.0).cast("int"),
                             "y": clip(F.bround(F.col("y_norm") * (height - 1)), 0.0, height - 1.0).cast("int")})
    sel = selection.select("page_id", "x", "y").distinct().withColumn("__m", F.lit(True))
    return at.join(sel, ["page_id", "x", "y"], "left").where(
        F.col("__m").isNull() | ~F.col("source").isin(*MANUAL_SOURCES)).select(*points.columns)


# --- work tracking -----------------------------------------------------------

def settings_key(cols: dict[str, int | None]) -> Column:
    """Fingerprint of columns; numeric ones are rounded to the given digits first."""
    parts = [F.round(F.col(c), n).cast("string") if n is not None else F.col(c).cast("string") for c, n in cols.items()]
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("\u0000")) for p in parts]), 256)


def pending(inputs: DataFrame, results: DataFrame, key_cols: dict[str, int | None]) -> DataFrame:
    """Inputs with no result under the same content-and-settings fingerprint."""
    done = results.select(settings_key(key_cols).alias("__key"))
    return inputs.withColumn("__key", settings_key(key_cols)).join(done, "__key", "left_anti").drop("__key")


def commit_if_unchanged(current: DataFrame, results: DataFrame, keys: Sequence[str] = ("page_id", "layer")) -> DataFrame:
    """Results flagged ``accepted`` when the revision they came from is still current."""
    now = current.select(*keys, F.col("revision").alias("__now"))
    return (results.join(now, list(keys), "left")
            .withColumn("accepted", F.coalesce(F.col("revision") == F.col("__now"), F.lit(False))).drop("__now"))
