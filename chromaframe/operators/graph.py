"""Graph operators: connected components, box clusters, region adjacency, merging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.functions import geometry as G
from chromaframe.operators.windows import dense_relabel
from chromaframe.scale import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node per node, by alternating large-star and small-star rounds.

    Both steps are grouped minima plus one join; every round starts from checkpointed
    edges and the loop ends when a round changes nothing.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    e = cut_lineage(e)

    def signature(d):
        r = d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)
    before = signature(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b")))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        e = cut_lineage(small)
        after = signature(e)
        if after == before:
            break
        before = after
    root = e.groupBy("a").agg(F.min("b").alias("__root"))
    return nodes.join(root, F.col(node) == F.col("a"), "left").select(
        *nodes.columns, F.coalesce("__root", node).alias("component"))


def fill_runs(px: DataFrame, fill: str = "fillable") -> DataFrame:
    """Horizontal runs of fillable pixels: page_id, y, x0, x1. One image row is sorted at a time."""
    row = W.partitionBy("page_id", "y").orderBy("x")
    p = px.where(F.col(fill) > 0).select("page_id", "x", "y", (F.col("x") - F.row_number().over(row)).alias("__g"))
    return p.groupBy("page_id", "y", "__g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__g")


def run_contacts(runs: DataFrame, reach: int = 0, width: int = 64) -> DataFrame:
    """Runs (``a`` above ``b``) of neighbouring rows that overlap, up to ``reach`` pixels apart.

    An interval join: runs meet in the ``width``-pixel buckets both cover, and a pair counts in the first of them only.
    """
    low, high = F.floor((F.col("x0") - reach) / width), F.floor((F.col("x1") + reach) / width)
    above = runs.select("page_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.explode(F.sequence(low, high)).alias("bucket"))
    below = runs.select("page_id", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"),
                        F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))).alias("bucket"))
    first = F.floor(F.greatest(F.col("a0") - reach, F.col("b0")) / width)
    met = above.join(below, ["page_id", "y", "bucket"]).where(
        (F.col("a0") - reach <= F.col("b1")) & (F.col("b0") <= F.col("a1") + reach) & (F.col("bucket") == first))
    return met.select(F.struct("page_id", (F.col("y") - 1).alias("y"), F.col("a0").alias("x0")).alias("a"), F.struct("page_id", "y", F.col("b0").alias("x0")).alias("b"))


def label_regions(px: DataFrame, connectivity: int = 4, fill: str = "fillable") -> DataFrame:
    """Components of the fillable grid; a component is named by its first pixel in row order.

    Pixels first shrink to horizontal runs (one image row at a time). Runs are the nodes, an interval
    join of neighbouring rows gives the edges, and pixels come back only at the end, from their runs.
    """
    runs = cut_lineage(fill_runs(px, fill))
    edges = run_contacts(runs, 0 if connectivity == 4 else 1).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = connected_components(runs.select(F.struct("page_id", "y", "x0").alias("id"), "x1"), edges)
    return comp.select("id.page_id", F.explode(F.sequence("id.x0", "x1")).alias("x"), "id.y", F.col("component.y").alias("root_y"), F.col("component.x0").alias("root_x"))


def _boxes_near(a: Column, b: Column) -> Column:
    """Whether two box structs are near; the box with the lower id is the first of the rule."""
    def rule(p, q):
        kin = F.coalesce(p["parent"] == q["parent"], F.lit(False))
        big = F.greatest(p["side"], q["side"])
        loose = (F.abs(p["cx"] - q["cx"]) <= big * 1.08) & (F.abs(p["cy"] - q["cy"]) <= big * 0.96)
        box = lambda v: tuple(v[c] for c in "xywh")
        return F.when(kin, G.bbox_near(box(p), box(q), 1.05)).otherwise(G.bbox_near(box(p), box(q), 0.72) | loose)
    return F.when(a["id"] < b["id"], rule(a, b)).otherwise(rule(b, a))


def box_clusters(boxes: DataFrame) -> DataFrame:
    """Boxes with ``cluster_id``, the smallest box of those that chains of near boxes connect on a page.

    Boxes of one size class whose centres share a small cell are near by definition: they are one spot, and spots are the
    nodes. Two spots meet in a grid as coarse as the larger one's class, where it visits nine cells and the other its own.
    Their extreme boxes are compared first, in the row; only pairs of spots that are still in
    different components are then compared box by box. ``boxes``: page_id, box_id, x, y, w, h, parent (nullable).
    """
    side = F.greatest("w", "h").cast("double")
    cls = F.floor(F.log2(F.greatest(side, F.lit(1.0)))).cast("int")
    step = F.pow(F.lit(2.0), cls) * 0.9
    b = boxes.withColumns({"cx": F.col("x") + F.col("w") * 0.5, "cy": F.col("y") + F.col("h") * 0.5, "side": side})
    b = b.withColumn("spot", F.struct(cls.alias("k"), F.floor(F.col("cx") / step).alias("i"), F.floor(F.col("cy") / step).alias("j")))
    shape = ["page_id", "x", "y", "w", "h", "parent", "cx", "cy", "side", "spot"]
    uniq = cut_lineage(b.groupBy(*shape).agg(F.min("box_id").alias("id")))  # equal boxes are one
    box = F.struct("id", "x", "y", "w", "h", "cx", "cy", "side", "parent")
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ends = [f(box, c) for c in (F.col("x"), F.col("y"), right, low, F.col("cx"), F.col("cy"), F.col("side")) for f in (F.min_by, F.max_by)]
    spots = cut_lineage(uniq.groupBy("page_id", "spot").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(right).alias("x1"), F.max(low).alias("y1"), F.max("side").alias("reach"), F.array_distinct(F.array(*ends)).alias("ends")))
    # Near boxes have centres within 2.05 sides of the larger, a side is below 2^(k + 1), and a box's centre lies
    # within half of that of the middle of its spot.
    size = lambda k: F.pow(F.lit(2.0), k + 1) * 3.2
    at = lambda lo, hi, k: F.floor((F.col(lo) + F.col(hi)) * 0.5 / size(k))
    around = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    grids = spots.groupBy("page_id").agg(F.array_sort(F.collect_set("spot.k")).alias("grids"))  # at most 31 classes
    name = F.struct("page_id", "spot")
    body = ("x0", "y0", "x1", "y1", "reach", "ends")
    own = spots.select(name.alias("a"), "page_id", F.col("spot.k").alias("grid"), F.struct(*body).alias("p"), "x0", "x1", "y0", "y1", F.inline(around))
    own = own.withColumns({"gx": at("x0", "x1", F.col("grid")) + F.col("di"), "gy": at("y0", "y1", F.col("grid")) + F.col("dj")})
    visit = spots.join(grids, "page_id").select(name.alias("b"), "page_id", F.col("spot.k").alias("kb"), F.struct(*body).alias("q"), "x0", "x1", "y0", "y1",
                                                F.explode(F.filter("grids", lambda g: g >= F.col("spot.k"))).alias("grid"))
    visit = visit.withColumns({"gx": at("x0", "x1", F.col("grid")), "gy": at("y0", "y1", F.col("grid"))})
    keys = ["page_id", "grid", "gx", "gy"]
    pad = F.greatest(F.col("p.reach"), F.col("q.reach")) * 1.08
    apart = ((F.col("p.x1") + pad < F.col("q.x0")) | (F.col("q.x1") + pad < F.col("p.x0")) | (F.col("p.y1") + pad < F.col("q.y0")) | (F.col("q.y1") + pad < F.col("p.y0")))
    met = own.select(*keys, "a", "p").join(visit.select(*keys, "b", "kb", "q"), keys).where(((F.col("kb") < F.col("grid")) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & ~apart)
    touch = F.exists("p.ends", lambda u: F.exists("q.ends", lambda v: _boxes_near(u, v)))
    pairs = cut_lineage(met.select("a", "b", touch.alias("near")))
    nodes = spots.select(name.alias("id"))
    comp = cut_lineage(connected_components(nodes, pairs.where("near").select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    left = comp.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    other = comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    open_ = cut_lineage(pairs.where("NOT near").select("a", "b").join(left, "a").join(other, "b").where("ca <> cb"))
    held = uniq.select(name.alias("spot"), box.alias("box"))
    each = open_.join(held.select(F.col("spot").alias("a"), F.col("box").alias("u")), "a").join(held.select(F.col("spot").alias("b"), F.col("box").alias("v")), "b")
    late = each.where(_boxes_near(F.col("u"), F.col("v"))).select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()
    roots = comp.select("component").distinct()
    final = connected_components(roots.select(F.col("component").alias("id")), late).select(F.col("id").alias("component"), F.col("component").alias("root"))
    placed = comp.join(final, "component").select("id.page_id", "id.spot", "root")
    out = b.drop("cx", "cy", "side").join(placed, ["page_id", "spot"])
    lowest = out.groupBy("page_id", "root").agg(F.min("box_id").alias("cluster_id"))
    return out.join(lowest, ["page_id", "root"]).select(*boxes.columns, "cluster_id")


def cluster_boxes(boxes: DataFrame) -> DataFrame:
    """Clusters of boxes that are near each other, with merged box, sums, score and rank on the page.

    ``boxes``: as for ``box_clusters``, with area, score, matched, and perhaps area_fraction and ``face`` (a box struct, whose smallest is kept).
    Rank: matched first, then by score, then by area, then by id.
    """
    d = box_clusters(boxes)
    x, y, w, h = G.bbox_union(("x", "y", "w", "h"))
    more = [F.sum("area_fraction").alias("area_fraction")] if "area_fraction" in boxes.columns else []
    if "face" in boxes.columns:
        more.append(F.min_by("face", F.struct(F.col("face.w") * F.col("face.h"), "box_id")).alias("face"))
    out = d.groupBy("page_id", "cluster_id").agg(
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.sum("area").alias("area"),
        F.max("matched").alias("matched"), F.count(F.lit(1)).alias("members"),
        (F.max("score") + F.count(F.lit(1)) * 0.18 + F.when(F.max("matched"), 0.22).otherwise(0.0)).alias("score"), *more)
    order = [F.desc("matched"), F.desc(F.round("score", 9)), F.desc("area"), "cluster_id"]
    return out.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(*order)))


def region_adjacency(labels: DataFrame, region: str = "region_id") -> DataFrame:
    """Contact of neighbouring regions: pixels of ``dst`` that touch ``src`` (4-neighbours).

    Every pixel announces its region to its neighbours; grouping by pixel then sees at
    most four of them, so no region is gathered in one place.
    """
    p = labels.select("page_id", "x", "y", F.col(region).alias("rid"))
    around = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
                       for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    sent = p.where("rid > 0").select("page_id", F.col("rid").alias("src"), F.inline(around)).select(
        "page_id", "x", "y", "src", F.lit(None).cast(p.schema["rid"].dataType).alias("own"))
    own = p.select("page_id", "x", "y", F.lit(None).cast(p.schema["rid"].dataType).alias("src"), F.col("rid").alias("own"))
    g = sent.unionByName(own).groupBy("page_id", "x", "y").agg(F.max("own").alias("dst"), F.collect_set("src").alias("s"))
    g = g.where("dst > 0").select("page_id", "dst", F.explode("s").alias("src")).where("src <> dst")
    return g.groupBy("page_id", "src", "dst").agg(F.count(F.lit(1)).alias("contact"))


def grow_selection(labels: DataFrame, positive: str, negative: str, prior: str, steps: int = 1,
                   region: str = "region_id") -> DataFrame:
    """Regions accepted or vetoed by strokes and prior, then grown to small similar neighbours.

    One row per region with ``status`` (accepted, grown, vetoed, none). Vetoes always win.
    """
    n = F.count(F.lit(1))
    hit = lambda c: F.count_if(F.col(c) > 0)
    s = labels.where(F.col(region) > 0).groupBy("page_id", F.col(region).alias("rid")).agg(
        n.alias("area"), F.avg("gray").alias("mean"), hit(positive).alias("np"), hit(negative).alias("nn"), hit(prior).alias("nr"))
    share = lambda c: F.col(c) / F.col("area")
    s = s.withColumn("score", F.greatest(share("np") * 4.0, share("nr")))
    veto = (share("nn") >= 0.01) | (F.col("nn") >= 3)
    take = (share("np") >= 0.015) | (F.col("np") >= 2) | (share("nr") >= 0.56)
    s = cut_lineage(s.withColumn("status", F.when(veto, "vetoed").when(take, "accepted").otherwise("none")))
    adj = region_adjacency(labels, region)
    adj = cut_lineage(adj) if steps > 1 else adj
    for i in range(steps):
        own = s.where(F.col("status").isin("accepted", "grown")).select(
            "page_id", F.col("rid").alias("src"), F.col("area").alias("a_area"), F.col("mean").alias("a_mean"))
        cand = s.where("status = 'none' AND score >= 0.18").select("page_id", F.col("rid").alias("dst"), "area", "mean")
        add = adj.join(own, ["page_id", "src"]).join(cand, ["page_id", "dst"]).where(
            (F.col("area") <= F.greatest(F.lit(3000.0), F.col("a_area") * 0.35)) & (F.abs(F.col("mean") - F.col("a_mean")) <= 34))
        add = add.select("page_id", F.col("dst").alias("rid"), F.lit("grown").alias("__g")).distinct()
        s = s.join(add, ["page_id", "rid"], "left").withColumn("status", F.coalesce("__g", "status")).drop("__g")
        if i + 1 < steps:
            s = cut_lineage(s)
    return s.select("page_id", F.col("rid").alias(region), "area", "score", "status")


def contact_patterns(labels: DataFrame, region: str = "region_id") -> DataFrame:
    """Border pixels counted by what they touch: page_id, own, around (sorted other regions, at most 4), n.

    Contact counts of merged regions follow from these patterns, as a pixel that touches both parts counts once.
    """
    p = labels.select("page_id", "x", "y", F.col(region).cast("long").alias("rid"))
    beside = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    none = F.lit(None).cast("long")
    sent = p.where("rid > 0").select("page_id", F.col("rid").alias("near"), F.inline(beside)).select("page_id", "x", "y", "near", none.alias("own"))
    own = p.where("rid > 0").select("page_id", "x", "y", none.alias("near"), F.col("rid").alias("own"))
    g = own.unionByName(sent).groupBy("page_id", "x", "y").agg(F.max("own").alias("own"), F.array_sort(F.collect_set("near")).alias("around"))
    g = g.where("own IS NOT NULL").withColumn("around", F.array_remove("around", F.col("own"))).where(F.size("around") > 0)
    return g.groupBy("page_id", "own", "around").agg(F.count(F.lit(1)).alias("n"))


def _moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with moved regions renamed: they are pending as the region that took them in."""
    for side in ("own", "near"):
        to = moves.select("page_id", F.col("rid").alias(side), F.col("to").alias("__to"))
        edges = edges.join(to, ["page_id", side], "left").withColumns({
            side: F.coalesce("__to.own", side), f"{side}_pending": F.coalesce("__to.waits", f"{side}_pending")}).drop("__to")
    return edges.where("own <> near")


def merge_tiny(labels: DataFrame, max_area: int = 220, max_rounds: int = 6, region: str = "region_id") -> DataFrame:
    """Fragments up to ``max_area`` join the neighbour with most contact, one after another by id; then ids turn dense.

    In every round the fragments of its start merge in the order of their ids, each looking at the map as those
    before have left it (ties: the lower neighbour). ``settled`` is false on pages where a fragment with a
    neighbour is left after ``max_rounds``.

    Pixels are read once, into border patterns; rounds work on those and on the map from old to
    current ids. A fragment acts as soon as no waiting neighbour has a lower id: what is not its neighbour
    changes neither its border nor its choice, so many act at once and the result is the sequential one.
    Edges that touch no waiting fragment rest until the round ends.
    """
    base = labels.select("page_id", "x", "y", F.col(region).cast("long").alias("rid"))
    sizes = cut_lineage(base.where("rid > 0").groupBy("page_id", "rid").agg(F.count(F.lit(1)).alias("area")).withColumn("cur", F.col("rid")))
    patterns = cut_lineage(contact_patterns(base, "rid").withColumn("pattern", F.struct("own", "around")))
    edges = cut_lineage(patterns.select("page_id", "pattern", "n", "own", F.explode("around").alias("near")))
    for turn in range(max_rounds + 1):
        tiny = sizes.groupBy("page_id", "cur").agg(F.sum("area").alias("a")).where(F.col("a") <= max_area).select("page_id", "cur")
        flag = lambda side: tiny.select("page_id", F.col("cur").alias(side), F.lit(True).alias(f"{side}_pending"))
        marked = edges.join(flag("own"), ["page_id", "own"], "left").join(flag("near"), ["page_id", "near"], "left")
        marked = cut_lineage(marked.fillna(False, ["own_pending", "near_pending"]))
        if turn == max_rounds:
            break
        taken, rest = [], []
        while True:
            rest.append(marked.where("NOT own_pending AND NOT near_pending"))
            marked = marked.where("own_pending OR near_pending")
            # Both sums need the rows of (page, near) together: one shuffle serves them.
            contact = marked.where("near_pending").repartition("page_id", "near").groupBy("page_id", "near", "own").agg(
                F.sum("n").alias("c"), F.first("own_pending").alias("waits"))
            best = contact.groupBy("page_id", "near").agg(
                F.max_by(F.struct("own", "waits"), F.struct("c", -F.col("own"))).alias("to"), F.bool_or(F.col("waits") & (F.col("own") < F.col("near"))).alias("blocked"))
            moves = cut_lineage(best.where("NOT blocked").select("page_id", F.col("near").alias("rid"), "to"))
            if moves.isEmpty():
                break
            taken.append(moves)
            marked = cut_lineage(_moved(marked, moves).groupBy("page_id", "pattern", "own", "near").agg(
                *[F.first(c).alias(c) for c in ("n", "own_pending", "near_pending")]))
        if not taken:
            break
        for moves in taken:
            sizes = sizes.join(moves.select("page_id", F.col("rid").alias("cur"), F.col("to.own").alias("to")), ["page_id", "cur"], "left").withColumn("cur", F.coalesce("to", "cur")).drop("to")
        sizes = cut_lineage(sizes)
        edges = reduce(DataFrame.unionByName, [marked, *rest]).groupBy("page_id", "pattern", "own", "near").agg(F.first("n").alias("n"))
    restless = marked.where("near_pending").select("page_id", F.lit(False).alias("settled")).distinct()
    dense = dense_relabel(sizes.select("page_id", F.col("cur").alias("rid")).distinct(), "rid").select("page_id", F.col("rid").alias("cur"), "new_id")
    names = sizes.join(dense, ["page_id", "cur"]).select("page_id", "rid", "new_id")
    out = base.join(names, ["page_id", "rid"], "left").join(restless, "page_id", "left")
    return out.select("page_id", "x", "y", F.coalesce("new_id", F.lit(0)).cast("int").alias(region), F.coalesce("settled", F.lit(True)).alias("settled"))


# --- component rules ---------------------------------------------------------

def keeps_stroke(min_span: int = 5, min_area: int = 8) -> Column:
    """False for isolated dots; thin elongated strokes stay."""
    span = F.greatest("w", "h")
    thin = F.least("w", "h") <= F.greatest(F.lit(3), F.floor(span / 3))
    return (F.col("area") >= min_area) | ((span >= min_span) & thin)


def enclosed_blob(page_w: Column, page_h: Column, min_share: float = 0.0008, max_share: float = 0.40) -> Column:
    """White blobs that do not touch the border and stay within 40 % of the page."""
    page = page_w * page_h
    inside = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") + F.col("w") < page_w) & (F.col("y") + F.col("h") < page_h)
    return (F.col("area") >= F.greatest(F.lit(64), F.floor(page * min_share))) & (F.col("area") <= page * max_share) & inside


def background_region(max_area_ratio: float = 0.35) -> Column:
    return F.col("touches_border") | (F.col("frac") > min(1.0, max(0.01, max_area_ratio)))


def closed_regions(stats: DataFrame, keys: Sequence[str] = ("page_id",), min_area: int = 0, max_ratio: float = 0.99) -> DataFrame:
    """Closed regions of a selection, without dominant cavities.

    ``stats``: area, w, h, is_open, and the selection's sel_area, sel_w, sel_h, region_id.
    """
    keys = list(keys)
    d = stats.withColumns({"ratio": F.col("area") / F.greatest(F.lit(1), F.col("sel_area")),
                           "bbox_ratio": (F.col("w") / F.col("sel_w")) * (F.col("h") / F.col("sel_h"))})
    d = d.where(~F.col("is_open") & (F.col("area") >= min_area) & (F.col("ratio") <= min(0.62, max(0.20, max_ratio))))
    page = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("area").alias("__sum"), F.max_by(
        F.struct("region_id", "area", "ratio", "bbox_ratio"), F.struct("area", -F.col("region_id"))).alias("__top"))
    t = F.col("__top")
    drop = ((F.col("__n") > 1) & (t["ratio"] > 0.38) & (t["bbox_ratio"] > 0.50)
            & (t["area"] > F.greatest(F.lit(1), F.floor((F.col("__sum") - t["area"]) * 1.5))))
    page = page.select(*keys, F.when(drop, t["region_id"]).alias("__drop"),
                       (F.col("__sum") - F.when(drop, t["area"]).otherwise(0)).alias("__left"))
    d = d.join(page, keys).where(F.col("__drop").isNull() | (F.col("region_id") != F.col("__drop")))
    return d.where(F.col("__left") / F.greatest(F.lit(1), F.col("sel_area")) <= 0.68).drop("__drop", "__left")


def filter_components(stats: DataFrame, rule: str, page_w: Column | None = None, page_h: Column | None = None) -> DataFrame:
    """Apply a named rule: strokes, blobs, foreground or closed."""
    if rule == "strokes":
        return stats.where(keeps_stroke())
    if rule == "blobs":
        return stats.where(enclosed_blob(page_w, page_h))
    if rule == "foreground":
        return stats.where(~background_region())
    if rule == "closed":
        return closed_regions(stats)
    raise ValueError(f"unknown rule: {rule}")
