"""Order-dependent operators: reading order, greedy suppression, sampling, splits, components."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.functions import geometry as G
from chromaframe.scale import cut_lineage, first_per_group, rank_within

#: Boxes that one task spreads over grid cells.
CELL_BOXES = 100_000


def reading_order(panels: DataFrame, style: str = "western", keys: Sequence[str] = ("page_id",),
                  tolerance: float = 0.3) -> DataFrame:
    """Dense reading index per page: rows by y, then x (right to left for manga).

    A panel joins a row while within 0.3 mean heights of the row's first panel. Row
    starts depend on distinct y values only, which the page height bounds; panels are
    then ranked inside (row, x) buckets rather than as one page.
    """
    keys = list(keys)
    page = panels.groupBy(*keys).agg(F.avg("height").alias("__mean"), F.array_sort(F.collect_set("y")).alias("__ys"))

    def step(acc, y):
        last = F.get(acc, F.size(acc) - 1)
        return F.when(last.isNull() | (y - last > F.col("__mean") * tolerance), F.array_append(acc, y)).otherwise(acc)
    page = page.withColumn("__starts", F.aggregate("__ys", F.array().cast("array<int>"), step))
    rows = page.select(*keys, F.posexplode("__ys").alias("__i", "y"), "__starts").select(
        *keys, "y", F.size(F.filter("__starts", lambda s: s <= F.col("y"))).alias("row"))
    d = panels.join(rows, [*keys, "y"])
    x = -F.col("x") if style == "manga" else F.col("x")
    d = d.withColumn("__x", x)
    bucket = F.struct(F.col("row"), F.floor(F.col("__x") / 64))
    order = ["row", "__x", "y", "idx"]
    out = rank_within(d, keys, order, bucket, "__rank")
    return out.withColumn("reading_index", (F.col("__rank") - 1).cast("int")).drop("__x", "__rank")


def overlap_edges(boxes: DataFrame, keys: Sequence[str], max_iou: float, box_id: str, rank: Column) -> DataFrame:
    """Pairs of boxes of a key whose IoU is above ``max_iou``: keys, ``hi`` (better rank), ``lo``.

    A box belongs to a size class, whose cells are at least as wide as it is, and so lies in
    at most four of them. Boxes that overlap by more than ``max_iou`` differ by a bounded
    number of classes; a box visits that many coarser grids. Tables of a few MB give many rows here, so
    no side is broadcast by the size of its source, and boxes are dealt in slices of about ``CELL_BOXES``
    before they spread: a read task may hold millions, whose cells a shuffle would all keep in memory.
    """
    keys = list(keys)
    # Sides of such boxes differ by less than a factor 1 / max_iou, so rounded-up classes by at most this many.
    apart = min(30, math.floor(math.log2(1 / max_iou) + 1e-6) + 1) if max_iou > 0 else 30
    side = F.greatest(F.col("w"), F.col("h"), F.lit(1e-6)).cast("double")
    d = boxes.where((F.col("w") > 0) & (F.col("h") > 0)).select(
        *keys, F.col(box_id).alias("id"), rank.alias("r"), *[F.col(c).cast("double").alias(c) for c in "xywh"], F.ceil(F.log2(side)).cast("int").alias("cls"))
    tasks = max(boxes.sparkSession.sparkContext.defaultParallelism, -(-d.count() // CELL_BOXES))
    # The class is never null; said here, the join adds no such filter to one side only, and both read one shuffle.
    d = d.where(F.col("cls").isNotNull()).repartition(tasks, *keys, "id", *"xywh")

    def cells(rows, cls):
        size = F.pow(F.lit(2.0), cls)
        span = lambda lo, n: F.array_distinct(F.array(F.floor(lo / size).cast("long"), F.floor((lo + n) / size).cast("long")))
        return rows.withColumn("cx", F.explode(span(F.col("x"), F.col("w")))).withColumn("cy", F.explode(span(F.col("y"), F.col("h"))))
    box = F.struct("id", "r", *"xywh", "cls")
    own = cells(d.withColumn("grid", F.col("cls")), F.col("grid")).select(*keys, "grid", "cx", "cy", box.alias("p"))
    visit = cells(d.withColumn("grid", F.explode(F.sequence(F.col("cls"), F.col("cls") + apart))), F.col("grid")).select(*keys, "grid", "cx", "cy", box.alias("q"))
    at = lambda s: tuple(F.col(f"{s}.{c}") for c in "xywh")
    met = own.join(visit.hint("merge"), [*keys, "grid", "cx", "cy"]).where(
        ((F.col("p.cls") > F.col("q.cls")) | (F.col("p.r") < F.col("q.r"))) & (F.col("p.id") != F.col("q.id")) & (G.bbox_iou(at("p"), at("q")) > max_iou))
    first = F.col("p.r") < F.col("q.r")
    return met.select(*keys, F.when(first, F.col("p.id")).otherwise(F.col("q.id")).alias("hi"),
                      F.when(first, F.col("q.id")).otherwise(F.col("p.id")).alias("lo")).distinct()


def nms(boxes: DataFrame, keys: Sequence[str] = ("page_id",), max_iou: float = 0.28, cap: int | None = 32,
        box_id: str = "box_id") -> DataFrame:
    """Greedy suppression by score, then area, then id; at most ``cap`` kept per key (None: all).

    Only conflicts iterate: a box that no better live box overlaps is kept and takes away those it
    overlaps, until no conflict is left. Boxes without a conflict are never touched, and the cap is a
    rank over what stays, as suppression never looks at worse boxes.
    """
    keys = list(keys)
    rank = F.struct((-F.col("score").cast("double")).alias("s"), (-(F.col("w") * F.col("h")).cast("double")).alias("a"), F.col(box_id).alias("i"))
    edges = cut_lineage(overlap_edges(boxes, keys, max_iou, box_id, rank))
    gone = None
    while not edges.isEmpty():
        heads = edges.select(*keys, F.col("hi").alias("b")).distinct().join(edges.select(*keys, F.col("lo").alias("b")).hint("merge"), [*keys, "b"], "left_anti")
        lost = cut_lineage(edges.join(heads.withColumnRenamed("b", "hi").hint("merge"), [*keys, "hi"], "left_semi").select(*keys, F.col("lo").alias("b")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        left = edges
        for side in ("lo", "hi"):
            left = left.join(lost.withColumnRenamed("b", side).hint("merge"), [*keys, side], "left_anti")
        edges = cut_lineage(left)
    kept = boxes if gone is None else boxes.join(gone.withColumnRenamed("b", box_id).hint("merge"), [*keys, box_id], "left_anti")
    if cap is None:
        return kept
    return first_per_group(kept.withColumn("__area", F.col("w") * F.col("h")), keys, [F.desc("score"), F.desc("__area"), F.asc(box_id)], cap).drop("__area")


def crop_boxes(boxes: DataFrame, pages: DataFrame, keys: Sequence[str] = ("page_id",), box_id: str = "box_id") -> DataFrame:
    """Crop variant: drop boxes under 0.08 % of the page, suppress above 0.72 in given order.

    A page left without boxes, or with one box above 28 % of it, gets the whole page.
    ``pages``: keys, page_w, page_h.
    """
    keys = list(keys)
    p = pages.select(*keys, "page_w", "page_h")
    big = boxes.join(p, keys).where(F.col("w") * F.col("h") >= F.col("page_w") * F.col("page_h") * 0.0008)
    kept = nms(big.withColumn("score", -F.col("ord")).drop("page_w", "page_h"), keys, 0.72, None, box_id=box_id)
    s = p.join(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("w") * F.col("h")).alias("__a")), keys, "left")
    whole = s.where(F.col("__n").isNull() | ((F.col("__n") == 1) & (F.col("__a") > F.col("page_w") * F.col("page_h") * 0.28)))
    full = whole.select(*keys, F.lit(None).cast("long").alias(box_id), F.lit(0).alias("x"), F.lit(0).alias("y"),
                        F.col("page_w").alias("w"), F.col("page_h").alias("h"))
    rest = kept.join(whole.select(*keys), keys, "left_anti").select(*keys, F.col(box_id).cast("long").alias(box_id), "x", "y", "w", "h")
    return rest.unionByName(full)


def systematic_sample(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str | Column], bucket: Column) -> DataFrame:
    """At most ``n`` rows per key, at the positions trunc(linspace(0, size - 1, n)).

    ``bucket`` grows with ``order`` (an image row, say) and keeps ranking distributed.
    """
    d = rank_within(df, keys, order, bucket, "__pos", "__n")
    pos, size, k = F.col("__pos") - 1, F.col("__n"), n
    if k == 1:
        hit = pos == 0
    else:
        step = F.greatest(size - 1, F.lit(1)) / float(k - 1)
        # Position p is taken when some whole i has trunc(i * step) = p.
        i = F.ceil(pos / step)
        hit = (F.floor(i.cast("double") * step) == pos) & (i <= k - 1)
        before = F.floor((i - 1).cast("double") * step) == pos
        hit = hit | (before & (i >= 1)) | (pos == size - 1)
    return d.where((size <= k) | hit).drop("__pos", "__n")


def tone_exemplars(px: DataFrame, regions: DataFrame, low: int = 55, high: int = 242, penalty: float = 7.0) -> DataFrame:
    """Up to three distinct pixels per region nearest the 50 / 80 / 20 % grey levels.

    ``px`` has page_id, region_id, x, y, gray and the interior distance ``depth``. Only
    the three best pixels of a tier can matter, so distinctness is settled among those.
    """
    d = px.where((F.col("depth") >= 1.25) & F.col("gray").between(low, high))
    q = d.groupBy("page_id", "region_id").agg(*[F.expr(f"percentile(gray, {p})").alias(f"q{t}")
                                                for t, p in ((1, 0.5), (2, 0.8), (3, 0.2))])
    q = q.join(regions.select("page_id", "region_id", "frac"), ["page_id", "region_id"])
    tiers = F.when(F.col("frac") <= 0.006, 1).when(F.col("frac") <= 0.04, 2).otherwise(3)
    q = q.withColumn("t", F.explode(F.sequence(F.lit(1), tiers)))
    q = q.withColumn("goal", F.when(F.col("t") == 1, F.col("q1")).when(F.col("t") == 2, F.col("q2")).otherwise(F.col("q3")))
    c = d.join(q.select("page_id", "region_id", "t", "goal"), ["page_id", "region_id"])
    c = c.withColumn("cost", F.abs(F.col("gray") - F.col("goal")) + F.lit(penalty) / F.greatest("depth", F.lit(0.5)))
    c = first_per_group(c, ["page_id", "region_id", "t"], ["cost", "y", "x"], 3, "__r")
    g = c.groupBy("page_id", "region_id").agg(F.array_sort(F.collect_list(F.struct("t", "__r", "x", "y", "gray"))).alias("c"))
    typ = "array<struct<t:int,x:int,y:int,gray:int>>"

    def step(acc, e):
        used = F.exists(acc, lambda o: (o["t"] == e["t"]) | ((o["x"] == e["x"]) & (o["y"] == e["y"])))
        return F.when(used, acc).otherwise(F.array_append(acc, F.struct(
            e["t"].alias("t"), e["x"].alias("x"), e["y"].alias("y"), e["gray"].alias("gray"))))
    g = g.select("page_id", "region_id", F.inline(F.aggregate("c", F.array().cast(typ), step)))
    tier = F.when(F.col("t") == 1, "mid").when(F.col("t") == 2, "highlight").otherwise("shadow")
    return g.select("page_id", "region_id", tier.alias("tier"), "x", "y", "gray")


def gap_splits(px: DataFrame, axis: str, threshold: float = 0.85, white: int = 230, min_gap: int = 10,
               keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Midpoints of white runs along ``axis`` ('y' for row gaps, 'x' for column gaps).

    A run needs max(min_gap, height / 100) lines inside the 5 % margins; one still open
    at the end is no split. Lines of a page are bounded by its size.
    """
    keys = list(keys)
    size = px.groupBy(*keys).agg((F.max(axis) + 1).alias("__len"), (F.max("y") + 1).alias("__h"))
    line = px.groupBy(*keys, axis).agg((F.count_if(F.col("gray") > white) / F.count(F.lit(1))).alias("__share"))
    d = line.join(size, keys).withColumn("__m", F.floor(F.col("__len") / 20))
    d = d.where((F.col(axis) >= F.col("__m")) & (F.col(axis) < F.col("__len") - F.col("__m")) & (F.col("__share") >= threshold))
    d = d.withColumn("__run", F.col(axis) - F.row_number().over(W.partitionBy(*keys).orderBy(axis)))
    runs = d.groupBy(*keys, "__run").agg(F.min(axis).alias("__a"), (F.max(axis) + 1).alias("__b"),
                                         F.first("__len").alias("__len"), F.first("__m").alias("__m"), F.first("__h").alias("__h"))
    need = F.greatest(F.lit(min_gap), F.floor(F.col("__h") / 100))
    good = (F.col("__b") - F.col("__a") >= need) & (F.col("__b") < F.col("__len") - F.col("__m"))
    return runs.where(good).select(*keys, F.floor((F.col("__a") + F.col("__b")) / 2).cast("int").alias("split"))


def panel_grid(px: DataFrame, threshold: float = 0.85, white: int = 230, min_gap: int = 10, min_area: float = 0.02,
               paper: float = 240.0) -> DataFrame:
    """Panels of the split grid, without slivers and blank cells; the whole page when none is left."""
    size = px.groupBy("page_id").agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph"))

    def bounds(axis, length, a, b):
        s = gap_splits(px, axis, threshold, white, min_gap).groupBy("page_id").agg(F.collect_list("split").alias("s"))
        d = size.join(s, "page_id", "left").select("page_id", F.array_sort(F.concat(
            F.array(F.lit(0), F.col(length)), F.coalesce("s", F.array().cast("array<int>")))).alias("s"))
        return d.select("page_id", F.explode(F.zip_with(
            F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1),
            lambda p, q: F.struct(p.alias(a), q.alias(b)))).alias("v")).select("page_id", f"v.{a}", f"v.{b}")
    rows, cols = bounds("y", "ph", "y1", "y2"), bounds("x", "pw", "x1", "x2")
    # Each pixel finds its row band and its column band, then counts toward one cell.
    yb = rows.withColumn("y", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)))
    xb = cols.withColumn("x", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)))
    cells = (px.select("page_id", "x", "y", "gray").join(yb, ["page_id", "y"]).join(xb, ["page_id", "x"])
             .groupBy("page_id", "x1", "x2", "y1", "y2").agg(F.avg("gray").alias("mean")).join(size, "page_id"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    good = cells.where((w * h >= F.floor(F.col("pw") * F.col("ph") * min_area)) & (F.col("mean") <= paper))
    out = good.select("page_id", F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("width"), h.alias("height"))
    whole = size.join(out.select("page_id").distinct(), "page_id", "left_anti").select(
        "page_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("pw").alias("width"), F.col("ph").alias("height"))
    return out.unionByName(whole)


def dense_relabel(labels: DataFrame, region: str = "region_id", keys: Sequence[str] = ("page_id",), width: int = 65_536) -> DataFrame:
    """Renumber surviving ids 1..n per page (0 stays 0). Only distinct ids are ranked."""
    keys = list(keys)
    ids = labels.where(F.col(region) > 0).select(*keys, region).distinct()
    ranked = rank_within(ids, keys, [region], F.floor(F.col(region) / width), "new_id")
    return labels.join(ranked, [*keys, region], "left").withColumn("new_id", F.coalesce("new_id", F.lit(0)).cast("int"))


def component_score(stats: DataFrame, page_w: Column, page_h: Column) -> DataFrame:
    """Chroma x area^0.35 x centrality, with penalties for large border components."""
    frac = F.col("area") / (page_w * page_h)
    touches = ((F.col("x") <= 1).cast("int") + (F.col("y") <= 1).cast("int")
               + (F.col("x") + F.col("w") >= page_w - 1).cast("int") + (F.col("y") + F.col("h") >= page_h - 1).cast("int"))
    dx, dy = F.col("cx") / page_w - 0.5, F.col("cy") / page_h - 0.5
    score = F.col("mean_chroma") * F.pow(F.col("area").cast("double"), F.lit(0.35)) * (
        F.lit(1.15) - F.least(F.lit(0.8), F.sqrt(dx * dx + dy * dy)))
    score = score * F.when((touches >= 3) & (frac > 0.12), 0.20).when((touches >= 2) & (frac > 0.25), 0.45).otherwise(1.0)
    ok = (F.col("area") >= F.greatest(F.lit(32), F.floor(page_w * page_h * 0.0012))) & (frac <= 0.72)
    return stats.where(ok).withColumn("score", score)


def near_best(df: DataFrame, score: str = "score", frac: float = 0.28, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Rows scoring at least ``frac`` of their page's best."""
    best = df.groupBy(*keys).agg(F.max(score).alias("__best"))
    return df.join(best, list(keys)).where(F.col(score) >= F.col("__best") * frac).drop("__best")


def top_components(stats: DataFrame, k: int, min_area: int, keys: Sequence[str] = ("page_id",), ident: str = "region_id") -> DataFrame:
    return first_per_group(stats.where(F.col("area") >= min_area), keys, [F.desc("area"), ident], k, "rank")


def component_seeds(px: DataFrame, top: DataFrame, keys: Sequence[str] = ("page_id",), ident: str = "region_id",
                    depth: str = "depth") -> DataFrame:
    """Deepest pixel of each kept component (first in row order on ties)."""
    best = F.max_by(F.struct("x", "y"), F.struct(F.col(depth), -F.col("y"), -F.col("x")))
    d = px.join(top.select(*keys, ident, "rank"), [*keys, ident])
    return d.groupBy(*keys, ident, "rank").agg(best.alias("p")).select(
        *keys, ident, "rank", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


