"""Grouped statistics over pixels, regions and style records."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions.color import clip
from chromaframe.operators.selection import exact_percentile
from chromaframe.scale import cut_lineage, first_per_group

PAGE = ("page_id",)


# --- closest pair ------------------------------------------------------------

def closest_pair(points: DataFrame, keys: Sequence[str], coords: Sequence[str],
                 reach: Sequence[float] = (6.0, 24.0, 96.0, 512.0)) -> DataFrame:
    """Smallest distance between two points of a key, null below two points.

    Equal points collapse first (distance 0). The rest meet only inside neighbouring
    grid cells of side ``reach``; a key with no pair within one reach moves to the
    next, where its points are by then known to lie that far apart. After the last given
    reach it grows fourfold up to the extent of the points. Each round starts
    from checkpointed rows, and the loop ends as soon as no key is left.
    """
    keys, coords = list(keys), list(coords)
    spots = cut_lineage(points.groupBy(*keys, *coords).agg(F.count(F.lit(1)).alias("__n")))
    todo = spots
    found = (spots.groupBy(*keys).agg(F.max("__n").alias("__m"), F.count(F.lit(1)).alias("__d")))
    same = found.where("__m > 1").select(*keys, F.lit(0.0).alias("min_distance"))
    lone = found.where("__m = 1 AND __d = 1").select(*keys, F.lit(None).cast("double").alias("min_distance"))
    out = same.unionByName(lone)
    todo = todo.join(out.select(*keys), keys, "left_anti")
    steps, step, extent = list(reach), 0.0, None
    while True:
        todo = cut_lineage(todo)
        if todo.isEmpty():
            break
        if not steps and extent is None:
            spans = [F.max(c) - F.min(c) for c in coords]
            extent = float(todo.agg((F.greatest(*spans) if len(spans) > 1 else spans[0]).cast("double").alias("e")).first()["e"] or 0.0)
        if not steps and step > 2 * extent * len(coords):
            break  # what is left has no comparable coordinates
        step = steps.pop(0) if steps else max(step, 1.0) * 4
        cell = [F.floor(F.col(c) / step).cast("long") for c in coords]
        near = [F.explode(F.array(v - 1, v, v + 1)) for v in cell]
        left, right = todo, todo.select(*keys, *[F.col(c).alias(f"__q_{c}") for c in coords],
                                        *[v.alias(f"__c{i}") for i, v in enumerate(cell)])
        for i, v in enumerate(near):
            left = left.withColumn(f"__c{i}", v)
        pair = left.join(right, keys + [f"__c{i}" for i in range(len(coords))])
        p, q = F.struct(*coords), F.struct(*[f"__q_{c}" for c in coords])
        dist = F.sqrt(sum(((F.col(c) - F.col(f"__q_{c}")) * (F.col(c) - F.col(f"__q_{c}")) for c in coords), F.lit(0.0)))
        hit = (pair.where(p < q).withColumn("__dist", dist).where(F.col("__dist") <= step)
               .groupBy(*keys).agg(F.min("__dist").alias("min_distance")))
        hit = cut_lineage(hit)
        out = out.unionByName(hit)
        todo = todo.join(hit.select(*keys), keys, "left_anti")
    return out


# --- colour statistics -------------------------------------------------------

def identity_groups(samples: DataFrame, keys=("character", "attribute")) -> DataFrame:
    """Mean and max Lab distance of samples to their group's median, per group.

    Distinct colours are counted first, so each is converted and compared once.
    """
    keys = list(keys)
    spots = samples.groupBy(*keys, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    lab = C.with_lab(spots)
    center = lab.groupBy(*keys).agg(
        *[F.expr(f"percentile({c}, 0.5, n)").alias(f"c_{c}") for c in ("lab_l", "lab_a", "lab_b", "r", "g", "b")])
    d = lab.join(center, keys).withColumn(
        "dist", C.lab_distance(("lab_l", "lab_a", "lab_b"), ("c_lab_l", "c_lab_a", "c_lab_b")))
    return d.groupBy(*keys).agg(
        F.sum("n").alias("samples"), (F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("delta_e_mean"),
        F.max("dist").alias("delta_e_max"), F.first("c_r").cast("int").alias("center_r"),
        F.first("c_g").cast("int").alias("center_g"), F.first("c_b").cast("int").alias("center_b"))


def identity_separation(groups: DataFrame, attribute: str = "attribute") -> DataFrame:
    """Per attribute: smallest Lab distance between two characters' centres."""
    lab = C.with_lab(groups, ("center_r", "center_g", "center_b"))
    return closest_pair(lab, [attribute], ["lab_l", "lab_a", "lab_b"])


def identity_delta(samples: DataFrame) -> DataFrame:
    """One row: same-character mean and max, different-character minimum, group count."""
    groups = identity_groups(samples)
    total = groups.agg((F.sum(F.col("delta_e_mean") * F.col("samples")) / F.sum("samples")).alias("same_mean"),
                       F.max("delta_e_max").alias("same_max"), F.count(F.lit(1)).alias("sample_groups"))
    apart = identity_separation(groups).agg(F.min("min_distance").alias("different_min"))
    return total.withColumn("different_min", apart.scalar())


def assignment_metrics(diag: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    sums = diag.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in (
        "matched", "ambiguous", "unmatched", "lock_regions", "skipped_lock_regions")])
    m, u, k, s = (F.col(c) for c in ("matched", "unmatched", "lock_regions", "skipped_lock_regions"))
    return sums.select(*keys, F.try_divide(m, m + u).alias("coverage"),
                       F.try_divide(F.col("ambiguous"), m).alias("ambiguous_ratio"),
                       F.try_divide(k, k + s).alias("lock_coverage"), "matched", "ambiguous", "unmatched")


def separation_retention(px: DataFrame, keys=PAGE, region: str = "region_id",
                         before=("r", "g", "b"), after=("r2", "g2", "b2")) -> DataFrame:
    """Minimum distance between region median colours, after over before; 1 below two regions."""
    keys = list(keys)

    def minimum(rgb, name):
        lab = C.with_lab(px.where(F.col(region) > 0), rgb)
        mid = lab.groupBy(*keys, region).agg(*[F.expr(f"percentile({c}, 0.5)").alias(c)
                                               for c in ("lab_l", "lab_a", "lab_b")])
        return closest_pair(mid, keys, ["lab_l", "lab_a", "lab_b"]).withColumnRenamed("min_distance", name)
    both = minimum(before, "before_min").join(minimum(after, "after_min"), keys, "full")
    ratio = F.col("after_min") / F.greatest(F.lit(1e-6), F.col("before_min"))
    return both.withColumn("retention", F.coalesce(
        F.when(F.col("before_min").isNotNull() & F.col("after_min").isNotNull(), ratio), F.lit(1.0)))


def robust_median(px: DataFrame, keys: Sequence[str], usable: Column, min_n: int = 8,
                  min_share: float = 0.0, rgb=("r", "g", "b"), min_chroma: float | None = None) -> DataFrame:
    """Per-channel median over usable pixels, or over all when too few are usable.

    Equal channel values are counted first (at most 256 per channel and group), so the
    medians see a bounded number of rows however large the group is.
    """
    keys = list(keys)
    channels = F.array(*[F.struct(F.lit(i).alias("__ch"), F.col(c).alias("__v")) for i, c in enumerate(rgb)])
    d = px.select(*keys, F.coalesce(usable, F.lit(False)).alias("__ok"), F.inline(channels))
    level = d.groupBy(*keys, "__ok", "__ch", "__v").agg(F.count(F.lit(1)).alias("__n"))
    aggs = [F.expr("sum(__n) FILTER (WHERE __ch = 0)").alias("n"),
            F.expr("coalesce(sum(__n) FILTER (WHERE __ch = 0 AND __ok), 0L)").alias("n_ok")]
    for i, c in enumerate(rgb):
        aggs += [F.expr(f"percentile(__v, 0.5, __n) FILTER (WHERE __ch = {i} AND __ok)").alias(f"__ok_{c}"),
                 F.expr(f"percentile(__v, 0.5, __n) FILTER (WHERE __ch = {i})").alias(f"__all_{c}")]
    need = F.greatest(F.lit(min_n), F.floor(F.col("n") * min_share))
    out = level.groupBy(*keys).agg(*aggs).withColumn("__use", F.col("n_ok") >= need)
    out = out.select(*keys, "n", "n_ok", *[
        F.when(F.col("__use"), F.col(f"__ok_{c}")).otherwise(F.col(f"__all_{c}")).alias(f"med_{m}")
        for c, m in zip(rgb, "rgb")])
    if min_chroma is None:
        return out
    cut = out.withColumns({f"__m{m}": F.col(f"med_{m}").cast("int") for m in "rgb"})
    lab = C.with_lab(cut, ("__mr", "__mg", "__mb"))
    return lab.where(C.chroma("lab_a", "lab_b") >= min_chroma).select(*out.columns)


# Labels that count as environment.
ENVIRONMENT = ("sky", "foliage", "stone", "wood", "water", "fire", "metal", "background")


def scene_palette(px: DataFrame, regions: DataFrame, keys: Sequence[str] = (), min_conf: float = 0.30,
                  min_pixels: int = 12) -> DataFrame:
    """Weighted mean colour per environment label over regions' robust medians."""
    labelled = regions.where(F.col("label").isin(*ENVIRONMENT) & (F.col("conf") >= min_conf)).select(
        "page_id", "region_id", "label", *keys,
        F.greatest(F.lit(1.0), F.col("area") * F.col("conf")).alias("weight"))
    d = C.with_hsv(px.where("region_id > 0"), out=("__h", "__s", "__v"))
    mid = robust_median(d, ["page_id", "region_id"], C.is_usable("__s", "__v", 18, 20, 248))
    d = mid.where(F.col("n") >= min_pixels).join(labelled, ["page_id", "region_id"])
    mean = {m: (F.sum(F.col(f"med_{m}") * F.col("weight")) / F.sum("weight")).cast("int") for m in "rgb"}
    out = d.groupBy(*keys, "label").agg(*[v.alias(m) for m, v in mean.items()],
                                        F.count(F.lit(1)).alias("regions"))
    return out.select(*keys, "label", C.rgb_to_hex("r", "g", "b").alias("color"), "regions")


def tone_tier_stats(px: DataFrame, keys: Sequence[str], global_mid_b: float = 0.0,
                    saturation_scale: float = 1.0) -> DataFrame:
    """Shadow / mid / highlight statistics per group and the descriptor they give.

    Tiers depend on 8-bit lightness alone, so pixels shrink to at most 256 sums per
    group before anything looks at a whole group.
    """
    keys = list(keys)
    lab = C.with_lab(px).select(*keys, "lab_l", (F.col("lab_a") - 128.0).alias("a"), (F.col("lab_b") - 128.0).alias("b"))
    lvl = lab.groupBy(*keys, "lab_l").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"),
        F.sum(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("sc"))
    w = W.partitionBy(*keys)
    total = F.sum("n").over(w)
    lvl = lvl.withColumns({
        "__lo": F.when(total >= 8, F.expr("percentile(lab_l, 0.25, n)").over(w)).otherwise(100.0),
        "__hi": F.when(total >= 8, F.expr("percentile(lab_l, 0.75, n)").over(w)).otherwise(160.0),
        "__min": F.min("lab_l").over(w), "__max": F.max("lab_l").over(w)})
    flat = (F.col("__hi") - F.col("__lo")) < 12
    lvl = lvl.withColumns({"__lo": F.when(flat, F.col("__min")).otherwise(F.col("__lo")),
                           "__hi": F.when(flat, F.col("__max")).otherwise(F.col("__hi"))})
    lvl = lvl.withColumns({"is_hi": F.col("lab_l") >= F.col("__hi"), "is_sh": F.col("lab_l") <= F.col("__lo")})
    lvl = lvl.withColumn("is_mid", ~F.col("is_hi") & ~F.col("is_sh"))

    def mean(v, flag):
        return F.expr(f"try_divide(sum({v}) FILTER (WHERE {flag}), sum(n) FILTER (WHERE {flag}))")
    aggs = [F.sum("n").alias("count"),
            F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("lab_l") * F.col("lab_l")) / F.sum("n")
                              - F.pow(F.sum(F.col("n") * F.col("lab_l")) / F.sum("n"), F.lit(2.0)))).alias("std_l")]
    for v, name in (("sa", "a"), ("sb", "b"), ("sc", "c")):
        aggs += [F.coalesce(mean(v, "is_mid"), mean(v, "true")).alias(f"mid_{name}"),
                 mean(v, "is_hi").alias(f"hi_{name}"), mean(v, "is_sh").alias(f"sh_{name}")]
    s = lvl.groupBy(*keys).agg(*aggs)
    base = F.greatest(F.col("mid_c"), F.lit(1e-3))
    s = s.withColumns({
        "sh_desat": F.coalesce(clip(F.lit(1.0) - F.coalesce("sh_c", "mid_c") / base, 0.0, 1.0), F.lit(0.0)),
        "hi_desat": F.coalesce(clip(F.lit(1.0) - F.col("hi_c") / base, 0.0, 1.0), F.lit(0.0)),
        "gradient": clip(F.col("std_l") / 60.0, 0.0, 1.0)})
    for n in ("a", "b"):
        s = s.withColumns({f"hi_{n}": F.coalesce(f"hi_{n}", f"mid_{n}"), f"sh_{n}": F.coalesce(f"sh_{n}", f"mid_{n}")})
    shift = lambda side, n: C.round_even(clip(F.col(f"{side}_{n}") - F.col(f"mid_{n}"), -12.0, 12.0), 2)
    return s.select(
        *keys, "count", "mid_a", "mid_b", "hi_a", "hi_b", "sh_a", "sh_b", F.col("mid_c").alias("chroma_mid"),
        "gradient", "sh_desat", "hi_desat",
        C.round_even(clip(F.col("mid_b") - global_mid_b, -15.0, 15.0), 2).alias("warm_bias"),
        shift("sh", "b").alias("shadow_bias"), shift("sh", "a").alias("shadow_hue_rotate"),
        shift("hi", "b").alias("highlight_bias"), shift("hi", "a").alias("highlight_hue_rotate"),
        C.round_even(clip(base / 18.0, 0.4, 2.0) * saturation_scale, 3).alias("saturation_scale"),
        C.round_even(clip(base / 14.0, 0.7, 1.8), 3).alias("region_contrast"))


def global_color_stats(px: DataFrame, keys=PAGE, gradient: Column | None = None) -> DataFrame:
    """Page-wide saturation, contrast, temperature, shadow and Lab signature in one pass."""
    d = C.with_hsv(C.with_lab(px), out=("__h", "__s", "__v"))
    d = d.withColumns({"chromatic": C.is_chromatic("__s", "__v"),
                       "nonpaper": (F.col("gray") > 20) & (F.col("gray") < 245)})

    def agg(sql, name):
        return F.expr(sql).alias(name)
    aggs = [agg("count_if(chromatic)", "n_chromatic"), agg("count_if(nonpaper)", "n_nonpaper"),
            agg("avg(__s) FILTER (WHERE chromatic) / 255.0D", "sat_mean"),
            agg("avg(CASE WHEN __h < 30 OR __h > 150 THEN 1.0D ELSE 0.0D END) FILTER (WHERE chromatic)", "warm"),
            agg("stddev_pop(gray)", "gray_std"), agg("avg(CASE WHEN gray < 90 THEN 1.0D ELSE 0.0D END)", "shadow"),
            agg("coalesce(avg(lab_b - 128) FILTER (WHERE lab_l > 100 AND lab_l < 160), 0.0D)", "global_mid_b"),
            agg("percentile(gray, 0.15)", "dark")]
    for c in ("l", "a", "b"):
        for which, cond in (("c", "chromatic"), ("n", "nonpaper"), ("x", "true")):
            aggs += [agg(f"avg(lab_{c}) FILTER (WHERE {cond})", f"m_{c}_{which}"),
                     agg(f"stddev_pop(lab_{c}) FILTER (WHERE {cond})", f"s_{c}_{which}")]
    s = d.groupBy(*keys).agg(*aggs)
    some, rest = F.col("n_chromatic") > 0, F.col("n_nonpaper") > 0

    def pick(p):
        return F.when(some, F.col(f"{p}_c")).when(rest, F.col(f"{p}_n")).otherwise(F.col(f"{p}_x"))
    satur = F.when(some, clip("sat_mean", 0.0, 1.0)).otherwise(0.0)
    contrast = clip(F.col("gray_std") / 80.0, 0.0, 1.0)
    floors = {"l": 1.0, "a": 4.0, "b": 4.0}
    return s.select(
        *keys, satur.alias("saturation"), contrast.alias("contrast"),
        F.when(some & (F.col("warm") > 0.58), "warm").when(some & (F.col("warm") < 0.42), "cool")
        .otherwise("neutral").alias("temperature"),
        clip("shadow", 0.0, 1.0).alias("shadow_strength"), "global_mid_b",
        clip(F.col("dark") / 40.0, 0.0, 1.0).alias("shadow_lift"),
        clip(satur * 1.5, 0.4, 2.0).alias("global_saturation"), clip(contrast * 1.4, 0.5, 1.8).alias("global_contrast"),
        *[pick(f"m_{c}").alias(f"lab_mean_{c}") for c in "lab"],
        *[F.greatest(F.lit(floors[c]), pick(f"s_{c}")).alias(f"lab_std_{c}") for c in "lab"])


# --- palettes by clustering --------------------------------------------------

def corpus_palette(px: DataFrame, max_colors: int = 8) -> DataFrame:
    """Clusters of all non-neutral pixels, largest first."""
    d = C.with_hsv(px, out=("__h", "__s", "__v")).where(C.is_usable("__s", "__v", 28, 24, 248))
    found = color_clusters(d.select(F.lit(0).alias("__all"), "r", "g", "b"), "__all", max_colors, one_key=True)
    colors = found.groupBy("color").agg(F.sum("pixels").alias("pixels"))
    rank = F.row_number().over(W.orderBy(F.desc("pixels"), "color"))  # at most max_colors rows
    return colors.select(rank.alias("rank"), "color", "pixels")


def color_clusters(px: DataFrame, key: str, max_colors: int, rounds: int = 25, still: float = 0.5, one_key: bool = False) -> DataFrame:
    """k-means per key over all pixels: ``key``, ``cluster``, ``color``, ``pixels``, ``settled``.

    A key with fewer than 16 pixels has no row; it gets a cluster per 64 pixels, at most ``max_colors``. Pixels
    are first counted by colour, so a key has at most 2^24 weighted points. Seeds are picked farthest
    first from the mean (ties: the smallest colour); the steps end for a key when no centre
    moves by ``still``, or after ``rounds``, and ``settled`` tells which. Sums are whole numbers: the result does not
    depend on the partitioning. ``one_key``: ``key`` is a constant, so the centres are one row.

    Every step moves the points to their centres, so they are kept packed: a row holds the points of one of at most
    32 blocks of the colour cube as four arrays.
    """
    points = F.array_sort(F.collect_list(F.struct("r", "g", "b", "n")))
    block = [F.floor(F.col(c) / size).alias(f"__{c}") for c, size in (("r", 64), ("g", 64), ("b", 128))]
    packed = px.groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("n")).groupBy(key, *block).agg(points.alias("p"))
    packed = cut_lineage(packed.select(key, *[F.col("p")[c].alias(c) for c in "rgbn"]))
    unpacked = F.inline(F.arrays_zip("r", "g", "b", "n"))
    spots = packed.select(key, unpacked)
    weigh = [F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"]]
    center = F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"])
    k = F.greatest(F.lit(1), F.least(F.lit(max_colors), F.floor(F.col("n") / 64))).cast("int")
    state = cut_lineage(spots.groupBy(key).agg(*weigh).where("n >= 16").select(key, k.alias("k"), F.array(center).alias("centers")))

    def nearest(state: DataFrame) -> DataFrame:
        near = F.array_min(F.transform("centers", lambda c, i: F.struct(
            sum((F.pow(F.col(x) - c[x], 2) for x in "rgb"), F.lit(0.0)).alias("gap"), i.alias("i"))))
        met = packed.join(F.broadcast(state) if one_key else state, key)
        return met.select(key, "centers", unpacked).withColumn("__near", near)

    for _ in range(max_colors):
        order = F.struct(F.col("__near.gap"), *[-F.col(c) for c in "rgb"])
        far = nearest(state.where(F.size("centers") <= F.col("k"))).groupBy(key).agg(F.max_by(center, order).alias("far"))
        grown = F.when(F.col("far").isNull(), F.col("centers")).otherwise(F.concat("centers", F.array("far")))
        state = cut_lineage(state.join(far, key, "left").select(key, "k", grown.alias("centers")))
    sizes = F.transform("centers", lambda c: F.lit(0).cast("long"))
    state = state.select(key, F.slice(F.col("centers"), F.lit(2), F.col("k")).alias("centers")).select(key, "centers", sizes.alias("sizes"), F.lit(True).alias("moving"))
    for _ in range(rounds):
        sums = nearest(state.where("moving")).groupBy(key, F.col("__near.i").alias("i")).agg(*weigh)
        sums = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(center.alias("c"), "n")))).alias("sums"))
        fresh = F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("sums", i)["c"], c))
        counts = F.transform("centers", lambda c, i: F.coalesce(F.try_element_at("sums", i)["n"], F.lit(0).cast("long")))
        step = F.array_max(F.zip_with("centers", fresh, lambda a, b: F.greatest(*[F.abs(a[x] - b[x]) for x in "rgb"])))
        known = F.col("sums").isNotNull()
        state = cut_lineage(state.join(sums, key, "left").select(
            key, F.when(known, fresh).otherwise(F.col("centers")).alias("centers"), F.when(known, counts).otherwise(F.col("sizes")).alias("sizes"),
            (known & (step >= still)).alias("moving")))
        if state.where("moving").isEmpty():
            break
    out = state.select(key, (~F.col("moving")).alias("settled"), F.posexplode(F.arrays_zip("centers", "sizes")).alias("cluster", "__c")).where("__c.sizes > 0")
    out = out.select(key, "settled", "cluster", *[F.floor(F.col("__c.centers")[x]).cast("int").alias(x) for x in "rgb"], F.col("__c.sizes").alias("pixels"))
    return out.select(key, "cluster", C.rgb_to_hex("r", "g", "b").alias("color"), "pixels", "settled")


def page_palettes(px: DataFrame, key: str = "page_id", max_colors: int = 8) -> DataFrame:
    """Palette of each page by cluster size; of clusters with one colour the largest counts."""
    found = color_clusters(px, key, max_colors)
    colors = found.groupBy(key, "color").agg(F.min_by(F.struct("pixels", "cluster"), F.struct(-F.col("pixels"), "cluster")).alias("best"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("best.pixels"), "best.cluster"))  # at most max_colors rows
    return colors.select(key, rank.alias("rank"), "color", F.col("best.pixels").alias("pixels"))


def score_clusters(clusters: DataFrame, keys: Sequence[str], skin: Sequence[float] | None = None,
                   prefer_dark: bool = False) -> DataFrame:
    """Best cluster per key by size, saturation, darkness and distance from skin."""
    keys = list(keys)
    hex_rgb = C.hex_to_rgb("color")
    d = clusters.withColumns({f"__{m}": v for m, v in zip("rgb", hex_rgb)})
    _, sat, val = C.rgb_to_hsv("__r", "__g", "__b")
    d = C.with_lab(d, ("__r", "__g", "__b"), ("__cl", "__ca", "__cb"))
    share = F.col("pixels") / F.greatest(F.lit(1), F.sum("pixels").over(W.partitionBy(*keys)))
    score = share * (sat / 255.0 * 0.65 + 0.75)
    if prefer_dark:
        score = score * ((F.lit(255.0) - val) / 255.0 * 0.65 + 0.75)
    if skin is not None:
        apart = C.lab_distance(("__cl", "__ca", "__cb"), [F.lit(float(v)) for v in skin])
        score = score * clip(apart / 24.0, 0.20, 1.25)
    best = F.max_by(F.col("color"), F.struct("score", -F.col("rank")))
    return d.withColumn("score", score).groupBy(*keys).agg(best.alias("color"), F.max("score").alias("score"))


# --- style records -----------------------------------------------------------

def merge_style_globals(refs: DataFrame, fields: Sequence[str], keys: Sequence[str], ord_col: str = "ref_ord",
                        weight: str = "weight") -> DataFrame:
    """Weighted means of numeric fields and the weighted mode of ``temperature``."""
    keys = list(keys)
    means = refs.groupBy(*keys).agg(*[
        C.round_even(F.sum(F.col(f) * F.col(weight)) / F.when(F.sum(weight) != 0, F.sum(weight)).otherwise(1.0), 3).alias(f)
        for f in fields])
    votes = refs.groupBy(*keys, "temperature").agg(F.sum(weight).alias("__v"), F.min(ord_col).alias("__o"))
    mode = votes.groupBy(*keys).agg(
        F.max_by("temperature", F.struct(F.round("__v", 9), -F.col("__o"))).alias("temperature"))
    return means.join(mode, keys)


def merge_style_regions(regions: DataFrame, fields: Sequence[str], keys: Sequence[str],
                        weight: str = "weight") -> DataFrame:
    """Region fields weighted by w * max(1, sqrt(samples / 500)) over contributing references."""
    d = regions.where(F.col("samples") > 0).withColumn(
        "__w", F.col(weight) * F.greatest(F.lit(1.0), F.sqrt(F.col("samples") / 500.0)))
    out = d.groupBy(*keys, "region").agg(
        *[C.round_even(F.sum(F.col(f) * F.col("__w")) / F.sum("__w"), 3).alias(f) for f in fields],
        F.sum("samples").alias("samples"), F.sum("__w").alias("__t"))
    return out.where(F.col("__t") > 0).drop("__t")


def merge_style_palette(colors: DataFrame, keys: Sequence[str], n: int = 12) -> DataFrame:
    """First ``n`` distinct colours in (reference, position) order."""
    first = colors.groupBy(*keys, "color").agg(F.min(F.struct("ref_ord", "pos")).alias("at"))
    return first_per_group(first, keys, ["at.ref_ord", "at.pos"], n, "palette_pos").drop("at")


def mix_profiles(a: DataFrame, b: DataFrame, on: Sequence[str], weight_b: float = 0.5,
                 fields=("saturation", "contrast", "shadow_strength", "gradient")) -> DataFrame:
    """Linear blend of numeric fields; categorical values and palette overlay from b at >= 0.5."""
    w = max(0.0, min(1.0, weight_b))
    d = a.alias("a").join(b.alias("b"), list(on))
    kept = F.map_filter(F.col("a.palette"), lambda k, v: ~F.coalesce(F.map_contains_key(F.col("b.palette"), k), F.lit(False)))
    palette = F.map_concat(kept, F.col("b.palette")) if w >= 0.5 else F.col("a.palette")
    side = "b" if w >= 0.5 else "a"
    return d.select(*on, *[(F.col(f"a.{f}") * (1 - w) + F.col(f"b.{f}") * w).alias(f) for f in fields],
                    F.col(f"{side}.temperature").alias("temperature"), palette.alias("palette"))


# --- regions -----------------------------------------------------------------

def region_stats(px: DataFrame, keys=PAGE, region: str = "region_id", prior: str | None = None) -> DataFrame:
    """Area, box, mean grey, centroid, page share, border contact; one pass plus page extents."""
    keys = list(keys)
    page = px.groupBy(*keys).agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"),
                                 F.max("y").alias("__y1"), F.count(F.lit(1)).alias("__n"))
    aggs = [F.count(F.lit(1)).alias("area"), F.min("x").alias("x"), F.min("y").alias("y"),
            (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
            F.avg("gray").alias("mean_gray"), F.avg("x").alias("cx"), F.avg("y").alias("cy")]
    if prior:
        aggs.append(F.count_if(F.col(prior) > 0).alias("prior_pixels"))
    s = px.where(F.col(region) > 0).groupBy(*keys, region).agg(*aggs).join(page, keys)
    border = ((F.col("x") <= F.col("__x0")) | (F.col("y") <= F.col("__y0"))
              | (F.col("x") + F.col("w") > F.col("__x1")) | (F.col("y") + F.col("h") > F.col("__y1")))
    return (s.withColumn("frac", F.col("area") / F.col("__n")).withColumn("touches_border", border)
            .withColumn("page_area", F.col("__n")).drop("__x0", "__x1", "__y0", "__y1", "__n"))


def keep_regions(stats: DataFrame, n: int, keys=PAGE, region: str = "region_id", min_area: int = 10) -> DataFrame:
    """The ``n`` largest regions of a page plus every region its prior touches."""
    big = first_per_group(stats.where(F.col("area") >= min_area), keys, [F.desc("area"), region], n)
    if "prior_pixels" not in stats.columns:
        return big
    return big.unionByName(stats.where("prior_pixels > 0")).dropDuplicates([*keys, region])


def tone_histogram(px: DataFrame, keys=("page_id", "region_id"), bins: int = 12) -> DataFrame:
    """Normalised grey histogram array per region, with box aspect and page share."""
    keys = list(keys)
    width = 256.0 / bins
    counts = [F.count_if(F.least(F.floor(F.col("gray") / width), F.lit(bins - 1)) == i).alias(f"__h{i}")
              for i in range(bins)]
    s = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.max("x") - F.min("x") + 1) / F.greatest(
            F.lit(1.0), (F.max("y") - F.min("y") + 1).cast("double"))).alias("aspect"), *counts)
    page = px.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("__page_n"))
    hist = F.array(*[F.col(f"__h{i}") / F.greatest(F.lit(1.0), F.col("n").cast("double")) for i in range(bins)])
    return s.join(page, keys[0]).select(*keys, hist.alias("hist"), "aspect",
                                        (F.col("n") / F.col("__page_n")).alias("share"))


def circular_mean(df: DataFrame, keys: Sequence[str], hue: str = "hue", weight: str = "weight") -> DataFrame:
    """Weighted mean on the circle; 0 without weight, the plain median when directions cancel."""
    keys = list(keys)
    rad = F.radians(F.col(hue))
    s = df.groupBy(*keys).agg(F.sum(F.cos(rad) * F.col(weight)).alias("__x"), F.sum(F.sin(rad) * F.col(weight)).alias("__y"),
                              F.sum(weight).alias("__w"))
    empty = F.coalesce("__w", F.lit(0.0)) <= 1e-6
    flat = ~empty & (F.abs("__x") + F.abs("__y") <= 1e-8)
    # Only groups whose directions cancel need a median at all.
    mid = (df.join(s.where(flat).select(*keys), keys, "left_semi").groupBy(*keys)
           .agg(F.expr(f"percentile({hue}, 0.5)").alias("__m")))
    mean = (F.when(empty, 0.0).when(flat, F.col("__m"))
            .otherwise(F.pmod(F.degrees(F.atan2("__y", "__x")), F.lit(360.0))))
    return s.join(mid, keys, "left").select(*keys, mean.alias("circular_mean"))


def percentile_normalize(df: DataFrame, value: str, p: float = 97.0, keys=PAGE, approx: bool = False) -> DataFrame:
    """Divide by the page's p-th percentile and clip to 0..1; zero when the scale vanishes.

    Exact for any numbers and any page size (``exact_percentile``); ``approx`` trades a pass for an error bound.
    """
    if approx:
        scale = df.groupBy(*keys).agg(F.expr(f"percentile_approx({value}, {p / 100.0}, 10000)").cast("double").alias("__scale"))
    else:
        scale = exact_percentile(df, list(keys), value, p / 100.0, "__scale")
    return (df.join(scale, list(keys))
            .withColumn("normalized", F.when(F.col("__scale") <= 1e-6, 0.0)
                        .otherwise(clip(F.col(value) / F.col("__scale"), 0.0, 1.0))).drop("__scale"))


def harmonize_group(px: DataFrame, keys: Sequence[str], member: Column, strength: float = 1.0,
                    min_pixels: int = 32) -> DataFrame:
    """Pull members toward their group's median a, b with a tone-dependent weight."""
    keys = list(keys)
    d = C.with_lab(px).withColumn("__in", member & (F.col("gray") > 18) & (F.col("gray") < 250))
    mid = d.where("__in").groupBy(*keys).agg(
        F.expr("percentile(lab_a, 0.5)").alias("__ma"), F.expr("percentile(lab_b, 0.5)").alias("__mb"),
        F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_pixels)
    alpha = F.when(F.col("__in") & F.col("__n").isNotNull(),
                   clip((F.col("gray") - 18.0) / 80.0, 0.25, 1.0) * strength).otherwise(0.0)

    def pull(c, m):
        return F.col(c) * (F.lit(1.0) - alpha) + F.coalesce(m, F.lit(0.0)) * alpha
    return (d.join(mid, keys, "left")
            .withColumns({"lab_a": pull("lab_a", F.col("__ma")), "lab_b": pull("lab_b", F.col("__mb"))})
            .drop("__in", "__ma", "__mb", "__n"))


# Lock strength, kept texture share and grey range per attribute.
LOCK_STRENGTH = {"hair": 0.92, "eyes": 1.00, "skin": 0.78, "clothing": 0.96}
LOCK_TEXTURE = {"hair": 0.42, "eyes": 0.0, "skin": 0.28, "clothing": 0.06}
LOCK_RANGE = {"hair": (24, 247), "eyes": (42, 220), "skin": (45, 232), "clothing": (34, 240)}


def _by_attr(table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col("attribute") == k, v).otherwise(out)
    return out


def lock_gate() -> Column:
    loose = F.col("attribute").isin("eyes", "clothing")
    sem, score, margin = F.col("semantic_confidence"), F.col("match_score"), F.col("margin")
    passed = (F.when(loose, (sem >= 0.20) & (score >= 0.34) & (margin >= 0.02))
              .otherwise((sem >= 0.32) & (score >= 0.48) & (margin >= 0.055)))
    return F.col("lock_allowed") & (F.col("forced") | passed)


def lock_to_target(px: DataFrame, assignments: DataFrame, strength: float = 1.0,
                   interior: Column | None = None) -> DataFrame:
    """Shift a, b of gated regions toward the nearest allowed target, keeping some texture.

    ``targets`` is an array of rgb arrays (the base colour first); ``preferred`` names
    one by position, or is null. ``interior`` weighs pixels by depth (1 when absent).
    Returns the changed pixels with their new ``lab_a`` and ``lab_b``.
    """
    s = max(0.0, min(1.0, strength))
    inner = interior if interior is not None else F.lit(1.0)
    gated = assignments.where(lock_gate()).select(
        "page_id", "region_id", "attribute", "targets", "preferred", "match_score", "margin",
        "semantic_confidence", "forced", _by_attr({k: v[0] for k, v in LOCK_RANGE.items()}, 24).alias("__g0"),
        _by_attr({k: v[1] for k, v in LOCK_RANGE.items()}, 247).alias("__g1"))
    d = C.with_lab(px).join(gated, ["page_id", "region_id"])
    d = d.where((F.col("gray") > F.col("__g0")) & (F.col("gray") < F.col("__g1")))
    mid = d.groupBy("page_id", "region_id").agg(
        F.expr("percentile(lab_a, 0.5)").alias("__ma"), F.expr("percentile(lab_b, 0.5)").alias("__mb"),
        F.count(F.lit(1)).alias("__n"), F.first("attribute").alias("attribute"), F.first("targets").alias("targets"),
        F.first("preferred").alias("preferred"), F.first("match_score").alias("match_score"),
        F.first("margin").alias("margin"), F.first("semantic_confidence").alias("semantic_confidence"),
        F.first("forced").alias("forced"))
    mid = mid.where(F.col("__n") >= F.when(F.col("attribute") == "eyes", 3).otherwise(8))

    def ranked(t, i):
        return C.let(C._s([C.linear_channel(F.get(t, F.lit(k))) for k in range(3)]), lambda lin: C.let(
            C._s(C._lab_from_linear(*C._u(lin), True)), lambda v: F.struct(
                F.sqrt((v["c1"] - F.col("__ma")) * (v["c1"] - F.col("__ma"))
                       + (v["c2"] - F.col("__mb")) * (v["c2"] - F.col("__mb"))).alias("d"),
                i.alias("i"), v["c1"].alias("a"), v["c2"].alias("b"))))
    mid = mid.withColumn("__t", F.transform("targets", ranked))
    many = F.size("targets") > 1
    nearest, base = F.array_min("__t"), F.get("__t", F.lit(0))
    named = F.get("__t", F.col("preferred"))
    pick = (F.when((F.col("attribute") == "clothing") & many & named.isNotNull(), named)
            .when(F.col("attribute").isin("clothing", "eyes") & many, nearest).otherwise(base))
    mid = mid.withColumn("__pick", pick).withColumn("__variant", F.col("__pick")["i"] > 0)
    conf = F.when(F.col("forced"), 1.0).otherwise(clip(
        F.col("match_score") * 0.40 + F.least(F.lit(1.0), F.col("margin") / 0.15) * 0.25 + 0.35, 0.0, 1.0))
    sem = clip((F.col("semantic_confidence") - 0.25) / 0.55, 0.0, 1.0)
    conf = F.greatest(conf, _by_attr({"eyes": 0.94, "clothing": 0.86}, 0.0))
    sem = F.greatest(sem, _by_attr({"eyes": 0.88, "clothing": 0.72}, 0.0))
    mid = mid.select("page_id", "region_id", "__ma", "__mb", F.col("__pick")["a"].alias("__ta"),
                     F.col("__pick")["b"].alias("__tb"), _by_attr(LOCK_TEXTURE, 0.28).alias("__keep"),
                     (conf * sem * _by_attr(LOCK_STRENGTH, 0.75) * s).alias("__power"),
                     F.when(F.col("attribute") == "clothing", F.when(F.col("__variant"), 1.26).otherwise(1.18))
                     .when(F.col("attribute") == "eyes", 1.18).otherwise(1.0).alias("__gain"),
                     F.when(F.col("attribute") == "clothing", F.when(F.col("__variant"), 0.12).otherwise(0.08))
                     .when(F.col("attribute") == "eyes", 0.06).otherwise(0.0).alias("__lift"))
    out = d.drop("targets", "preferred", "match_score", "margin", "semantic_confidence", "forced", "__g0", "__g1") \
        .join(mid, ["page_id", "region_id"])
    alpha = clip(clip(inner * F.col("__power"), 0.0, 1.0) * F.col("__gain") + inner * F.col("__lift"), 0.0, 1.0)
    out = out.withColumn("alpha", alpha)

    def moved(c, m, t):
        want = F.col(t) + (F.col(c) - F.col(m)) * F.col("__keep")
        return clip(F.col(c) * (F.lit(1.0) - F.col("alpha")) + want * F.col("alpha"), 0.0, 255.0)
    return (out.withColumns({"lab_a": moved("lab_a", "__ma", "__ta"), "lab_b": moved("lab_b", "__mb", "__tb")})
            .drop("__ma", "__mb", "__ta", "__tb", "__keep", "__power", "__gain", "__lift"))


# --- tiles -------------------------------------------------------------------

def tile_origins(extent: Column, tile: int, overlap: int) -> Column:
    """Array of origins that cover the extent, the last one flush with the edge."""
    last = extent - tile
    steps = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(tile - overlap)), lambda v: v < last)
    return F.when(extent <= tile, F.array(F.lit(0))).otherwise(F.array_distinct(F.array_append(steps, last)))


def taper(pos: Column, tile: int, overlap: int) -> Column:
    """Cosine ramp over the first and last ``overlap`` positions of a tile."""
    if overlap <= 0:
        return F.lit(1.0)

    def ramp(i):
        return F.lit(0.5) - F.cos(i / float(max(1, overlap - 1)) * math.pi) * 0.5
    back = F.lit(tile - 1) - pos
    return F.when(back < overlap, ramp(back)).when(pos < overlap, ramp(pos)).otherwise(1.0)


def merge_overlaps(tiles: DataFrame, value: str, tile: int, overlap: int, keys=("page_id", "x", "y")) -> DataFrame:
    """Tapered weighted mean of overlapping tile values per pixel."""
    weight = taper(F.col("x") - F.col("tile_x"), tile, overlap) * taper(F.col("y") - F.col("tile_y"), tile, overlap)
    d = tiles.withColumn("__w", weight)
    return d.groupBy(*keys).agg((F.sum(F.col("__w") * F.col(value))
                                 / F.greatest(F.sum("__w"), F.lit(1e-6))).alias(value))
