"""Page quality: colourfulness reports, bleed and codec metrics, review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators.selection import exact_percentile
from chromaframe.scale import cover_cells, point_cell

HUE_BINS = 12


def color_fraction(px: DataFrame, keys: Sequence[str] = ("page_id",), chroma_min: float = 14.0,
                   share_min: float = 0.03) -> DataFrame:
    """Share of chromatic pixels per page, and whether the page counts as coloured."""
    lab = C.with_lab(px)
    hit = (C.chroma("lab_a", "lab_b") > chroma_min).cast("int")
    return (lab.groupBy(*keys).agg(F.avg(hit).alias("color_fraction"))
            .withColumn("already_colored", F.col("color_fraction") >= share_min))


def quality_report(px: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Score 0..100 with metrics, flags and reasons per page.

    Level one counts equal (content, ink, hue bin, chroma) pixels, which spreads a
    hot page over many groups; level two reads percentiles off those counts.
    """
    keys = list(keys)
    da, db = F.col("lab_a") - 128.0, F.col("lab_b") - 128.0
    level1 = (C.with_hsv(C.with_lab(px), out=("hue", "sat", "val")).select(
        *keys,
        C.is_content("gray").alias("content"), (F.col("gray") < 55).alias("ink"),
        F.when(F.col("sat") >= 24, F.floor(F.col("hue") / 15).cast("int")).otherwise(-1).alias("bin"),
        (da * da + db * db).cast("int").alias("chroma2"))
        .groupBy(*keys, "content", "ink", "bin", "chroma2").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("chroma", F.sqrt("chroma2")))

    def per_bin(flag):
        return F.array(*[F.expr(f"coalesce(sum(n) FILTER (WHERE bin = {i}{flag}), 0L)")
                         for i in range(HUE_BINS)])
    level2 = level1.groupBy(*keys).agg(
        F.expr("coalesce(sum(n) FILTER (WHERE content), 0L)").alias("n_content"),
        F.expr("percentile(chroma, 0.5, n) FILTER (WHERE content)").alias("med_content"),
        F.expr("percentile(chroma, 0.5, n)").alias("med_all"),
        F.expr("percentile(chroma, 0.75, n) FILTER (WHERE ink)").alias("ink_p75"),
        per_bin(" AND content").alias("hist_content"), per_bin("").alias("hist_all"))
    some = F.col("n_content") > 0
    d = (level2
         .withColumn("colorfulness", F.when(some, F.col("med_content")).otherwise(F.col("med_all")))
         .withColumn("ink_chroma", F.coalesce("ink_p75", F.lit(0.0)))
         .withColumn("hist", F.when(some, F.col("hist_content")).otherwise(F.col("hist_all")))
         .withColumn("total", F.aggregate("hist", F.lit(0).cast("long"), lambda s, v: s + v))
         .withColumn("floor_n", F.greatest(F.lit(2.0), F.col("total") * 0.025))
         .withColumn("dominant_hue_ratio", F.when(F.col("total") > 0, F.array_max("hist") / F.col("total"))
                     .otherwise(1.0))
         .withColumn("hue_diversity", F.when(
             F.col("total") > 0, F.size(F.filter("hist", lambda v: v >= F.col("floor_n"))) / 12.0).otherwise(0.0))
         .withColumn("wash", ((F.col("dominant_hue_ratio") > 0.80) & (F.col("hue_diversity") < 0.34))
                     | (F.col("colorfulness") < 7.0))
         .withColumn("bleed", F.col("ink_chroma") > 12.0))
    penalty = (F.when(F.col("wash"), 35).otherwise(0)
               + F.when(F.col("hue_diversity") < 0.20, 15).when(F.col("hue_diversity") < 0.34, 7).otherwise(0)
               + F.when(F.col("bleed"), F.least(F.lit(25), ((F.col("ink_chroma") - 12.0) * 1.5).cast("int") + 8))
               .otherwise(0)
               + F.when(F.col("colorfulness") > 45, 5).otherwise(0))
    reasons = F.filter(F.array(
        F.when(F.col("wash"), F.lit("monochrome_wash")),
        F.when(F.col("hue_diversity") < 0.20, F.lit("low_palette_diversity")),
        F.when(F.col("bleed"), F.lit("colored_ink_or_edge_bleed"))), lambda v: v.isNotNull())
    return d.select(
        *keys, C.clip(F.lit(100) - penalty, 0, 100).cast("int").alias("score"),
        C.round_even("colorfulness", 2).alias("colorfulness"), C.round_even("hue_diversity", 3).alias("hue_diversity"),
        C.round_even("dominant_hue_ratio", 3).alias("dominant_hue_ratio"), C.round_even("ink_chroma", 2).alias("ink_chroma"),
        F.col("wash").alias("wash_detected"), F.col("bleed").alias("line_bleed_detected"),
        reasons.alias("reasons"))


def line_bleed_ratio(px: DataFrame, keys: Sequence[str] = ("page_id",), result=("r2", "g2", "b2")) -> DataFrame:
    """Share of dark source pixels whose result shows chroma; 0 when there is no ink."""
    d = C.with_lab(px.where(F.col("gray") < 58), result, ("__l", "__a", "__b"))
    ink = d.groupBy(*keys).agg(F.avg((C.chroma("__a", "__b") > 11.0).cast("int")).alias("bleed"))
    pages = px.select(*keys).distinct()
    return pages.join(ink, list(keys), "left").fillna({"bleed": 0.0})


def diff_quality(px: DataFrame, keys: Sequence[str] = ("page_id",), original=("r", "g", "b"),
                 decoded=("r2", "g2", "b2")) -> DataFrame:
    """PSNR, mean absolute error, share of errors above 8, and error on dark pixels."""
    diffs = [F.abs(F.col(a) - F.col(b)) for a, b in zip(original, decoded)]
    total = sum(diffs[1:], diffs[0])
    square = sum((v * v for v in diffs[1:]), diffs[0] * diffs[0])
    large = sum(((v > 8).cast("int") for v in diffs[1:]), (diffs[0] > 8).cast("int"))
    dark = C.luma_fast(*original) < 96
    s = px.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(total).alias("__abs"), F.sum(square).alias("__sq"),
                              F.sum(large).alias("__big"), F.sum(F.when(dark, total)).alias("__dabs"),
                              F.count_if(dark).alias("__dn"))
    values = F.greatest(F.lit(1.0), F.col("__n") * 3.0)
    mse = F.col("__sq") / values
    psnr = F.when(mse <= 0.0, F.lit(float("inf"))).otherwise(F.log10(F.lit(65025.0) / mse) * 10.0)
    return s.select(*keys, psnr.alias("psnr_db"), (F.col("__abs") / values).alias("mean_abs_error"),
                    (F.col("__big") / values).alias("large_error_ratio"),
                    F.when(F.col("__dn") > 0, F.col("__dabs") / (F.col("__dn") * 3.0)).otherwise(0.0)
                    .alias("dark_mean_abs_error"))


def diff_quality_or_sentinel(pairs: DataFrame) -> DataFrame:
    """Replace the metrics of pairs whose shapes differ by the worst values."""
    bad = (F.col("width") != F.col("width2")) | (F.col("height") != F.col("height2"))
    worst = {"psnr_db": 0.0, "mean_abs_error": 255.0, "large_error_ratio": 1.0, "dark_mean_abs_error": 255.0}
    return pairs.withColumns({k: F.when(bad, v).otherwise(F.col(k)) for k, v in worst.items()})


# The two guarded encoding attempts and their limits.
ATTEMPT_LIMITS = ((1, "q96-guarded", 45.0, 1.25, 0.0025, 1.55), (2, "q98-guarded", 48.0, 0.90, 0.0012, 1.15))


def first_passing(candidates: DataFrame, keys: Sequence[str] = ("page_id",), limits=ATTEMPT_LIMITS,
                  fallback: str = "lossless-fallback") -> DataFrame:
    """First attempt, in order, that meets all its limits; otherwise the fallback."""
    rule = F.lit(False)
    name = F.lit(None).cast("string")
    for order, label, psnr, mae, large, dark in limits:
        ok = ((F.col("psnr_db") >= psnr) & (F.col("mean_abs_error") <= mae)
              & (F.col("large_error_ratio") <= large) & (F.col("dark_mean_abs_error") <= dark))
        rule = F.when(F.col("attempt") == order, ok).otherwise(rule)
        name = F.when(F.col("attempt") == order, label).otherwise(name)
    d = candidates.withColumns({"__ok": rule, "__name": name})
    return d.groupBy(*keys).agg(F.coalesce(
        F.expr("min_by(__name, attempt) FILTER (WHERE __ok)"), F.lit(fallback)).alias("variant"))


def rank_candidates(px: DataFrame, keys: Sequence[str] = ("page_id",), candidate: str = "candidate",
                    mask: str = "mask") -> DataFrame:
    """Score competing masks against the warm signal, darkness and size; best first.

    One row per (page, candidate, pixel); ``r2, g2, b2`` carry the coloured result.
    """
    px = C.with_hsv(px, ("r2", "g2", "b2"), ("__hue", "__sat", "__val"))
    hue, sat, val = F.col("__hue"), F.col("__sat"), F.col("__val")
    warm = ((hue <= 24) | (hue >= 170)) & (sat >= 72) & (val >= 24)
    d = px.withColumns({"__m": F.col(mask) > 0, "__warm": warm})
    s = d.groupBy(*keys, candidate).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("__m").alias("hair_pixels"), F.count_if("__warm").alias("__w"),
        F.count_if(F.col("__m") & F.col("__warm")).alias("overlap"),
        F.expr("avg(CASE WHEN gray < 160 THEN 1.0D ELSE 0.0D END) FILTER (WHERE __m)").alias("__dark"),
        F.expr("avg(gray) FILTER (WHERE __m)").alias("__gray"))
    one = F.lit(1.0)
    frac = F.col("hair_pixels") / F.greatest(F.lit(1), F.col("__n"))
    recall = F.col("overlap") / F.greatest(F.lit(1), F.col("__w"))
    precision = F.col("overlap") / F.greatest(F.lit(1), F.col("hair_pixels"))
    size = F.when(frac.between(0.00008, 0.30), 1.0).otherwise(F.greatest(F.lit(0.0), one - F.abs(frac - 0.12) * 4.0))
    score = (F.least(one, recall * 2.4) * 0.40 + F.least(one, precision * 5.0) * 0.30
             + F.coalesce("__dark", F.lit(0.0)) * 0.20 + size * 0.10
             - F.when(frac > 0.42, 0.35).otherwise(0.0)
             - F.when(F.coalesce("__gray", F.lit(255.0)) > 215, 0.18).otherwise(0.0))
    score = F.when(F.col("hair_pixels") == 0, -1.0).otherwise(F.round(score, 6))
    out = s.select(*keys, candidate, score.alias("score"), "hair_pixels", F.col("overlap").alias("warm_overlap"),
                   F.round(recall, 6).alias("warm_recall"), F.round(precision, 6).alias("warm_precision"))
    order = W.partitionBy(*keys).orderBy(F.desc("score"), candidate)  # a page has a handful of candidates
    return out.withColumn("rank", F.row_number().over(order))


def export_summary(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("exported"),
                                 F.coalesce(F.sum("original_bytes"), F.lit(0)).cast("long").alias("bytes_before"),
                                 F.coalesce(F.sum("compressed_bytes"), F.lit(0)).cast("long").alias("bytes_after"))
    ratio = F.try_divide(F.col("bytes_after"), F.col("bytes_before"))
    return s.withColumn("saved_percent", F.coalesce(
        F.greatest(F.lit(0.0), (F.lit(1.0) - ratio) * 100.0), F.lit(0.0)))


def review_queue(quality: DataFrame, blobs: DataFrame, drift: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that need a look: low score, hint blobs, or drift alerts, with the reasons."""
    d = quality.join(blobs, key, "left").join(drift, key, "left")
    low, blob = F.col("score") < 60, F.coalesce(F.col("blob_score"), F.lit(0.0)) >= 14.0
    moved = F.coalesce(F.col("drift_alerts"), F.lit(0)) > 0
    why = F.concat_ws(",", F.when(low, F.lit("low_score")), F.when(blob, F.lit("hint_blob")),
                      F.when(moved, F.lit("identity_drift")))
    return d.where(low | blob | moved).withColumn("why", why)


def ring_contrast(points: DataFrame, px: DataFrame, width: int, height: int, threshold: float = 14.0) -> DataFrame:
    """Per hint: Lab distance between the medians of its disc and its ring.

    Points and pixels meet on (page, grid cell), so a busy page spreads over its cells.
    """
    base = points.where(~F.col("source").isin("manual", "eyedropper_hint", "style_only"))
    p = base.select("page_id", "hint_id",
                    F.rint(F.col("x_norm") * width).cast("int").alias("cx"), F.rint(F.col("y_norm") * height).cast("int").alias("cy"),
                    F.rint(F.col("radius_norm") * width).cast("int").alias("rad"))
    pin = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))
    p = p.withColumns({"cx": pin("cx", 0, width - 1), "cy": pin("cy", 0, height - 1), "rad": pin("rad", 2, 8)})
    reach = F.col("rad") * 3

    def side(c, size):
        return F.least(F.lit(size), F.col(c) + reach + 1) - F.greatest(F.lit(0), F.col(c) - reach)
    # Patches below 5 pixels a side are skipped.
    p = p.where((side("cx", width) >= 5) & (side("cy", height) >= 5))
    dist = F.sqrt(F.col("d2").cast("double"))
    core = dist <= F.greatest(F.lit(1.5), F.col("rad") * 0.8)
    ring = (dist >= F.col("rad") * 1.35) & (dist <= F.col("rad") * 2.5)
    lab = C.with_lab(px).select("page_id", "x", "y", "lab_l", "lab_a", "lab_b")
    hit = _around(p, lab, F.floor(F.col("rad") * 2.5), core, ring)
    med = [F.expr(f"percentile({c}, 0.5) FILTER (WHERE {w})").alias(f"{n}_{c}")
           for c in ("lab_l", "lab_a", "lab_b") for n, w in (("in", "core"), ("out", "NOT core"))]
    s = hit.groupBy("page_id", "hint_id").agg(F.count_if("core").alias("n_in"), F.count_if(~F.col("core")).alias("n_out"), *med)
    s = s.where("n_in >= 4 AND n_out >= 8")
    dist = C.lab_distance(("in_lab_l", "in_lab_a", "in_lab_b"), ("out_lab_l", "out_lab_a", "out_lab_b"))
    return s.select("page_id", "hint_id", dist.alias("contrast"), (dist >= threshold).alias("suspicious"))


def _around(points: DataFrame, px: DataFrame, bound, core, ring, cell: int = 8) -> DataFrame:
    """Pixels in a point's core or ring. ``points``: cx, cy, rad; the rules read ``d2`` and ``rad``."""
    p = cover_cells(points, F.col("cx") - bound, F.col("cy") - bound, bound * 2, bound * 2, cell)
    q = point_cell(px, F.col("x"), F.col("y"), cell)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    d = p.join(q, ["page_id", "__cx", "__cy"]).withColumn("d2", dx * dx + dy * dy)
    return d.withColumn("core", core).where(F.col("core") | ring).drop("__cx", "__cy", "d2", "cx", "cy", "rad", "x", "y")


def blob_report(contrast: DataFrame, keys: Sequence[str] = ("page_id",), threshold: float = 14.0) -> DataFrame:
    """80th percentile of the page's contrasts, suspicious count, and the retry flag."""
    rounded = contrast.withColumn("contrast", F.round("contrast", 4))
    score = exact_percentile(rounded, keys, "contrast", 0.8, "blob_score")
    s = contrast.groupBy(*keys).agg(F.count_if("suspicious").alias("suspicious"), F.count(F.lit(1)).alias("checked")).join(score, list(keys))
    s = s.select(*keys, "blob_score", "suspicious", "checked")
    return s.withColumn("retry", (F.col("checked") >= 2) & (F.col("blob_score") >= threshold))


def spot_risk(points: DataFrame, px: DataFrame, width: int, height: int) -> DataFrame:
    """Per hint: mean change inside its core against its ring, between two runs of a page.

    ``px`` holds both runs (r, g, b and r2, g2, b2).
    """
    p = points.where((F.col("source") != "style_only") & (F.col("strength") * F.col("confidence") > 0)).select(
        "page_id", "hint_id", F.bround(F.col("x_norm") * (width - 1)).cast("int").alias("cx"),
        F.bround(F.col("y_norm") * (height - 1)).cast("int").alias("cy"),
        F.greatest(F.lit(2), F.bround(F.col("radius_norm") * width).cast("int")).alias("rad"))
    lab = C.with_lab(C.with_lab(px), ("r2", "g2", "b2"), ("n_l", "n_a", "n_b"))
    da, db = F.col("n_a") - F.col("lab_a"), F.col("n_b") - F.col("lab_b")
    lab = lab.select("page_id", "x", "y", F.sqrt(da * da + db * db).alias("chroma"),
                     F.abs(F.col("n_l") - F.col("lab_l")).alias("light"))
    d2 = F.col("d2")
    core = d2 <= F.pow(F.col("rad") * 0.70, F.lit(2.0))
    ring = (d2 >= F.pow(F.col("rad") * 1.35, F.lit(2.0))) & (d2 <= F.pow(F.col("rad") * 2.20, F.lit(2.0)))
    s = _around(p, lab, F.ceil(F.col("rad") * 2.20), core, ring).groupBy("page_id", "hint_id").agg(
        *[F.expr(f"avg({c}) FILTER (WHERE {w})").alias(f"{n}_{c}") for c in ("chroma", "light")
          for n, w in (("core", "core"), ("ring", "NOT core"))])
    s = s.where("core_chroma IS NOT NULL AND ring_chroma IS NOT NULL")
    gap, light_gap = F.col("core_chroma") - F.col("ring_chroma"), F.col("core_light") - F.col("ring_light")
    risk = ((F.col("core_chroma") >= 4.5) & (gap >= 3.5)) | ((F.col("core_light") >= 6.0) & (light_gap >= 5.0))
    return s.select("page_id", "hint_id", "core_chroma", "ring_chroma", gap.alias("center_ring_gap"),
                    light_gap.alias("light_gap"), risk.alias("spot_risk"))
