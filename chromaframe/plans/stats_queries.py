"""Queries over grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators import stats as A
from chromaframe.plans.registry import hex_sql, hsv_cols, lab_cols, query, r6

_LAB = lab_cols("r", "g", "b")


def _med(cols, p=0.5):
    return ", ".join(f"quantile_cont({c}, {p}) AS c_{c}" for c in cols)


_GROUPS = f"""
WITH s AS (SELECT char_id, attribute, t_r AS r, t_g AS g, t_b AS b, {lab_cols('t_r', 't_g', 't_b')} FROM assignments),
c AS (SELECT char_id, attribute, {_med(('lab_l', 'lab_a', 'lab_b', 'r', 'g', 'b'))} FROM s GROUP BY 1, 2),
d AS (SELECT s.char_id, s.attribute, sqrt((lab_l - c_lab_l) ** 2 + (lab_a - c_lab_a) ** 2 + (lab_b - c_lab_b) ** 2) AS dist,
        CAST(trunc(c_r) AS INT) AS cr, CAST(trunc(c_g) AS INT) AS cg, CAST(trunc(c_b) AS INT) AS cb
      FROM s JOIN c ON s.char_id = c.char_id AND s.attribute = c.attribute),
g AS (SELECT char_id, attribute, count(*) AS samples, avg(dist) AS m, max(dist) AS x, first(cr) AS cr, first(cg) AS cg, first(cb) AS cb
      FROM d GROUP BY 1, 2)"""


def _samples(t):
    return t.assignments.selectExpr("char_id AS character", "attribute", "t_r AS r", "t_g AS g", "t_b AS b")


@query("identity_groups", f"""{_GROUPS}
SELECT char_id AS character, attribute, samples, round(m, 6) AS delta_e_mean, round(x, 6) AS delta_e_max,
       cr AS center_r, cg AS center_g, cb AS center_b FROM g""")
def _(t):
    return A.identity_groups(_samples(t)).select(
        "character", "attribute", "samples", r6("delta_e_mean", "delta_e_mean"), r6("delta_e_max", "delta_e_max"),
        "center_r", "center_g", "center_b")


@query("identity_delta", f"""{_GROUPS}, gl AS (SELECT *, {lab_cols('cr', 'cg', 'cb', 'k_')} FROM g),
pr AS (SELECT min(sqrt((a.k_lab_l - b.k_lab_l) ** 2 + (a.k_lab_a - b.k_lab_a) ** 2 + (a.k_lab_b - b.k_lab_b) ** 2)) AS v
       FROM gl a JOIN gl b ON a.attribute = b.attribute AND a.char_id < b.char_id)
SELECT round(sum(m * samples) / sum(samples), 6) AS same_mean, round(max(x), 6) AS same_max, count(*) AS sample_groups,
       round(first(v), 6) AS different_min FROM g, pr""")
def _(t):
    return A.identity_delta(_samples(t)).select(r6("same_mean", "same_mean"), r6("same_max", "same_max"),
                                                "sample_groups", r6("different_min", "different_min"))


@query("assignment_metrics", """
WITH d AS (SELECT page_id % 7 AS book, label, CAST(conf >= 0.3 AS INT) AS matched, CAST(conf BETWEEN 0.3 AND 0.5 AS INT) AS ambiguous,
             CAST(conf < 0.3 AS INT) AS unmatched, CAST(conf > 0.5 AS INT) AS lr, CAST(conf <= 0.5 AND label <> 'sky' AS INT) AS sk FROM regions),
s AS (SELECT book, CAST(sum(matched) AS BIGINT) AS m, CAST(sum(ambiguous) AS BIGINT) AS a, CAST(sum(unmatched) AS BIGINT) AS u,
        sum(lr) AS k, sum(sk) AS s FROM d GROUP BY book)
SELECT book, round(m / CAST(nullif(m + u, 0) AS DOUBLE), 6) AS coverage, round(a / CAST(nullif(m, 0) AS DOUBLE), 6) AS ambiguous_ratio,
       round(k / CAST(nullif(k + s, 0) AS DOUBLE), 6) AS lock_coverage, m AS matched, a AS ambiguous, u AS unmatched FROM s""")
def _(t):
    d = t.regions.selectExpr(
        "page_id % 7 AS book", "CAST(conf >= 0.3 AS INT) AS matched", "CAST(conf BETWEEN 0.3 AND 0.5 AS INT) AS ambiguous",
        "CAST(conf < 0.3 AS INT) AS unmatched", "CAST(conf > 0.5 AS INT) AS lock_regions",
        "CAST(conf <= 0.5 AND label <> 'sky' AS INT) AS skipped_lock_regions")
    return A.assignment_metrics(d, ["book"]).select(
        "book", r6("coverage", "coverage"), r6("ambiguous_ratio", "ambiguous_ratio"),
        r6("lock_coverage", "lock_coverage"), "matched", "ambiguous", "unmatched")


def _sep(p, r, g, b):
    return (f"{p}p AS (SELECT page_id, region_id, {lab_cols(r, g, b)} FROM cells WHERE region_id > 0), "
            f"{p}m AS (SELECT page_id, region_id, {_med(('lab_l', 'lab_a', 'lab_b'))} FROM {p}p GROUP BY 1, 2), "
            f"{p}d AS (SELECT a.page_id, min(sqrt((a.c_lab_l - b.c_lab_l) ** 2 + (a.c_lab_a - b.c_lab_a) ** 2 + (a.c_lab_b - b.c_lab_b) ** 2)) AS v "
            f"FROM {p}m a JOIN {p}m b ON a.page_id = b.page_id AND a.region_id < b.region_id GROUP BY 1)")


@query("separation_retention", f"""WITH {_sep('a', 'r', 'g', 'b')}, {_sep('z', 'r2', 'g2', 'b2')}
SELECT ad.page_id, round(ad.v, 6) AS before_min, round(zd.v, 6) AS after_min, round(zd.v / greatest(0.000001, ad.v), 6) AS retention
FROM ad JOIN zd ON ad.page_id = zd.page_id""")
def _(t):
    return A.separation_retention(t.cells).select("page_id", r6("before_min", "before_min"),
                                                  r6("after_min", "after_min"), r6("retention", "retention"))


_USABLE = "sat > 18 AND val > 20 AND val < 248"


def _robust(min_n, usable=_USABLE):
    return (f"u AS (SELECT page_id, region_id, r, g, b, {hsv_cols('r', 'g', 'b')} FROM cells WHERE region_id > 0), "
            f"m AS (SELECT page_id, region_id, count(*) AS n, count(*) FILTER (WHERE {usable}) AS n_ok, "
            + ", ".join(f"CASE WHEN n_ok >= {min_n} THEN quantile_cont({c}, 0.5) FILTER (WHERE {usable}) ELSE quantile_cont({c}, 0.5) END AS med_{c}"
                        for c in "rgb") + " FROM u GROUP BY 1, 2)")


@query("robust_median", f"WITH {_robust(30)} SELECT page_id, region_id, n, n_ok, med_r, med_g, med_b FROM m")
def _(t):
    _, sat, val = C.rgb_to_hsv("r", "g", "b")
    return A.robust_median(t.cells.where("region_id > 0"), ["page_id", "region_id"],
                           C.is_usable(sat, val, 18, 20, 248), 30)


@query("scene_palette", f"""WITH {_robust(8)},
w AS (SELECT page_id, region_id, CASE WHEN label = 'sky' THEN 'sky' WHEN label = 'clothing' THEN 'water' ELSE label END AS label,
        greatest(1.0, area * conf) AS weight FROM regions WHERE conf >= 0.30),
j AS (SELECT label, weight, med_r, med_g, med_b FROM m JOIN w ON m.page_id = w.page_id AND m.region_id = w.region_id WHERE n >= 12 AND label IN ('sky', 'water')),
s AS (SELECT label, {', '.join(f'CAST(trunc(sum(med_{c} * weight) / sum(weight)) AS INT) AS {c}' for c in 'rgb')}, count(*) AS regions FROM j GROUP BY label)
SELECT label, {hex_sql('r', 'g', 'b')} AS color, regions FROM s""")
def _(t):
    regions = t.regions.withColumn("label", F.when(F.col("label") == "clothing", "water").otherwise(F.col("label")))
    return A.scene_palette(t.cells, regions)


def _tier_sql():
    def mean(v, flag):
        return f"avg({v}) FILTER (WHERE {flag})"
    return f"""
WITH p AS (SELECT page_id, region_id, {_LAB}, lab_a - 128 AS a, lab_b - 128 AS bb, sqrt((lab_a - 128) ** 2 + (lab_b - 128) ** 2) AS ch FROM cells),
q AS (SELECT page_id, region_id, count(*) AS n, quantile_cont(lab_l, 0.25) AS q1, quantile_cont(lab_l, 0.75) AS q3, min(lab_l) AS mn, max(lab_l) AS mx FROM p GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN n >= 8 THEN q1 ELSE 100 END AS l0, CASE WHEN n >= 8 THEN q3 ELSE 160 END AS h0,
        CASE WHEN h0 - l0 < 12 THEN mn ELSE l0 END AS lo, CASE WHEN h0 - l0 < 12 THEN mx ELSE h0 END AS hi FROM q),
f AS (SELECT p.*, lab_l >= hi AS is_hi, lab_l <= lo AS is_sh, NOT is_hi AND NOT is_sh AS is_mid FROM p JOIN k ON p.page_id = k.page_id AND p.region_id = k.region_id),
s AS (SELECT page_id, region_id, count(*) AS n, stddev_pop(lab_l) AS sd,
   coalesce({mean('a', 'is_mid')}, avg(a)) AS ma, coalesce({mean('bb', 'is_mid')}, avg(bb)) AS mb, coalesce({mean('ch', 'is_mid')}, avg(ch)) AS mc,
   coalesce({mean('a', 'is_hi')}, ma) AS ha, coalesce({mean('bb', 'is_hi')}, mb) AS hb, {mean('ch', 'is_hi')} AS hc,
   coalesce({mean('a', 'is_sh')}, ma) AS sa, coalesce({mean('bb', 'is_sh')}, mb) AS sb, coalesce({mean('ch', 'is_sh')}, mc) AS sc FROM f GROUP BY 1, 2),
o AS (SELECT *, greatest(mc, 0.001) AS bs FROM s)
SELECT page_id, region_id, n AS count, round(ma, 6) AS mid_a, round(mb, 6) AS mid_b, round(mc, 6) AS chroma_mid,
   round(greatest(0.0, least(1.0, sd / 60)), 6) AS gradient, round(greatest(0.0, least(1.0, 1 - sc / bs)), 6) AS sh_desat,
   round(coalesce(greatest(0.0, least(1.0, 1 - hc / bs)), 0), 6) AS hi_desat,
   round_even(greatest(-15.0, least(15.0, mb)), 2) AS warm_bias, round_even(greatest(-12.0, least(12.0, sb - mb)), 2) AS shadow_bias,
   round_even(greatest(-12.0, least(12.0, ha - ma)), 2) AS highlight_hue_rotate,
   round_even(greatest(0.4, least(2.0, bs / 18)), 3) AS saturation_scale FROM o"""


@query("tone_tier_stats", _tier_sql())
def _(t):
    d = A.tone_tier_stats(t.cells, ["page_id", "region_id"])
    return d.select("page_id", "region_id", "count", *[r6(c, c) for c in (
        "mid_a", "mid_b", "chroma_mid", "gradient", "sh_desat", "hi_desat")],
        "warm_bias", "shadow_bias", "highlight_hue_rotate", "saturation_scale")


def _global_sql():
    chrom, nonp = "sat > 30 AND val > 25 AND val < 245", "gray > 20 AND gray < 245"
    picks = ", ".join(
        f"CASE WHEN nc > 0 THEN avg(lab_{c}) FILTER (WHERE {chrom}) WHEN nn > 0 THEN avg(lab_{c}) FILTER (WHERE {nonp}) ELSE avg(lab_{c}) END AS m{c}, "
        f"CASE WHEN nc > 0 THEN stddev_pop(lab_{c}) FILTER (WHERE {chrom}) WHEN nn > 0 THEN stddev_pop(lab_{c}) FILTER (WHERE {nonp}) ELSE stddev_pop(lab_{c}) END AS s{c}"
        for c in "lab")
    return f"""
WITH p AS (SELECT page_id, gray, {_LAB}, {hsv_cols('r', 'g', 'b')} FROM px),
a AS (SELECT page_id, count(*) FILTER (WHERE {chrom}) AS nc, count(*) FILTER (WHERE {nonp}) AS nn,
   avg(sat) FILTER (WHERE {chrom}) / 255.0 AS sm, avg(CASE WHEN hue < 30 OR hue > 150 THEN 1.0 ELSE 0.0 END) FILTER (WHERE {chrom}) AS wf,
   stddev_pop(gray) AS gs, avg(CASE WHEN gray < 90 THEN 1.0 ELSE 0.0 END) AS sh,
   coalesce(avg(lab_b - 128) FILTER (WHERE lab_l > 100 AND lab_l < 160), 0) AS gb, quantile_cont(gray, 0.15) AS dk, {picks} FROM p GROUP BY page_id)
SELECT page_id, round(CASE WHEN nc > 0 THEN sm ELSE 0 END, 6) AS saturation, round(least(1.0, gs / 80), 6) AS contrast,
   CASE WHEN nc > 0 AND wf > 0.58 THEN 'warm' WHEN nc > 0 AND wf < 0.42 THEN 'cool' ELSE 'neutral' END AS temperature,
   round(sh, 6) AS shadow_strength, round(gb, 6) AS global_mid_b, round(least(1.0, dk / 40), 6) AS shadow_lift,
   round(ml, 6) AS lab_mean_l, round(ma, 6) AS lab_mean_a, round(mb, 6) AS lab_mean_b,
   round(greatest(1.0, sl), 6) AS lab_std_l, round(greatest(4.0, sa), 6) AS lab_std_a, round(greatest(4.0, sb), 6) AS lab_std_b FROM a"""


@query("global_color_stats", _global_sql())
def _(t):
    d = A.global_color_stats(t.px)
    return d.select("page_id", "temperature", *[r6(c, c) for c in (
        "saturation", "contrast", "shadow_strength", "global_mid_b", "shadow_lift", "lab_mean_l", "lab_mean_a",
        "lab_mean_b", "lab_std_l", "lab_std_a", "lab_std_b")])


@query("corpus_palette")
def _(t):
    return A.corpus_palette(t.px)


_REFS = """
SELECT CAST(l_suppkey AS INT) AS style_id, l_orderkey * 10 + l_linenumber AS ref_ord, l_quantity AS weight,
       CAST(l_discount * 10 AS DOUBLE) AS saturation, CAST(l_tax * 10 AS DOUBLE) AS contrast,
       CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' ELSE 'neutral' END AS temperature,
       CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'hair' WHEN 1 THEN 'sky' ELSE 'skin' END AS region,
       CAST((l_partkey * 7) % 2000 - 200 AS BIGINT) AS samples, CAST((l_partkey * 3) % 40 AS DOUBLE) / 8 AS warm_bias
FROM lineitem"""


def _refs(t):
    return t.spark.sql(_REFS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t.lineitem)


@query("merge_style_globals", f"""
WITH r AS ({_REFS}), m AS (SELECT style_id, round_even(sum(saturation * weight) / sum(weight), 3) AS saturation,
        round_even(sum(contrast * weight) / sum(weight), 3) AS contrast FROM r GROUP BY 1),
v AS (SELECT style_id, temperature, sum(weight) AS v, min(ref_ord) AS o FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY round(v, 9) DESC, o) AS rn FROM v)
SELECT m.style_id, saturation, contrast, temperature FROM m JOIN k ON m.style_id = k.style_id AND rn = 1""")
def _(t):
    return A.merge_style_globals(_refs(t), ["saturation", "contrast"], ["style_id"])


@query("merge_style_regions", f"""
WITH r AS ({_REFS}), w AS (SELECT *, weight * greatest(1.0, sqrt(samples / CAST(500 AS DOUBLE))) AS w FROM r WHERE samples > 0)
SELECT style_id, region, round_even(sum(warm_bias * w) / sum(w), 3) AS warm_bias, CAST(sum(samples) AS BIGINT) AS samples FROM w GROUP BY 1, 2""")
def _(t):
    return A.merge_style_regions(_refs(t), ["warm_bias"], ["style_id"])


@query("merge_style_palette", f"""
WITH r AS ({_REFS}), c AS (SELECT style_id, ref_ord, CAST(samples % 30 AS INT) AS pos, {hex_sql('samples % 16 * 16', 'weight * 5', '100')} AS color FROM r),
f AS (SELECT style_id, color, min(ref_ord * 1000 + pos) AS o FROM c GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY o) AS palette_pos FROM f)
SELECT style_id, color, CAST(palette_pos AS INT) AS palette_pos FROM k WHERE palette_pos <= 12""")
def _(t):
    d = _refs(t).withColumn("pos", (F.col("samples") % 30).cast("int")).withColumn(
        "color", C.rgb_to_hex(F.col("samples") % 16 * 16, F.col("weight") * 5, F.lit(100)))
    return A.merge_style_palette(d, ["style_id"])


@query("mix_profiles", """
SELECT a.o_orderkey AS pair, round(a.v * 0.4 + b.v * 0.6, 6) AS saturation, b.t AS temperature,
       'k' || (b.o_custkey % 3) || '=' || b.o_custkey AS from_b,
       CASE WHEN a.o_custkey % 3 <> b.o_custkey % 3 THEN 'k' || (a.o_custkey % 3) || '=' || a.o_custkey END AS from_a
FROM (SELECT *, CAST(o_custkey % 100 AS DOUBLE) / 100 AS v FROM orders) a
JOIN (SELECT *, CAST(o_custkey % 90 AS DOUBLE) / 90 AS v, o_orderstatus AS t FROM orders) b ON b.o_orderkey = a.o_orderkey + 1""")
def _(t):
    def side(shift, mod):
        return t.orders.select(
            (F.col("o_orderkey") - shift).alias("pair"), (F.col("o_custkey") % mod / float(mod)).alias("saturation"),
            F.col("o_orderstatus").alias("temperature"),
            F.create_map(F.concat(F.lit("k"), F.col("o_custkey") % 3), F.col("o_custkey").cast("string")).alias("palette"),
            (F.col("o_custkey") % 3).alias("slot"))
    a, b = side(0, 100), side(1, 90)
    d = A.mix_profiles(a.drop("slot"), b.drop("slot"), ["pair"], 0.6, ["saturation"])
    d = d.join(a.select("pair", F.col("slot").alias("sa")), "pair").join(b.select("pair", F.col("slot").alias("sb")), "pair")
    name = lambda c: F.concat(F.lit("k"), F.col(c))
    show = lambda c: F.concat(name(c), F.lit("="), F.try_element_at("palette", name(c)))
    return d.select("pair", r6("saturation", "saturation"), "temperature", show("sb").alias("from_b"),
                    F.when(F.col("sa") != F.col("sb"), show("sa")).alias("from_a"))


_RSTAT = """
WITH e AS (SELECT page_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM cells GROUP BY 1),
s AS (SELECT c.page_id, region_id, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h,
        avg(gray) AS mg, avg(x) AS cx, avg(y) AS cy, count(*) FILTER (WHERE in_mask > 0) AS prior_pixels,
        first(x0) AS x0, first(x1) AS x1, first(y0) AS y0, first(y1) AS y1, first(n) AS n
      FROM cells c JOIN e ON c.page_id = e.page_id WHERE region_id > 0 GROUP BY 1, 2)"""


@query("region_stats", f"""{_RSTAT}
SELECT page_id, region_id, area, x, y, w, h, round(mg, 6) AS mean_gray, round(cx, 6) AS cx, round(cy, 6) AS cy, prior_pixels,
       round(area / CAST(n AS DOUBLE), 6) AS frac, (x <= x0 OR y <= y0 OR x + w > x1 OR y + h > y1) AS touches_border FROM s""")
def _(t):
    d = A.region_stats(t.cells, prior="in_mask")
    return d.select("page_id", "region_id", "area", "x", "y", "w", "h", r6("mean_gray", "mean_gray"), r6("cx", "cx"),
                    r6("cy", "cy"), "prior_pixels", r6("frac", "frac"), "touches_border")


@query("keep_regions", """
WITH s AS (SELECT page_id, region_id, area, CAST(conf * 100 AS INT) % 11 = 0 AS touched FROM regions),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, region_id) AS rn FROM s WHERE area >= 5000)
SELECT page_id, region_id, area FROM k WHERE rn <= 9 UNION SELECT page_id, region_id, area FROM s WHERE touched""")
def _(t):
    d = t.regions.withColumn("prior_pixels", F.expr("CAST(CAST(conf * 100 AS INT) % 11 = 0 AS INT)"))
    return A.keep_regions(d, 9, min_area=5000).select("page_id", "region_id", "area")


@query("tone_histogram", """
WITH n AS (SELECT page_id, count(*) AS pn FROM cells GROUP BY 1),
s AS (SELECT page_id, region_id, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (WHERE least(11, floor(gray / (256.0 / 12))) = {i}) AS h{i}" for i in range(12)) + """,
  (max(x) - min(x) + 1) / CAST(max(y) - min(y) + 1 AS DOUBLE) AS asp FROM cells GROUP BY 1, 2)
SELECT s.page_id, region_id, round(h0 / CAST(n AS DOUBLE), 6) AS first_bin, round(h11 / CAST(n AS DOUBLE), 6) AS last_bin,
  round(""" + " + ".join(f"{i + 1} * (h{i} / CAST(n AS DOUBLE))" for i in range(12)) + """, 6) AS moment,
  round(asp, 6) AS aspect, round(n / CAST(pn AS DOUBLE), 6) AS share FROM s JOIN n ON s.page_id = n.page_id""")
def _(t):
    d = A.tone_histogram(t.cells)
    moment = F.aggregate(F.transform("hist", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return d.select("page_id", "region_id", r6(F.get("hist", F.lit(0)), "first_bin"),
                    r6(F.get("hist", F.lit(11)), "last_bin"), r6(moment, "moment"), r6("aspect", "aspect"),
                    r6("share", "share"))


@query("circular_mean", """
SELECT page_id, region_id, round(CASE WHEN sum(w) <= 0.000001 THEN 0.0
   ELSE (degrees(atan2(sum(sin(radians(h)) * w), sum(cos(radians(h)) * w))) + 360) % 360 END, 5) AS circular_mean
FROM (SELECT page_id, region_id, CAST(r * 360 AS DOUBLE) / 256 AS h, CASE WHEN region_id = 3 THEN 0.0 ELSE CAST(strength AS DOUBLE) END AS w FROM hints) z GROUP BY 1, 2""")
def _(t):
    d = t.hints.select("page_id", "region_id", (F.col("r") * 360 / 256.0).alias("hue"),
                       F.when(F.col("region_id") == 3, 0.0).otherwise(F.col("strength")).alias("weight"))
    return A.circular_mean(d, ["page_id", "region_id"]).select(
        "page_id", "region_id", F.round("circular_mean", 5).alias("circular_mean"))


@query("percentile_normalize", """
WITH s AS (SELECT page_id, quantile_cont(gray, 0.9) AS sc FROM px GROUP BY 1)
SELECT px.page_id, x, y, round(CASE WHEN sc <= 0.000001 THEN 0 ELSE least(1.0, gray / sc) END, 6) AS normalized
FROM px JOIN s ON px.page_id = s.page_id""")
def _(t):
    return A.percentile_normalize(t.px, "gray", 90.0).select("page_id", "x", "y", r6("normalized", "normalized"))


@query("harmonize_group", f"""
WITH p AS (SELECT page_id, x, y, gray, {_LAB}, region_id % 3 = 1 AND gray > 18 AND gray < 250 AS ok, region_id FROM cells),
m AS (SELECT page_id, region_id % 3 AS grp, quantile_cont(lab_a, 0.5) FILTER (WHERE ok) AS ma, quantile_cont(lab_b, 0.5) FILTER (WHERE ok) AS mb,
        count(*) FILTER (WHERE ok) AS n FROM p GROUP BY 1, 2),
k AS (SELECT p.*, ma, mb, CASE WHEN ok AND n >= 32 THEN greatest(0.25, least(1.0, (gray - 18.0) / 80)) * 0.5 ELSE 0 END AS al
      FROM p JOIN m ON p.page_id = m.page_id AND p.region_id % 3 = m.grp)
SELECT page_id, x, y, round(lab_a * (1 - al) + coalesce(ma, 0) * al, 6) AS lab_a, round(lab_b * (1 - al) + coalesce(mb, 0) * al, 6) AS lab_b FROM k""")
def _(t):
    d = t.cells.withColumn("grp", F.col("region_id") % 3)
    return A.harmonize_group(d, ["page_id", "grp"], F.col("grp") == 1, 0.5).select(
        "page_id", "x", "y", r6("lab_a", "lab_a"), r6("lab_b", "lab_b"))


_BYATTR = lambda d, e: "CASE attribute " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + f" ELSE {e} END"

_LOCK = f"""
WITH a AS (SELECT *, t_b AS u_r, t_r AS u_g, t_g AS u_b FROM assignments WHERE lock_allowed AND (forced OR CASE WHEN attribute IN ('eyes', 'clothing')
     THEN semantic_confidence >= 0.20 AND match_score >= 0.34 AND margin >= 0.02 ELSE semantic_confidence >= 0.32 AND match_score >= 0.48 AND margin >= 0.055 END)),
al AS (SELECT *, {lab_cols('t_r', 't_g', 't_b', 't1_')}, {lab_cols('u_r', 'u_g', 'u_b', 't2_')}, attribute IN ('eyes', 'clothing') AS two FROM a),
p AS (SELECT c.page_id, x, y, gray, c.region_id, {lab_cols('c.r', 'c.g', 'c.b')} FROM cells c),
j AS (SELECT p.page_id, p.x, p.y, p.gray, p.region_id, p.lab_a, p.lab_b, al.attribute, match_score, margin, semantic_confidence, forced, two, t1_lab_a, t1_lab_b, t2_lab_a, t2_lab_b
      FROM p JOIN al ON p.page_id = al.page_id AND p.region_id = al.region_id
      WHERE gray > {_BYATTR({k: v[0] for k, v in A.LOCK_RANGE.items()}, 24)} AND gray < {_BYATTR({k: v[1] for k, v in A.LOCK_RANGE.items()}, 247)}),
m AS (SELECT page_id, region_id, quantile_cont(lab_a, 0.5) AS ma, quantile_cont(lab_b, 0.5) AS mb, count(*) AS n FROM j GROUP BY 1, 2),
k AS (SELECT j.*, ma, mb, n, two AND sqrt((t2_lab_a - ma) ** 2 + (t2_lab_b - mb) ** 2) < sqrt((t1_lab_a - ma) ** 2 + (t1_lab_b - mb) ** 2) AS v2,
   CASE WHEN v2 THEN t2_lab_a ELSE t1_lab_a END AS ta, CASE WHEN v2 THEN t2_lab_b ELSE t1_lab_b END AS tb,
   greatest(CASE WHEN forced THEN 1.0 ELSE greatest(0.0, least(1.0, 0.35 + 0.40 * match_score + 0.25 * least(1.0, margin / 0.15))) END, {_BYATTR({'eyes': 0.94, 'clothing': 0.86}, 0.0)}) AS cf,
   greatest(greatest(0.0, least(1.0, (semantic_confidence - 0.25) / 0.55)), {_BYATTR({'eyes': 0.88, 'clothing': 0.72}, 0.0)}) AS sg,
   least(1.0, 0.9 * {_BYATTR(A.LOCK_STRENGTH, 0.75)} * cf * sg) AS a0,
   least(1.0, CASE attribute WHEN 'clothing' THEN a0 * (CASE WHEN v2 THEN 1.26 ELSE 1.18 END) + (CASE WHEN v2 THEN 0.12 ELSE 0.08 END)
        WHEN 'eyes' THEN a0 * 1.18 + 0.06 ELSE a0 END) AS al, {_BYATTR(A.LOCK_TEXTURE, 0.28)} AS keep
   FROM j JOIN m ON j.page_id = m.page_id AND j.region_id = m.region_id WHERE n >= CASE WHEN attribute = 'eyes' THEN 3 ELSE 8 END)
SELECT page_id, x, y, round(al, 6) AS alpha, round(greatest(0.0, least(255.0, lab_a * (1 - al) + (ta + (lab_a - ma) * keep) * al)), 6) AS lab_a,
       round(greatest(0.0, least(255.0, lab_b * (1 - al) + (tb + (lab_b - mb) * keep) * al)), 6) AS lab_b FROM k"""


@query("lock_to_target", _LOCK)
def _(t):
    base, other = F.array("t_r", "t_g", "t_b"), F.array("t_b", "t_r", "t_g")
    a = t.assignments.withColumn("targets", F.when(F.col("attribute").isin("eyes", "clothing"), F.array(base, other))
                                 .otherwise(F.array(base))).withColumn("preferred", F.lit(None).cast("int"))
    return A.lock_to_target(t.cells, a, 0.9).select("page_id", "x", "y", r6("alpha", "alpha"), r6("lab_a", "lab_a"),
                                                    r6("lab_b", "lab_b"))


def _ramp_sql(p):
    r = lambda i: f"(0.5 - cos({i} / CAST(3 AS DOUBLE) * pi()) * 0.5)"
    return f"CASE WHEN 15 - {p} < 4 THEN {r(f'(15 - {p})')} WHEN {p} < 4 THEN {r(p)} ELSE 1.0 END"


@query("merge_overlaps", f"""
WITH o AS (SELECT page_id, x, y, r, unnest([0, 12, 16]) AS tile_x FROM px),
q AS (SELECT *, unnest([0, 12, 16]) AS tile_y FROM o),
k AS (SELECT *, r + tile_x * 0.5 + tile_y * 0.25 AS v, ({_ramp_sql('(x - tile_x)')}) * ({_ramp_sql('(y - tile_y)')}) AS w
      FROM q WHERE x >= tile_x AND x < tile_x + 16 AND y >= tile_y AND y < tile_y + 16)
SELECT page_id, x, y, round(sum(w * v) / greatest(sum(w), 0.000001), 5) AS v FROM k GROUP BY 1, 2, 3""")
def _(t):
    d = t.px.select("page_id", "x", "y", "r", F.explode(A.tile_origins(F.lit(32), 16, 4)).alias("tile_x"))
    d = d.withColumn("tile_y", F.explode(A.tile_origins(F.lit(32), 16, 4)))
    d = d.where("x >= tile_x AND x < tile_x + 16 AND y >= tile_y AND y < tile_y + 16")
    d = d.withColumn("v", F.col("r") + F.col("tile_x") * 0.5 + F.col("tile_y") * 0.25)
    return A.merge_overlaps(d, "v", 16, 4).select("page_id", "x", "y", F.round("v", 5).alias("v"))
