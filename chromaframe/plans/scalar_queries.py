"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions import geometry as G
from chromaframe.functions import palette as P
from chromaframe.functions import points as H
from chromaframe.functions import style as S
from chromaframe.functions import vectors as V
from chromaframe.plans.registry import hex_sql, hsv_cols, lab_cols, query, r6, rgb_cols


@query("hex_codec", f"""
SELECT page_id, x, y, {hex_sql('r + 20', 'g - 10', 'b')} AS hex,
       least(255, r + 20) AS back_r, greatest(0, g - 10) AS back_g, b AS back_b,
       CAST(NULL AS INTEGER) AS bad FROM px""")
def _(t):
    d = t.px.withColumn("hex", C.rgb_to_hex(F.col("r") + 20, F.col("g") - 10, "b"))
    r, g, b = C.hex_to_rgb("hex")
    return d.select("page_id", "x", "y", "hex", r.alias("back_r"), g.alias("back_g"), b.alias("back_b"),
                    C.hex_channel(F.concat("hex", F.lit("z")), 0).alias("bad"))


@query("gray_hsv_hls", f"""
SELECT page_id, x, y, CAST(floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5) AS INT) AS gray8,
       (77 * r + 150 * g + 29 * b + 128) >> 8 AS luma, {hsv_cols('r', 'g', 'b', 'k_')},
       CAST(k_hue AS INT) AS hue, CAST(k_sat AS INT) AS sat, k_val AS val,
       least(r, g, b) AS lo, round(CASE WHEN k_sext < 0 THEN k_sext * 60 + 360 ELSE k_sext * 60 END, 6) AS hls_h,
       round((k_val + lo) / CAST(510.0 AS DOUBLE), 6) AS hls_l,
       round(CASE WHEN k_span = 0 THEN 0.0 WHEN k_val + lo < 255 THEN k_span / CAST(k_val + lo AS DOUBLE)
            ELSE k_span / CAST(510.0 - k_val - lo AS DOUBLE) END, 6) AS hls_s
FROM px""".replace("SELECT page_id, x, y, CAST(floor", "SELECT page_id, x, y, gray8, luma, hue, sat, val, hls_h, hls_l, hls_s FROM (SELECT page_id, x, y, CAST(floor") + ")")
def _(t):
    h, s, v = C.rgb_to_hsv("r", "g", "b")
    hh, hl, hs = C.rgb_to_hls("r", "g", "b")
    return t.px.select("page_id", "x", "y", C.rgb_to_gray("r", "g", "b").alias("gray8"),
                       C.luma_fast("r", "g", "b").alias("luma"), h.alias("hue"), s.alias("sat"), v.alias("val"),
                       r6(hh, "hls_h"), r6(hl, "hls_l"), r6(hs, "hls_s"))


@query("lab_round_trip", f"""
WITH a AS (SELECT *, {lab_cols('r', 'g', 'b')} FROM px),
b AS (SELECT *, {rgb_cols('lab_l', 'lab_a', 'lab_b')} FROM a)
SELECT page_id, x, y, lab_l, lab_a, lab_b, o_r AS back_r, o_g AS back_g, o_b AS back_b FROM b""")
def _(t):
    return C.with_rgb(C.with_lab(t.px)).select(
        "page_id", "x", "y", "lab_l", "lab_a", "lab_b", "back_r", "back_g", "back_b")


@query("delta_e_chroma", f"""
WITH a AS (SELECT *, {lab_cols('r', 'g', 'b')}, {lab_cols('r2', 'g2', 'b2', 'n_')} FROM px)
SELECT page_id, x, y, round(sqrt((lab_l - n_lab_l) ** 2 + (lab_a - n_lab_a) ** 2 + (lab_b - n_lab_b) ** 2), 6) AS delta_e,
       round(sqrt((lab_a - 128) ** 2 + (lab_b - 128) ** 2), 6) AS chroma, CAST(NULL AS DOUBLE) AS missing FROM a""")
def _(t):
    d = C.with_lab(C.with_lab(t.px), ("r2", "g2", "b2"), ("n_l", "n_a", "n_b"))
    missing = C.hex_distance(C.rgb_to_hex("r", "g", "b"), F.lit(None).cast("string"))
    return d.select("page_id", "x", "y",
                    r6(C.lab_distance(("lab_l", "lab_a", "lab_b"), ("n_l", "n_a", "n_b")), "delta_e"),
                    r6(C.chroma("lab_a", "lab_b"), "chroma"), missing.alias("missing"))


@query("blend_hex", f"""
WITH a AS (SELECT *, {lab_cols('t_r', 't_g', 't_b')}, {lab_cols('t_g', 't_b', 't_r', 'n_')} FROM assignments),
m AS (SELECT *, floor(lab_l * (1.0 - margin) + n_lab_l * margin) AS ml, floor(lab_a * (1.0 - margin) + n_lab_a * margin) AS ma,
             floor(lab_b * (1.0 - margin) + n_lab_b * margin) AS mb FROM a),
o AS (SELECT *, {rgb_cols('ml', 'ma', 'mb')} FROM m)
SELECT page_id, region_id, {hex_sql('o_r', 'o_g', 'o_b')} AS mixed FROM o""")
def _(t):
    a, b = C.rgb_to_hex("t_r", "t_g", "t_b"), C.rgb_to_hex("t_g", "t_b", "t_r")
    d = t.assignments.select("page_id", "region_id", "margin", a.alias("a"), b.alias("b"))
    return d.select("page_id", "region_id", C.blend_hex("a", "b", F.col("margin")).alias("mixed"))


@query("hue_circle", """
WITH h AS (SELECT hint_id, CAST(r AS DOUBLE) * 1.5 AS t, CAST(g AS DOUBLE) * 1.5 AS s, CAST(strength AS DOUBLE) AS k FROM hints),
d AS (SELECT *, ((t - s + 180) % 360 + 360) % 360 - 180 AS dl FROM h)
SELECT hint_id, round(dl, 6) AS delta, round(((s + dl * k) % 360 + 360) % 360, 6) AS mixed FROM d""")
def _(t):
    r, g = F.col("r") * 1.5, F.col("g") * 1.5
    return t.hints.select("hint_id", r6(C.hue_delta(r, g), "delta"), r6(C.hue_lerp(g, r, "strength"), "mixed"))


@query("pixel_predicates", f"""
WITH p AS (SELECT *, {hsv_cols('r', 'g', 'b')}, {lab_cols('r', 'g', 'b')} FROM px)
SELECT page_id, x, y, gray <= 60 AS ink, gray BETWEEN 35 AND 242 AS content, gray > 235 AS paper,
       val <= 96 AND span <= 34 AS black_like, val <= 48 AND span <= 6 AS neutral_ink,
       sat > 30 AND val > 25 AND val < 245 AS chromatic,
       round(greatest(0.0, least(1.0, (lab_l / 255.0 - 0.58) / 0.30)), 6) AS w_high,
       round(greatest(0.0, least(1.0, (0.42 - lab_l / 255.0) / 0.30)), 6) AS w_low,
       round(greatest(0.0, least(1.0, 1.0 - abs(lab_l / 255.0 - 0.52) / 0.28)), 6) AS w_mid FROM p""")
def _(t):
    h, s, v = C.rgb_to_hsv("r", "g", "b")
    return C.with_lab(t.px).select(
        "page_id", "x", "y", C.is_ink("gray").alias("ink"), C.is_content("gray").alias("content"),
        C.is_paper("gray").alias("paper"), C.is_black_like("r", "g", "b").alias("black_like"),
        C.is_neutral_ink("r", "g", "b").alias("neutral_ink"), C.is_chromatic(s, v).alias("chromatic"),
        r6(C.tone_weight("lab_l", "highlights"), "w_high"), r6(C.tone_weight("lab_l", "shadows"), "w_low"),
        r6(C.tone_weight("lab_l", "midtones"), "w_mid"))


@query("effective_alpha", """
SELECT hint_id, round(CASE WHEN 2.2 * strength <= 1.0 THEN confidence * 2.2 * strength
       ELSE greatest(0.0, least(1.0, confidence + (1 - confidence) * (least(2.0, 2.2 * strength) - 1) * 0.72)) END, 6) AS alpha
FROM hints""")
def _(t):
    return t.hints.select("hint_id", r6(C.effective_alpha("confidence", F.col("strength") * 2.2), "alpha"))


@query("normalize_palette", f"""
WITH c AS (SELECT page_id, region_id, list_value({hex_sql('t_r', 't_g', 't_b')}, ' ' || upper({hex_sql('t_r', 't_g', 't_b')}),
             'red', {hex_sql('t_b', 't_r', 't_g')}, '#12', {hex_sql('t_g', 't_b', 't_r')}, '#00ff00') AS l FROM assignments),
u AS (SELECT page_id, region_id, lower(trim(l[i])) AS v, i
      FROM (SELECT *, unnest(generate_series(1, 7)) AS i FROM c) z),
f AS (SELECT page_id, region_id, v, min(i) AS i FROM u WHERE length(v) = 7 AND v[1] = '#' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY i) AS rn FROM f)
SELECT page_id, region_id, string_agg(v, ',' ORDER BY i) AS palette FROM k WHERE rn <= 3 GROUP BY page_id, region_id""")
def _(t):
    a, b, c = (C.rgb_to_hex(*v) for v in (("t_r", "t_g", "t_b"), ("t_b", "t_r", "t_g"), ("t_g", "t_b", "t_r")))
    arr = F.array(a, F.concat(F.lit(" "), F.upper(a)), F.lit("red"), b, F.lit("#12"), c, F.lit("#00ff00"))
    return t.assignments.select("page_id", "region_id",
                                F.concat_ws(",", P.normalize_palette(arr)).alias("palette"))


def _hex_channels(column: str, prefix: str) -> str:
    return ", ".join(f"CAST('0x' || substr({column}, {2 * i + 2}, 2) AS INT) AS {prefix}{c}" for i, c in enumerate("rgb"))


def _lab_gap(p: str, q: str) -> str:
    return f"sqrt({' + '.join(f'CAST({p}lab_{c} - {q}lab_{c} AS DOUBLE) ** 2' for c in 'lab')})"


def _merge_step(k: int) -> str:
    """The list after the k-th candidate: blended into the nearest slot, added, or left out."""
    prev = f"p{k - 1}"
    return f"""
u{k} AS (SELECT page_id, region_id, cands[{k}] AS c, slots[1] AS f, unnest(slots) AS s, unnest(range(1, len(slots) + 1)) AS pos FROM {prev} WHERE cands[{k}] IS NOT NULL AND NOT list_contains(slots, cands[{k}])),
h{k} AS (SELECT *, {_hex_channels('s', 's')}, {_hex_channels('c', 'c')}, {_hex_channels('f', 'f')} FROM u{k}),
l{k} AS (SELECT *, {lab_cols('sr', 'sg', 'sb', 's_')}, {lab_cols('cr', 'cg', 'cb', 'c_')}, {lab_cols('fr', 'fg', 'fb', 'f_')} FROM h{k}),
d{k} AS (SELECT *, {_lab_gap('s_', 'c_')} AS d, {_lab_gap('s_', 'f_')} AS df, row_number() OVER (PARTITION BY page_id, region_id ORDER BY {_lab_gap('s_', 'c_')}, pos) AS rn FROM l{k}),
m{k} AS (SELECT *, CAST(CASE WHEN d <= 12 THEN 0.35 ELSE 0.45 END AS DOUBLE) AS wt, {', '.join(f"floor(s_lab_{c} * (1.0 - wt) + c_lab_{c} * wt) AS m{c}" for c in 'lab')} FROM d{k} WHERE rn = 1),
o{k} AS (SELECT *, {rgb_cols('ml', 'ma', 'mb')} FROM m{k}),
p{k} AS (SELECT q.page_id, q.region_id, q.cands, CASE WHEN o.pos IS NULL THEN q.slots
   WHEN d <= 12 OR (len(q.slots) >= 3 AND d < coalesce(nullif(df, 0), 999)) THEN list_transform(range(1, len(q.slots) + 1), lambda i: CASE WHEN i = o.pos THEN {hex_sql('o_r', 'o_g', 'o_b')} ELSE q.slots[i] END)
   WHEN len(q.slots) < 3 THEN list_append(q.slots, o.c) ELSE q.slots END AS slots FROM {prev} q LEFT JOIN o{k} o ON o.page_id = q.page_id AND o.region_id = q.region_id)"""


_FIRST_SEEN = lambda v: f"list_filter({v}, lambda e, i: list_position({v}, e) = i)[1:3]"


@query("merge_palette", f"""
WITH a AS (SELECT page_id, region_id, [{hex_sql('t_r', 't_g', 't_b')}, {hex_sql('t_b', 't_r', 't_g')}] AS s0,
   [{hex_sql('t_r + 3', 't_g', 't_b')}, {hex_sql('t_g', 't_b', 't_r')}, {hex_sql('t_g', 't_b + 9', 't_r')}] AS c0 FROM assignments),
p0 AS (SELECT page_id, region_id, {_FIRST_SEEN('c0')} AS cands, {_FIRST_SEEN('s0')} AS slots FROM a),{_merge_step(1)},{_merge_step(2)},{_merge_step(3)}
SELECT page_id, region_id, array_to_string({_FIRST_SEEN('slots')}, ',') AS palette FROM p3""")
def _(t):
    near = C.rgb_to_hex(F.col("t_r") + 3, "t_g", "t_b")
    slots = F.array(C.rgb_to_hex("t_r", "t_g", "t_b"), C.rgb_to_hex("t_b", "t_r", "t_g"))
    cands = F.array(near, C.rgb_to_hex("t_g", "t_b", "t_r"), C.rgb_to_hex("t_g", F.col("t_b") + 9, "t_r"))
    # A million rows of the table may be one read task: this is work enough to deal them first.
    dealt = t.assignments.repartition(8 * t.assignments.sparkSession.sparkContext.defaultParallelism, "page_id", "region_id")
    d = dealt.select("page_id", "region_id", slots.alias("slots"), cands.alias("cands"))
    return d.select("page_id", "region_id", F.concat_ws(",", P.merge_palette("slots", "cands")).alias("palette"))


_BOX2 = "x + 17 AS qx, y - 23 AS qy, h AS qw, w AS qh"


@query("bbox_algebra", f"""
WITH a AS (SELECT *, {_BOX2} FROM regions),
i AS (SELECT *, greatest(0, least(x + w, qx + qw) - greatest(x, qx)) * greatest(0, least(y + h, qy + qh) - greatest(y, qy)) AS inter,
        greatest(0.0, greatest(x, qx + 60) - least(x + w, qx + 60 + qw)) AS gx,
        greatest(0.0, greatest(y, qy + 90) - least(y + h, qy + 90 + qh)) AS gy,
        greatest(qw, qh) * 0.3 AS pad FROM a)
SELECT page_id, region_id, round(CAST(inter AS DOUBLE) / (w * h + qw * qh - inter), 6) AS iou,
       round(sqrt(CAST(gx AS DOUBLE) ** 2 + CAST(gy AS DOUBLE) ** 2), 6) AS gap,
       NOT (x + w < qx + 60 - pad OR x > qx + 60 + qw + pad OR y + h < qy + 90 - pad OR y > qy + 90 + qh + pad) AS near,
       greatest(0, least(999, qx)) AS cx, greatest(0, least(1399, qy)) AS cy,
       greatest(1, least(1000 - cx, qw)) AS cw, greatest(1, least(1400 - cy, qh)) AS ch FROM i""")
def _(t):
    d = t.regions.selectExpr("*", *_BOX2.split(", "))
    a, b = ("x", "y", "w", "h"), ("qx", "qy", "qw", "qh")
    far = (F.col("qx") + 60, F.col("qy") + 90, "qw", "qh")
    cx, cy, cw, ch = G.bbox_clip(b, 1000, 1400)
    return d.select("page_id", "region_id", r6(G.bbox_iou(a, b), "iou"), r6(G.bbox_gap(a, far), "gap"),
                    G.bbox_near(a, far, 0.3).alias("near"), cx.alias("cx"), cy.alias("cy"), cw.alias("cw"),
                    ch.alias("ch"))


@query("bbox_union", """
SELECT page_id, label, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h
FROM regions GROUP BY page_id, label""")
def _(t):
    x, y, w, h = G.bbox_union(("x", "y", "w", "h"))
    return t.regions.groupBy("page_id", "label").agg(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _expand_sql(p, left, up, wide, tall):
    return (f"greatest(0, CAST(trunc(CAST(x AS DOUBLE) - w * CAST({left} AS DOUBLE)) AS INT)) AS {p}x, greatest(0, CAST(trunc(CAST(y AS DOUBLE) - h * CAST({up} AS DOUBLE)) AS INT)) AS {p}y, "
            f"greatest(1, least(1000 - {p}x, CAST(trunc(w * CAST({wide} AS DOUBLE)) AS INT))) AS {p}w, "
            f"greatest(1, least(1400 - {p}y, CAST(trunc(h * CAST({tall} AS DOUBLE)) AS INT))) AS {p}h")


def _face_sql(p, left, up, wide, tall):
    return (f"greatest(0, least(999, CAST(trunc(CAST(x AS DOUBLE) - w * CAST({left} AS DOUBLE)) AS INT))) AS {p}x, "
            f"greatest(0, least(1399, CAST(trunc(CAST(y AS DOUBLE) - h * CAST({up} AS DOUBLE)) AS INT))) AS {p}y, "
            f"greatest(1, least(1000 - {p}x, CAST(trunc(w * CAST({wide} AS DOUBLE)) AS INT))) AS {p}w, "
            f"greatest(1, least(1400 - {p}y, CAST(trunc(h * CAST({tall} AS DOUBLE)) AS INT))) AS {p}h")


@query("head_body_boxes", f"""
SELECT page_id, region_id, {_expand_sql('h1', 0.55, 0.45, 2.10, 2.10)}, {_expand_sql('b1', 0.65, 0.20, 2.30, 5.20)},
       {_face_sql('h2', 0.34, 0.52, 1.68, 1.78)}, {_face_sql('b2', 1.00, 0.30, 3.00, 5.10)} FROM regions""")
def _(t):
    box = ("x", "y", "w", "h")
    out = []
    for p, fn in (("h1", G.head_box), ("b1", G.body_box), ("h2", G.head_box_from_face), ("b2", G.body_box_from_face)):
        out += [c.alias(p + n) for c, n in zip(fn(box, 1000, 1400), "xywh")]
    return t.regions.select("page_id", "region_id", *out)


@query("histogram_and_cosine", """
WITH p AS (SELECT i.inst_id, i.hist AS ih, CAST(i.embedding AS DOUBLE[]) AS ie, p.char_id, p.hist AS ph, CAST(p.embedding AS DOUBLE[]) AS pe
           FROM instances i JOIN profiles p ON i.book_id = p.book_id AND p.char_id = i.inst_id % 10)
SELECT inst_id, char_id,
       round(sqrt(greatest(0.0, 1 - list_sum([sqrt(z[1] * z[2]) for z in list_zip(ih, ph)]))), 6) AS hist_d,
       CASE WHEN pe IS NOT NULL THEN round(greatest(0.0, least(2.0, 1 - list_cosine_similarity(ie, pe))) / 2.0, 6) END AS cos_d,
       CASE WHEN pe IS NOT NULL THEN round(list_extract(ie, 3) * 0.75 + list_extract(pe, 3) * 0.25, 6)
            ELSE round(list_extract(ie, 3), 6) END AS mixed_raw
FROM p""")
def _(t):
    i, p = t.instances.alias("i"), t.profiles.alias("p")
    d = i.join(p, (F.col("i.book_id") == F.col("p.book_id")) & (F.col("p.char_id") == F.col("i.inst_id") % 10))
    ie, pe = F.col("i.embedding"), F.col("p.embedding")
    unit = V.blend_unit(ie, pe, 0.25)
    # The unit vector times its raw length gives the plain mix back.
    length = F.when(pe.isNull(), F.lit(1.0)).otherwise(
        V.norm(F.zip_with(ie, pe, lambda a, b: a.cast("double") * 0.75 + b.cast("double") * 0.25)))
    return d.select("inst_id", "char_id", r6(V.hellinger(F.col("i.hist"), F.col("p.hist")), "hist_d"),
                    r6(V.cosine_half(ie, pe), "cos_d"), r6(F.get(unit, F.lit(2)) * length, "mixed_raw"))


@query("classify_part", f"""
WITH r AS (SELECT *, region_id % 4 AS n_slots, {_expand_sql('k', 0.65, 0.20, 2.30, 5.20)} FROM regions),
b AS (SELECT *, CASE WHEN region_id % 6 = 0 THEN NULL ELSE kx + (region_id % 3) * 40 - 30 END AS qx, ky + (region_id % 5) * 60 - 150 AS qy FROM r),
c AS (SELECT *, (x + w / 2.0 - qx) / greatest(1.0, CAST(kw AS DOUBLE)) AS rx, (y + h / 2.0 - qy) / greatest(1.0, CAST(kh AS DOUBLE)) AS ry,
        CAST(w * h AS DOUBLE) / (kw * kh) AS ar, CAST(w AS DOUBLE) / h AS asp FROM b),
k AS (SELECT *, CASE WHEN qx IS NULL THEN CASE WHEN frac < 0.006 OR least(w, h) <= 8 THEN 'accessory' ELSE 'upper' END
          WHEN (ar < 0.035 OR least(w, h) <= 8 OR asp > 4.2 OR asp < 0.23) AND rx BETWEEN 0.12 AND 0.88 AND ry BETWEEN 0.08 AND 0.82 THEN 'accessory'
          WHEN ry < 0.56 THEN 'upper' ELSE 'lower' END AS part FROM c)
SELECT page_id, region_id, part,
       CASE WHEN n_slots <= 1 THEN 0 WHEN part = 'lower' THEN 1 WHEN part = 'accessory' THEN CASE WHEN n_slots >= 3 THEN 2 ELSE 1 END ELSE 0 END AS slot,
       CASE WHEN n_slots = 0 THEN 'fallback' ELSE 's' || (CASE WHEN n_slots <= 1 THEN 0 WHEN part = 'lower' THEN 1 WHEN part = 'accessory' THEN CASE WHEN n_slots >= 3 THEN 2 ELSE 1 END ELSE 0 END) END AS target FROM k""")
def _(t):
    bx, by, bw, bh = G.body_box(("x", "y", "w", "h"), 1000, 1400)
    d = t.regions.select("*", (F.col("region_id") % 4).alias("n_slots"), bx.alias("bx"), by.alias("by"),
                         bw.alias("bw"), bh.alias("bh"))
    qx = F.when(F.col("region_id") % 6 != 0, F.col("bx") + (F.col("region_id") % 3) * 40 - 30)
    qy = F.col("by") + (F.col("region_id") % 5) * 60 - 150
    part = G.classify_part(("x", "y", "w", "h"), "frac", (qx, qy, "bw", "bh"))
    d = d.withColumn("part", part).withColumn("slot", G.preferred_slot("part", "n_slots"))
    slots = F.slice(F.array(F.lit("s0"), F.lit("s1"), F.lit("s2")), F.lit(1), F.col("n_slots"))
    return d.select("page_id", "region_id", "part", "slot",
                    G.target_color(slots, "slot", F.lit("fallback")).alias("target"))


_STYLE_SQL = """
SELECT CAST(floor(n_nationkey / 5) AS INT) AS style_id,
       CASE n_nationkey % 5 WHEN 0 THEN 'hair' WHEN 1 THEN 'skin' WHEN 2 THEN 'eyes' WHEN 3 THEN 'clothing' ELSE 'sky' END AS region,
       CAST(n_nationkey - 12 AS DOUBLE) / 2 AS warm_bias, CAST(n_nationkey % 7 - 3 AS DOUBLE) AS shadow_bias,
       CAST(n_nationkey % 3 AS DOUBLE) / 10 AS shadow_desat, CAST(n_nationkey % 4 - 1 AS DOUBLE) AS shadow_hue_rotate,
       CAST(n_nationkey % 5 - 2 AS DOUBLE) AS highlight_bias, CAST(n_nationkey % 2 AS DOUBLE) / 8 AS highlight_desat,
       CAST(n_nationkey % 6 - 2 AS DOUBLE) AS highlight_hue_rotate, 0.6 + CAST(n_nationkey AS DOUBLE) / 32 AS saturation_scale,
       CAST(n_nationkey % 9 - 4 AS DOUBLE) / 4 AS global_warm_cool, 0.75 + CAST(n_nationkey % 3 AS DOUBLE) / 4 AS global_saturation
FROM nation"""


def _tier_sql(tier, dl, side):
    if side is None:
        a, b = "ma", "mb"
    else:
        fade = f"(1.0 - {side}_desat * s)"
        a = f"((ma + {side}_hue_rotate * s - 128) * {fade} + 128)"
        b = f"((mb + {side}_bias * s - 128) * {fade} + 128)"

    def q(e):
        return f"floor(greatest(0.0, least(255.0, {e})))"
    return (f"SELECT page_id, region_id, '{tier}' AS tier, o_r AS tier_r, o_g AS tier_g, o_b AS tier_b FROM "
            f"(SELECT *, {q(f'lab_l + {dl}')} AS tl, {q(a)} AS ta, {q(b)} AS tb, {rgb_cols('tl', 'ta', 'tb')} FROM m) z")


_TIER_COLS = ("warm_bias shadow_bias shadow_desat shadow_hue_rotate highlight_bias highlight_desat "
              "highlight_hue_rotate global_warm_cool").split()


@query("style_tiers", f"""
WITH s AS ({_STYLE_SQL}),
c AS (SELECT page_id, region_id, t_r AS r, t_g AS g, t_b AS b, page_id % 6 AS style_id, attribute AS region FROM assignments),
j AS (SELECT c.*, 0.8 AS s, {', '.join(f'coalesce(s.{f}, 0.0) AS {f}' for f in _TIER_COLS)},
        coalesce(s.saturation_scale, 1.0) AS saturation_scale, coalesce(s.global_saturation, 1.0) AS global_saturation
      FROM c LEFT JOIN s ON c.style_id = s.style_id AND c.region = s.region),
l AS (SELECT *, {lab_cols('r', 'g', 'b')} FROM j),
m AS (SELECT *, 1.0 + (saturation_scale * global_saturation - 1.0) * s AS k, (lab_a - 128) * k + 128 AS ma,
        (lab_b + (warm_bias + global_warm_cool) * s - 128) * k + 128 AS mb FROM l)
{_tier_sql('highlight', '30.0', 'highlight')} UNION ALL {_tier_sql('mid', '0.0', None)} UNION ALL {_tier_sql('shadow', '(-35.0)', 'shadow')}""")
def _(t):
    styles = t.spark.sql(_STYLE_SQL.replace("FROM nation", "FROM {nation}"), nation=t.nation)
    colors = t.assignments.selectExpr("page_id", "region_id", "t_r AS r", "t_g AS g", "t_b AS b",
                                      "page_id % 6 AS style_id", "attribute AS region")
    return S.style_tiers(colors, styles, 0.8).select("page_id", "region_id", "tier", "tier_r", "tier_g", "tier_b")


_PRESET_SQL = """
SELECT CASE WHEN n_nationkey = 0 THEN 'none' ELSE 'style_' || n_nationkey END AS style_key,
       0.2 + CAST(n_nationkey AS DOUBLE) / 10 AS saturation_boost, 0.6 + CAST(n_nationkey AS DOUBLE) / 22 AS l_gamma,
       CAST(n_nationkey % 7 - 3 AS DOUBLE) AS chroma_warm_shift, CAST(n_nationkey % 5 - 2 AS DOUBLE) AS chroma_red_shift
FROM nation"""


def _hsv_back(i):
    v, p, q, t = "vv", "vv * (1.0 - ss)", "vv * (1.0 - ss * fr)", "vv * (1.0 - ss * (1.0 - fr))"
    rows = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    whens = " ".join(f"WHEN {k} THEN {rows[k][i]}" for k in range(5))
    return f"floor(CASE sec {whens} ELSE {rows[5][i]} END + 0.5)"


@query("adapt_to_style", f"""
WITH s AS ({_PRESET_SQL}),
c AS (SELECT page_id, region_id, t_r AS r, t_g AS g, t_b AS b,
        CASE WHEN region_id % 26 = 0 THEN 'none' ELSE 'style_' || (region_id % 26) END AS style_key FROM assignments),
j AS (SELECT c.*, saturation_boost, l_gamma, chroma_warm_shift, chroma_red_shift FROM c LEFT JOIN s USING (style_key)),
l AS (SELECT *, {lab_cols('r', 'g', 'b')}, {hsv_cols('r', 'g', 'b')}, greatest(0.05, least(3.0, saturation_boost)) AS bo,
        CASE WHEN bo < 1 THEN greatest(0.08, least(1.0, 0.10 + 0.90 * bo)) ELSE greatest(0.90, least(1.18, 0.94 + (bo - 1) * 0.10)) END AS fac,
        greatest(0.0, least(1.0, (1 - bo) / 0.92)) AS pale,
        floor(greatest(0.0, least(255.0, sat * fac))) AS s2,
        floor(CASE WHEN pale > 0 THEN greatest(0.0, least(255.0, val + (255.0 - val) * (0.10 + pale * 0.16))) ELSE val END) AS v2,
        floor(greatest(0.0, least(1.0, pow(greatest(lab_l / 255.0, 0.0001), greatest(0.65, least(1.6, l_gamma))))) * 255.0) AS l2,
        floor(greatest(0.0, least(255.0, lab_a + chroma_red_shift * 0.55))) AS a2,
        floor(greatest(0.0, least(255.0, lab_b + chroma_warm_shift * 0.75))) AS b2,
        s2 / CAST(255.0 AS DOUBLE) AS ss, CAST(v2 AS DOUBLE) AS vv, CAST(hue AS DOUBLE) / 30.0 AS hs, CAST(floor(hs) AS INT) AS sec, hs - sec AS fr,
        {_hsv_back(0)} AS hr, {_hsv_back(1)} AS hg, {_hsv_back(2)} AS hb, {rgb_cols('l2', 'a2', 'b2')},
        CASE WHEN bo < 1 THEN 0.62 ELSE 0.40 END AS share,
        (saturation_boost IS NULL OR style_key = 'none') AS plain FROM j)
SELECT page_id, region_id, CASE WHEN plain THEN r ELSE CAST(floor(hr * share + o_r * (1.0 - share)) AS INT) END AS styled_r,
       CASE WHEN plain THEN g ELSE CAST(floor(hg * share + o_g * (1.0 - share)) AS INT) END AS styled_g,
       CASE WHEN plain THEN b ELSE CAST(floor(hb * share + o_b * (1.0 - share)) AS INT) END AS styled_b FROM l""")
def _(t):
    presets = t.spark.sql(_PRESET_SQL.replace("FROM nation", "FROM {nation}"), nation=t.nation)
    df = t.assignments.selectExpr(
        "page_id", "region_id", "t_r AS r", "t_g AS g", "t_b AS b",
        "CASE WHEN region_id % 26 = 0 THEN 'none' ELSE concat('style_', region_id % 26) END AS style_key")
    return S.adapt_to_style(df, presets).select("page_id", "region_id", "styled_r", "styled_g", "styled_b")


@query("preset_lookup", f"""
WITH s AS ({_PRESET_SQL}),
c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Light' WHEN 2 THEN ' Unknown' ELSE ' STYLE_' || c_nationkey END AS want FROM customer),
n AS (SELECT c_custkey, CASE WHEN lower(trim(want)) = 'light' THEN 'style_2' ELSE lower(trim(want)) END AS k FROM c)
SELECT c_custkey, coalesce(s.style_key, 'none') AS style_key, round(coalesce(s.saturation_boost, d.saturation_boost), 6) AS saturation_boost
FROM n LEFT JOIN s ON n.k = s.style_key JOIN s d ON d.style_key = 'none'""")
def _(t):
    presets = t.spark.sql(_PRESET_SQL.replace("FROM nation", "FROM {nation}"), nation=t.nation)
    df = t.customer.selectExpr(
        "c_custkey", "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Light' WHEN 2 THEN ' Unknown' "
        "ELSE concat(' STYLE_', c_nationkey) END AS want")
    out = S.preset_lookup(df, presets, "want", "style_key", "none", {"light": "style_2"})
    return out.select("c_custkey", "style_key", r6("saturation_boost", "saturation_boost"))


@query("remap_to_crop", """
SELECT hint_id, round((x_norm * 1000 - 200) / 650, 6) AS x_norm, round((y_norm * 1400 - 300) / 490, 6) AS y_norm,
       round(radius_norm * 1000 / 650, 6) AS radius_norm
FROM hints WHERE x_norm * 1000 >= 200 AND x_norm * 1000 < 700 AND y_norm * 1400 >= 300 AND y_norm * 1400 < 740""")
def _(t):
    d = H.remap_to_crop(t.hints, (200, 300, 500, 440), 1000, 1400, 650, 490)
    return d.select("hint_id", r6("x_norm", "x_norm"), r6("y_norm", "y_norm"), r6("radius_norm", "radius_norm"))


_PROFILE_SQL = """
SELECT c_custkey AS style_id, c_name AS name, CAST(c_custkey % 11 AS DOUBLE) / 10 AS saturation,
       CAST(c_custkey % 13 AS DOUBLE) / 12 AS contrast, CAST(c_custkey % 9 AS DOUBLE) / 8 AS shadow_strength,
       CAST(c_custkey % 17 AS DOUBLE) / 16 AS gradient, CAST(c_custkey % 23 AS DOUBLE) / 3 AS global_warm_cool,
       CASE c_custkey % 4 WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' ELSE 'neutral' END AS temperature,
       CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 7 AS DOUBLE) / 5 END AS global_ambience
FROM customer"""


@query("profile_to_descriptor", f"""
WITH p AS ({_PROFILE_SQL}), w AS (SELECT *, CASE temperature WHEN 'warm' THEN 4.0 WHEN 'cool' THEN -4.0 ELSE 0.0 END AS wb FROM p)
SELECT style_id, round_even(wb, 2) AS warm_bias, round_even(CAST(wb AS DOUBLE) * -0.3, 2) AS shadow_bias, round_even((1 - gradient) * 0.3, 3) AS shadow_desat,
       round_even(saturation * 1.2, 3) AS saturation_scale, round_even(greatest(0.7, contrast * 1.2), 3) AS region_contrast,
       round_even(shadow_strength * 0.3, 3) AS global_shadow_lift, round_even(greatest(0.0, 1 - gradient * 1.5), 3) AS cel_flatten FROM w
""".replace("round_even(wb, 2)", "CAST(wb AS DOUBLE)"))
def _(t):
    p = t.spark.sql(_PROFILE_SQL.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    return S.convert_style(p.drop("global_warm_cool"), "descriptor").select(
        "style_id", "warm_bias", "shadow_bias", "shadow_desat", "saturation_scale", "region_contrast",
        "global_shadow_lift", "cel_flatten")


@query("descriptor_to_preset", f"""
WITH p AS ({_PROFILE_SQL})
SELECT style_id, 'descriptor_' || replace(lower(name), ' ', '_') AS preset_key,
       round(greatest(0.85, least(1.35, 1.0 + (saturation - 0.7) * 0.45)), 6) AS saturation_boost,
       greatest(205, least(238, CAST(trunc(210 + contrast * 25) AS INT))) AS white_threshold,
       greatest(15, least(45, CAST(trunc(20 + shadow_strength * 25) AS INT))) AS black_threshold,
       round(greatest(0.85, least(1.15, 1.15 - contrast * 0.3)), 6) AS l_gamma,
       round((CASE temperature WHEN 'warm' THEN 3.0 WHEN 'cool' THEN -3.0 ELSE 0.0 END + global_warm_cool * 0.25)
             * greatest(0.0, least(1.0, coalesce(global_ambience, 0.20))), 6) AS chroma_warm_shift,
       round(greatest(0.25, least(0.6, 0.25 + gradient * 0.3)), 6) AS neutral_fade_floor FROM p""")
def _(t):
    p = t.spark.sql(_PROFILE_SQL.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    d = S.convert_style(p, "preset")
    return d.select("style_id", "preset_key", r6("saturation_boost", "saturation_boost"), "white_threshold",
                    "black_threshold", r6("l_gamma", "l_gamma"), r6("chroma_warm_shift", "chroma_warm_shift"),
                    r6("neutral_fade_floor", "neutral_fade_floor"))


_STYLE_EXTRA = """CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS description, CASE WHEN c_custkey % 2 = 0 THEN 'mixed' ELSE 'reference' END AS source,
       CAST(c_custkey % 10 AS DOUBLE) / 8 AS cel_flatten, CASE WHEN c_custkey % 4 = 1 THEN 'own_' || c_custkey ELSE '' END AS wanted"""


def _styles(t):
    extra = _PROFILE_SQL.replace("\nFROM customer", ", " + _STYLE_EXTRA + ", map('hair', concat('#', lpad(hex(c_custkey % 4096), 6, '0'))) AS palette\nFROM {customer}")
    return t.spark.sql(extra, customer=t.customer)


_STYLES_SQL = _PROFILE_SQL.replace("\nFROM customer", ", " + _STYLE_EXTRA + ", '#' || lpad(to_hex(c_custkey % 4096), 6, '0') AS hair\nFROM customer")


@query("preset_fields", f"""
WITH p AS ({_STYLES_SQL})
SELECT style_id, coalesce(nullif(wanted, ''), 'descriptor_' || replace(lower(name), ' ', '_')) AS preset_key, name || ' (descriptor)' AS label, coalesce(nullif(description, ''), name) AS description,
  round(greatest(0.0, least(0.85, cel_flatten)), 6) AS cel_flatten, 15 AS denoise_sigma FROM p""")
def _(t):
    d = S.convert_style(_styles(t), "preset", key="wanted")
    return d.select("style_id", "preset_key", "label", F.col("preset_description").alias("description"), r6("preset_cel_flatten", "cel_flatten"), "denoise_sigma")


@query("descriptor_to_profile", f"""
WITH p AS ({_STYLES_SQL}) SELECT name, hair, saturation, contrast, temperature, shadow_strength, gradient, description, source, 3 AS version FROM p""")
def _(t):
    d = S.convert_style(_styles(t), "profile")
    return d.select("name", F.try_element_at("palette", F.lit("hair")).alias("hair"), "saturation", "contrast", "temperature", "shadow_strength", "gradient", "description", "source", "version")
