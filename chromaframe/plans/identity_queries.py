"""Queries over identity matching and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators import identity as I
from chromaframe.operators import stats as A
from chromaframe.plans.registry import hex_sql, lab_cols, query, r6


def _match_sql(match=0.58, score=0.48, margin=0.055, conf=0.32):
    cos = lambda a, b: (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest(0.0, least(2.0, 1 - list_cosine_similarity("
                        f"CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))) / 2.0 END")
    return f"""
WITH pr AS (SELECT i.inst_id, p.char_id, least(1.0, abs(p.tone - i.tone) / 100) AS td,
   sqrt(greatest(0.0, 1 - list_sum([sqrt(z[1] * z[2]) for z in list_zip(i.hist, p.hist)]))) AS hd,
   least(1.0, abs(ln(greatest(i.aspect, 0.001) / greatest(p.aspect, 0.001))) / 1.7) AS ad,
   least(1.0, abs(ln(greatest(i.area_frac, 0.000001) / greatest(p.area_frac, 0.000001))) / 3.2) AS fd,
   {cos('p.embedding', 'i.embedding')} AS ed, {cos('p.lineart', 'i.lineart')} AS ld
  FROM instances i JOIN profiles p ON i.book_id = p.book_id),
ds AS (SELECT inst_id, char_id, CASE WHEN ed IS NOT NULL AND ld IS NOT NULL THEN 0.42 * ed + 0.28 * ld + 0.10 * td + 0.10 * hd + 0.06 * ad + 0.04 * fd
   WHEN ed IS NOT NULL THEN 0.56 * ed + 0.14 * td + 0.15 * hd + 0.10 * ad + 0.05 * fd
   WHEN ld IS NOT NULL THEN 0.55 * ld + 0.16 * td + 0.16 * hd + 0.08 * ad + 0.05 * fd
   ELSE 0.30 * td + 0.35 * hd + 0.22 * ad + 0.13 * fd END AS d FROM pr),
rk AS (SELECT ds.*, i.forced, i.conf, row_number() OVER (PARTITION BY ds.inst_id ORDER BY d, char_id) AS rn,
   row_number() OVER (PARTITION BY ds.inst_id ORDER BY (char_id = forced) IS TRUE, d, char_id) AS alt FROM ds JOIN instances i ON ds.inst_id = i.inst_id),
pk AS (SELECT inst_id, first(forced) AS forced, first(conf) AS conf, max(CASE WHEN rn = 1 THEN d END) AS n1, max(CASE WHEN rn = 1 THEN char_id END) AS c1,
   max(CASE WHEN rn = 2 THEN d END) AS n2, max(CASE WHEN alt = 1 THEN d END) AS na, coalesce(bool_or(char_id = forced), FALSE) AS known FROM rk GROUP BY inst_id),
dc AS (SELECT *, coalesce(forced = -1, FALSE) AS never, known AND forced >= 0 AS pin, CASE WHEN never THEN 1.0 WHEN pin THEN 0.0 ELSE n1 END AS d1,
   CASE WHEN never THEN 1.0 WHEN pin THEN na ELSE n2 END AS d2, CASE WHEN never THEN 0.0 ELSE greatest(0.0, 1 - d1) END AS s1,
   CASE WHEN never THEN 0.0 ELSE greatest(0.0, d2 - d1) END AS mg, NOT never AND (pin OR d1 <= {match}) AS matched FROM pk),
res AS (SELECT inst_id, CASE WHEN matched THEN CASE WHEN pin THEN forced ELSE c1 END END AS matched_char, round(d1, 6) AS distance, round(d2, 6) AS second_distance,
   round(s1, 6) AS match_score, round(mg, 6) AS margin, matched,
   NOT never AND (pin OR (matched AND s1 >= {score} AND mg >= {margin} AND conf >= {conf})) AS lock_allowed, never OR pin AS was_forced FROM dc)
"""


_COLS = ("inst_id", "matched_char", "distance", "second_distance", "match_score", "margin", "matched", "lock_allowed",
         "was_forced")


def _round(d):
    return d.select(*[r6(c, c) if c in ("distance", "second_distance", "match_score", "margin") else c for c in _COLS])


@query("identity_match", _match_sql() + "SELECT * FROM res")
def _(t):
    return _round(I.identity_match(t.instances, t.profiles))


@query("identity_gate_strict", _match_sql(0.42, 0.62, 0.075, 0.30) + "SELECT * FROM res")
def _(t):
    return _round(I.identity_match(t.instances, t.profiles, gates=I.strict_gates(I.GATES)))


@query("identity_match_strict")
def _(t):
    inst = t.instances.drop("forced").withColumnRenamed("inst_id", "face_id").withColumnRenamed("conf", "confidence")
    base = (F.col("face_id") * 7) % 40
    region = lambda k, a: F.struct(F.lit(a).alias("attribute"), ((base + k) % 48).cast("int").alias("region_id"),
                                   F.when(((base + k) % 48) == 11, F.lit(3)).cast("int").alias("forced"))
    faces = inst.withColumn("area", (F.col("area_frac") * 1e6)).withColumn("conf", F.col("confidence")).withColumn(
        "regions", F.array(region(0, "hair"), region(1, "hair"), region(2, "skin"), region(3, "eyes"), region(4, "clothing")))
    return I.identity_match_strict(faces, t.profiles)


_OWN = """
WITH m AS (SELECT *, x + w / 2.0 AS ax, y + h / 2.0 AS ay, CAST(trunc(CAST(x AS DOUBLE) - w * 0.55) AS INT) AS hx, CAST(trunc(CAST(y AS DOUBLE) - h * 0.45) AS INT) AS hy,
     greatest(1, CAST(trunc(w * CAST(2.10 AS DOUBLE)) AS INT)) AS hw, greatest(1, CAST(trunc(h * CAST(2.10 AS DOUBLE)) AS INT)) AS hh,
     CAST(trunc(CAST(x AS DOUBLE) - w * 0.65) AS INT) AS qx, CAST(trunc(CAST(y AS DOUBLE) - h * 0.20) AS INT) AS qy,
     greatest(1, CAST(trunc(w * CAST(2.30 AS DOUBLE)) AS INT)) AS qw, greatest(1, CAST(trunc(h * CAST(5.20 AS DOUBLE)) AS INT)) AS qh FROM anchors),
j AS (SELECT r.page_id, r.region_id, r.label, r.conf, r.x + r.w / 2.0 AS cx, r.y + r.h / 2.0 AS cy, m.* EXCLUDE (page_id, x, y, w, h),
     cx BETWEEN hx AND hx + hw AND cy BETWEEN hy AND hy + hh AS ih, cx BETWEEN qx AND qx + qw AND cy BETWEEN qy AND qy + qh AS ib,
     sqrt(CAST((cx - ax) / (CASE WHEN r.label = 'clothing' THEN qw ELSE hw END) AS DOUBLE) ** 2 + CAST((cy - ay) / (CASE WHEN r.label = 'clothing' THEN qh ELSE hh END) AS DOUBLE) ** 2) AS sp
   FROM regions r JOIN m ON r.page_id = m.page_id WHERE r.label IN ('skin', 'eyes', 'clothing')),
k AS (SELECT *, round(sp + distance * 0.5, 9) AS cost FROM j WHERE CASE label WHEN 'eyes' THEN ih WHEN 'skin' THEN ih OR ib ELSE ib END),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY cost, anchor_id) AS rn FROM k)
SELECT page_id, region_id, label, anchor_id, char_id, CAST(cost AS DOUBLE) AS cost,
       lock_allowed AND conf >= CASE WHEN label = 'eyes' THEN 0.42 ELSE 0.32 END AS lock_allowed FROM b WHERE rn = 1"""


@query("assign_to_owner", _OWN)
def _(t):
    d = I.assign_to_owner(t.regions, t.anchors)
    return d.select("page_id", "region_id", "label", "anchor_id", "char_id", "cost", "lock_allowed")


@query("zero_shot_label", """
WITH p AS (SELECT CAST(label AS INT) AS label_id, CAST(min_by(embedding, vec_id) AS DOUBLE[]) AS e FROM embeddings GROUP BY 1),
s AS (SELECT v.vec_id AS item_id, p.label_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), p.e) * 100 AS s FROM embeddings v CROSS JOIN p),
m AS (SELECT *, max(s) OVER (PARTITION BY item_id) AS mx FROM s),
k AS (SELECT item_id, arg_max(label_id, s) AS label_id, 1 / sum(exp(s - mx)) AS pr FROM m GROUP BY item_id)
SELECT item_id, label_id, round(pr, 6) AS probability FROM k""")
def _(t):
    p = t.embeddings.groupBy(F.col("label").cast("int").alias("label_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    d = I.zero_shot_label(t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding"), p)
    return d.select("item_id", "label_id", r6("probability", "probability"))


@query("resolve_overrides", f"""
WITH pf AS (SELECT book_id, char_id, {hex_sql('hair_r', 'hair_g', 'hair_b')} AS hh, {hex_sql('hair_b', 'hair_r', 'hair_g')} AS eh FROM profiles),
a AS (SELECT page_id % 9 AS page_id, a.char_id, attribute, region_id, forced, page_id * 100 + region_id AS ord,
     coalesce(CASE WHEN region_id % 3 <> 0 THEN {hex_sql('t_r', 't_g', 't_b')} END, CASE WHEN attribute = 'eyes' THEN eh ELSE hh END) AS color
   FROM assignments a LEFT JOIN pf ON a.char_id = pf.char_id AND a.page_id % 3 = pf.book_id WHERE attribute IN ('hair', 'eyes') AND (lock_allowed OR forced)),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, char_id, attribute ORDER BY forced DESC, CASE WHEN forced THEN -ord ELSE ord END) AS rn FROM a WHERE color IS NOT NULL)
SELECT DISTINCT a.page_id, a.char_id, a.attribute, a.region_id, k.color AS target FROM a JOIN k ON a.page_id = k.page_id AND a.char_id = k.char_id
  AND a.attribute = k.attribute AND k.rn = 1 WHERE a.color IS NOT NULL""".replace("SELECT page_id % 9 AS page_id", "SELECT a.page_id % 9 AS page_id"))
def _(t):
    pf = t.profiles.select("book_id", "char_id", C.rgb_to_hex("hair_r", "hair_g", "hair_b").alias("hair_hex"),
                                                C.rgb_to_hex("hair_b", "hair_r", "hair_g").alias("eyes_hex"))
    a = t.assignments.select(
        (F.col("page_id") % 9).alias("page_id"), (F.col("page_id") % 3).alias("book_id"), "char_id", "attribute", "region_id", "lock_allowed", "forced",
        (F.col("page_id") * 100 + F.col("region_id")).alias("ord"),
        F.when(F.col("region_id") % 3 != 0, C.rgb_to_hex("t_r", "t_g", "t_b")).alias("color"))
    return I.resolve_overrides(a, pf, profile_keys=("book_id", "char_id"))


@query("choose_color_source", f"""
WITH i AS (SELECT page_id, region_id, {hex_sql('t_r', 't_g', 't_b')} AS c, char_id, match_score FROM assignments WHERE lock_allowed AND region_id % 2 = 0),
m AS (SELECT page_id, region_id, {hex_sql('t_b', 't_g', 't_r')} AS c FROM assignments WHERE region_id % 3 = 0),
s AS (SELECT label, {hex_sql('max(x) % 256', 'max(y) % 256', 'max(w) % 256')} AS c FROM regions WHERE label = 'sky' GROUP BY label),
j AS (SELECT r.page_id, r.region_id, r.label, conf, i.c AS ic, m.c AS mc, s.c AS sc, i.char_id, i.match_score FROM regions r
   LEFT JOIN i ON r.page_id = i.page_id AND r.region_id = i.region_id LEFT JOIN m ON r.page_id = m.page_id AND r.region_id = m.region_id
   LEFT JOIN s ON r.label = s.label WHERE conf >= 0.25 AND mean_gray < 242 AND mean_gray >= 55)
SELECT page_id, region_id, label, coalesce(ic, mc, sc) AS color, CASE WHEN ic IS NOT NULL THEN 'character_identity' WHEN mc IS NOT NULL THEN 'auto_instance' ELSE 'scene_palette' END AS source,
   CASE WHEN ic IS NOT NULL THEN char_id END AS character_id, round(CASE WHEN ic IS NOT NULL THEN least(conf, match_score) WHEN mc IS NOT NULL THEN conf * 0.75 ELSE conf END, 6) AS confidence,
   CAST(CASE WHEN ic IS NOT NULL THEN 0.58 WHEN mc IS NOT NULL THEN 0.30 ELSE 0.196 END AS DOUBLE) AS strength FROM j WHERE coalesce(ic, mc, sc) IS NOT NULL""")
def _(t):
    hexes = t.assignments.withColumns({"color": C.rgb_to_hex("t_r", "t_g", "t_b"), "alt": C.rgb_to_hex("t_b", "t_g", "t_r")})
    memory = hexes.where("region_id % 3 = 0").select("page_id", "region_id", F.col("alt").alias("color"))
    scene = t.regions.groupBy("label").agg(C.rgb_to_hex(F.max("x") % 256, F.max("y") % 256, F.max("w") % 256).alias("color"))
    d = I.choose_color_source(t.regions, hexes.where("region_id % 2 = 0"), memory, scene)
    return d.withColumns({"confidence": F.round("confidence", 6), "strength": F.round("strength", 6)})


@query("build_profiles", f"""
WITH c AS (SELECT r.*, {hex_sql('(r.region_id * 5) % 256', '(r.page_id * 7) % 256', '(r.region_id * 11) % 256')} AS color FROM regions r WHERE conf >= 0.20 AND label <> 'sky' AND region_id % 13 <> 0),
a AS (SELECT *, greatest(0, CAST(trunc(CAST(x AS DOUBLE) - w * 0.65) AS INT)) AS qx, greatest(0, CAST(trunc(CAST(y AS DOUBLE) - h * 0.20) AS INT)) AS qy,
    greatest(1, least(1000 - qx, CAST(trunc(w * CAST(2.30 AS DOUBLE)) AS INT))) AS qw, greatest(1, least(1400 - qy, CAST(trunc(h * CAST(5.20 AS DOUBLE)) AS INT))) AS qh FROM c WHERE label = 'hair'),
j AS (SELECT a.page_id, a.region_id AS anchor_id, c.label, c.color, row_number() OVER (PARTITION BY a.page_id, a.region_id, c.label ORDER BY c.area * greatest(0.1, c.conf) DESC, c.region_id) AS rn
   FROM a JOIN c ON a.page_id = c.page_id AND c.label <> 'hair' AND c.x + c.w / 2.0 BETWEEN qx AND qx + qw AND c.y + c.h / 2.0 BETWEEN qy AND qy + qh)
SELECT a.page_id, a.region_id AS anchor_id, a.color AS hair, max(CASE WHEN j.label = 'skin' THEN j.color END) AS skin, max(CASE WHEN j.label = 'eyes' THEN j.color END) AS eyes,
   max(CASE WHEN j.label = 'clothing' THEN j.color END) AS clothing, round(first(a.w) / CAST(first(a.h) AS DOUBLE), 6) AS aspect
FROM a LEFT JOIN j ON a.page_id = j.page_id AND a.region_id = j.anchor_id AND rn = 1 GROUP BY 1, 2, 3""")
def _(t):
    colors = t.regions.where("region_id % 13 <> 0").select("page_id", "region_id", C.rgb_to_hex(
        (F.col("region_id") * 5) % 256, (F.col("page_id") * 7) % 256, (F.col("region_id") * 11) % 256).alias("color"))
    d = I.build_profiles(t.regions, colors, 1000, 1400)
    at = lambda k: F.try_element_at("colors", F.lit(k)).alias(k)
    return d.select("page_id", "anchor_id", at("hair"), at("skin"), at("eyes"), at("clothing"), r6("aspect", "aspect"))


@query("counts_by_source", "SELECT page_id, source, count(*) AS hints FROM hints GROUP BY 1, 2")
def _(t):
    return I.counts_by_source(t.hints)


@query("workspace_stats", """
WITH s AS (SELECT o_orderpriority AS book, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS colored FROM orders GROUP BY 1)
SELECT *, total - colored AS pending, CASE WHEN total > colored THEN 'pending' ELSE 'done' END AS state FROM s""")
def _(t):
    return I.workspace_stats(t.orders.withColumnRenamed("o_orderpriority", "book"), F.col("o_orderstatus") == "F", ["book"])


_OBS = "o AS (SELECT page_id, region_id, " + ", ".join(f"CAST(trunc(quantile_cont({c}, 0.5)) AS INT) AS o_{c}" for c in "rgb") + \
       " FROM cells WHERE region_id > 0 GROUP BY 1, 2)"

_DRIFT = f"""
WITH {_OBS}, j AS (SELECT a.*, {lab_cols('t_r', 't_g', 't_b', 't_')}, {lab_cols('o_r', 'o_g', 'o_b', 'o_')},
   sqrt((t_lab_l - o_lab_l) ** 2 + (t_lab_a - o_lab_a) ** 2 + (t_lab_b - o_lab_b) ** 2) AS de FROM assignments a JOIN o ON a.page_id = o.page_id AND a.region_id = o.region_id WHERE lock_allowed),
al AS (SELECT *, de > CASE attribute WHEN 'eyes' THEN 16 WHEN 'clothing' THEN 20 WHEN 'skin' THEN 18 ELSE 24 END AS alert FROM j)"""


@query("drift_rows", _DRIFT + " SELECT page_id, region_id, char_id, attribute, round(de, 6) AS delta_e, alert FROM al")
def _(t):
    med = A.robust_median(t.cells.where("region_id > 0"), ["page_id", "region_id"], F.lit(True))
    return I.drift_rows(t.assignments, med).select("page_id", "region_id", "char_id", "attribute", r6("delta_e", "delta_e"), "alert")


@query("drift_report", _DRIFT + """, d AS (SELECT char_id, count(*) FILTER (WHERE alert) AS al, max(de) AS mx FROM al GROUP BY 1),
a AS (SELECT char_id, count(*) AS active_regions, count(*) FILTER (WHERE lock_allowed) AS locked_regions, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS attributes,
   count(*) FILTER (WHERE part = 'upper') AS part_upper, count(*) FILTER (WHERE part = 'lower') AS part_lower FROM assignments WHERE char_id IN (SELECT char_id FROM profiles) GROUP BY 1)
SELECT a.char_id, active_regions, locked_regions, attributes, part_upper, part_lower, coalesce(al, 0) AS drift_alerts, round_even(coalesce(mx, 0), 1) AS max_delta_e
FROM a LEFT JOIN d ON a.char_id = d.char_id ORDER BY coalesce(al, 0) DESC, locked_regions DESC, active_regions DESC, a.char_id LIMIT 5""")
def _(t):
    med = A.robust_median(t.cells.where("region_id > 0"), ["page_id", "region_id"], F.lit(True))
    lib = t.profiles.select("char_id", F.concat(F.lit("#"), F.col("char_id")).alias("name"))
    d = I.drift_report(t.assignments, med, lib, 5)
    return d.select("char_id", "active_regions", "locked_regions", F.concat_ws(",", "attributes").alias("attributes"),
                    "part_upper", "part_lower", "drift_alerts", "max_delta_e")
