"""Queries over the page analysis as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.operators.analysis import analyze_pages
from chromaframe.plans.identity_queries import _OWN, _match_sql
from chromaframe.plans.registry import hex_sql, query, r6

# Pages of two books lose their hair labels on every eleventh page: no anchor there.
_REGIONS = """
rg AS (SELECT page_id % 3 AS book_id, page_id, region_id, x, y, w, h, area, mean_gray, frac, conf, CASE WHEN page_id % 11 = 4 AND label = 'hair' THEN 'metal' ELSE label END AS label FROM regions),
anc AS (SELECT r.page_id, r.region_id, r.page_id * 1000 + r.region_id AS inst_id, r.book_id, r.mean_gray AS tone, CAST(r.w AS DOUBLE) / greatest(1, r.h) AS aspect, r.frac AS area_frac,
   i.hist, i.embedding, i.lineart, r.conf, i.forced, r.x, r.y, r.w, r.h FROM rg r JOIN instances i ON i.inst_id = (r.page_id * 50 + r.region_id) % 500 WHERE r.label = 'hair' AND r.conf >= 0.25)"""
_MATCH = _match_sql().replace("instances", "anc").strip().removeprefix("WITH ")
_OWNED = _OWN.strip().removeprefix("WITH ").replace("FROM anchors", "FROM mt").replace("FROM regions r", "FROM rg r").replace("SELECT page_id, region_id, label, anchor_id", "own AS (SELECT page_id, region_id, label, match_score, anchor_id")
_HEAD = f"""
WITH {_REGIONS}, {_MATCH.rstrip()},
mt AS (SELECT anc.page_id, anc.region_id AS anchor_id, anc.x, anc.y, anc.w, anc.h, CASE WHEN pin THEN dc.forced ELSE c1 END AS char_id, d1 AS distance, s1 AS match_score, mg AS margin,
   NOT never AND (pin OR (matched AND s1 >= 0.48 AND mg >= 0.055 AND dc.conf >= 0.32)) AS lock_allowed FROM dc JOIN anc ON dc.inst_id = anc.inst_id WHERE matched),
{_OWNED.replace(") AS rn FROM k)", ") AS rn FROM k),")}),
asg AS (SELECT page_id, anchor_id AS region_id, 'hair' AS label, char_id, match_score, lock_allowed FROM mt UNION ALL SELECT page_id, region_id, label, char_id, match_score, lock_allowed FROM own),
pal AS (SELECT book_id, char_id, unnest(['hair', 'eyes', 'skin', 'clothing']) AS attribute,
   unnest([{hex_sql('hair_r', 'hair_g', 'hair_b')}, {hex_sql('hair_b', 'hair_r', 'hair_g')}, {hex_sql('hair_g', 'hair_g', 'hair_r')}, {hex_sql('hair_b', 'hair_b', 'hair_r')}]) AS color FROM profiles),
idn AS (SELECT a.*, color FROM asg a JOIN pal ON pal.book_id = a.page_id % 3 AND pal.char_id = a.char_id AND pal.attribute = a.label WHERE lock_allowed),
mem AS (SELECT page_id, region_id, {hex_sql('(region_id * 7) % 256', '(page_id * 5) % 256', '(region_id * 3) % 256')} AS color FROM regions WHERE region_id % 3 = 0),
col AS (SELECT r.page_id, r.region_id, r.label, coalesce(i.color, m.color, CASE WHEN r.label IN ('sky', 'metal') THEN '#88aacc' END) AS color,
   CASE WHEN i.color IS NOT NULL THEN 'character_identity' WHEN m.color IS NOT NULL THEN 'auto_instance' ELSE 'scene_palette' END AS source, CASE WHEN i.color IS NOT NULL THEN i.char_id END AS character_id,
   round(CASE WHEN i.color IS NOT NULL THEN least(r.conf, i.match_score) WHEN m.color IS NOT NULL THEN r.conf * 0.75 ELSE r.conf END, 6) AS confidence,
   CAST(CASE WHEN i.color IS NOT NULL THEN 0.58 WHEN m.color IS NOT NULL THEN 0.30 ELSE 0.196 END AS DOUBLE) AS strength
  FROM rg r LEFT JOIN idn i ON i.page_id = r.page_id AND i.region_id = r.region_id LEFT JOIN mem m ON m.page_id = r.page_id AND m.region_id = r.region_id
  WHERE r.conf >= 0.25 AND r.mean_gray < 242 AND r.mean_gray >= 55 AND coalesce(i.color, m.color, CASE WHEN r.label IN ('sky', 'metal') THEN '#88aacc' END) IS NOT NULL)
"""


def _analysis(t):
    no_hair = (F.col("page_id") % 11 == 4) & (F.col("label") == "hair")
    regions = t.regions.withColumns({"book_id": F.col("page_id") % 3, "label": F.when(no_hair, "metal").otherwise(F.col("label"))})
    features = t.regions.select("page_id", "region_id", ((F.col("page_id") * 50 + F.col("region_id")) % 500).cast("long").alias("inst_id")).join(
        t.instances.select("inst_id", "hist", "embedding", "lineart", "forced"), "inst_id").drop("inst_id")
    swap = {"hair": "rgb", "eyes": "brg", "skin": "ggr", "clothing": "bbr"}
    palette = t.profiles.select("book_id", "char_id", F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), C.rgb_to_hex(*[f"hair_{c}" for c in v]).alias("color")) for a, v in swap.items()])))
    memory = t.regions.where("region_id % 3 = 0").select("page_id", "region_id", C.rgb_to_hex(
        (F.col("region_id") * 7) % 256, (F.col("page_id") * 5) % 256, (F.col("region_id") * 3) % 256).alias("color"))
    scene = t.spark.createDataFrame([("sky", "#88aacc"), ("metal", "#88aacc")], "label string, color string")
    return analyze_pages(regions, t.profiles, palette, memory, scene, features)


@query("analyze_colors", _HEAD + "SELECT * FROM col")
def _(t):
    d = _analysis(t)["colors"]
    return d.select("page_id", "region_id", "label", "color", "source", "character_id", r6("confidence", "confidence"), r6("strength", "strength"))


@query("analyze_hints", _HEAD + """
SELECT c.page_id, c.region_id, tier, source, round(r.x + r.w / 2.0, 6) AS cx, round(r.y + r.h / 2.0, 6) AS cy FROM col c JOIN rg r ON r.page_id = c.page_id AND r.region_id = c.region_id,
  (VALUES ('highlight'), ('mid'), ('shadow')) v(tier)""")
def _(t):
    d = _analysis(t)["hints"]
    return d.select("page_id", "region_id", "tier", "source", r6("cx", "cx"), r6("cy", "cy"))


@query("analyze_diagnostics", _HEAD + """,
f AS (SELECT page_id, count(*) AS regions, count(*) FILTER (WHERE conf >= 0.25) AS semantic_confident, count(*) FILTER (WHERE label = 'hair' AND conf >= 0.25) AS anchors FROM rg GROUP BY 1),
a AS (SELECT page_id, count(*) AS n FROM asg GROUP BY 1), s AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE source = 'character_identity') AS ci, count(*) FILTER (WHERE source = 'auto_instance') AS ai FROM col GROUP BY 1)
SELECT f.page_id, regions, semantic_confident, anchors, coalesce(a.n, 0) AS identity_assignments, coalesce(s.n, 0) AS colored, coalesce(ci, 0) AS character_identity, coalesce(ai, 0) AS auto_instance,
  CASE WHEN anchors = 0 THEN 'no_hair_anchor' END AS reason FROM f LEFT JOIN a ON a.page_id = f.page_id LEFT JOIN s ON s.page_id = f.page_id""")
def _(t):
    return _analysis(t)["diagnostics"].drop("scene_palette")
