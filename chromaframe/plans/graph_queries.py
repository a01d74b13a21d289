"""Queries over graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.operators import graph as G
from chromaframe.plans.registry import query


@query("connected_components", """
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey - p_partkey % 100 + (p_partkey + p_size * 10) % 100 AS b FROM part WHERE p_partkey - p_partkey % 100 + (p_partkey + p_size * 10) % 100 IN (SELECT p_partkey FROM part)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(id, component) USING KEY (id) AS (SELECT p_partkey, p_partkey FROM part
  UNION (SELECT n.id, min(l.component) FROM c l JOIN u ON l.id = u.a JOIN recurring.c n ON n.id = u.b GROUP BY n.id, n.component HAVING min(l.component) < n.component))
SELECT id, component FROM c""")
def _(t):
    # Every part points at another of its hundred.
    key = F.col("p_partkey")
    e = t.part.select(key.alias("src"), (key - key % 100 + (key + F.col("p_size") * 10) % 100).alias("dst"))
    e = e.join(t.part.select(key.alias("dst")), "dst", "left_semi")
    return G.connected_components(t.part.select(F.col("p_partkey").alias("id")), e)


def _flood(offsets):
    return f"""
WITH RECURSIVE f AS (SELECT page_id, x, y FROM cells WHERE fillable = 1),
l(page_id, x, y, root) USING KEY (page_id, x, y) AS (SELECT page_id, x, y, y * 100 + x FROM f
  UNION (SELECT n.page_id, n.x, n.y, min(l.root) FROM l, (VALUES {offsets}) o(dx, dy), recurring.l n WHERE n.page_id = l.page_id AND n.x = l.x + o.dx AND n.y = l.y + o.dy
    GROUP BY n.page_id, n.x, n.y, n.root HAVING min(l.root) < n.root))
SELECT page_id, x, y, CAST(floor(root / 100) AS INT) AS root_y, CAST(root % 100 AS INT) AS root_x FROM l"""


@query("label_regions", _flood("(0, 1), (0, -1), (1, 0), (-1, 0)"))
def _(t):
    return G.label_regions(t.cells)


@query("label_regions_8", _flood("(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)"))
def _(t):
    return G.label_regions(t.cells, 8)


_NEAR = lambda p: (f"NOT (l.x + l.w < r.x - greatest(r.w, r.h) * CAST({p} AS DOUBLE) OR l.x > r.x + r.w + greatest(r.w, r.h) * CAST({p} AS DOUBLE) "
                   f"OR l.y + l.h < r.y - greatest(r.w, r.h) * CAST({p} AS DOUBLE) OR l.y > r.y + r.h + greatest(r.w, r.h) * CAST({p} AS DOUBLE))")


_CLUSTERS = f"""
WITH RECURSIVE b AS (SELECT page_id, region_id AS id, x, y, CAST(floor(w / 2) AS INT) AS w, CAST(floor(h / 2) AS INT) AS h, CASE WHEN region_id % 3 = 0 THEN region_id % 5 END AS par, area, frac, conf, region_id % 4 = 0 AS matched FROM regions),
e AS (SELECT l.page_id, l.id AS a, r.id AS z FROM b l JOIN b r ON l.page_id = r.page_id AND l.id < r.id WHERE CASE WHEN l.par = r.par THEN {_NEAR(1.05)}
   ELSE {_NEAR(0.72)} OR (abs(l.x + l.w * 0.5 - r.x - r.w * 0.5) <= greatest(l.w, l.h, r.w, r.h) * 1.08 AND abs(l.y + l.h * 0.5 - r.y - r.h * 0.5) <= greatest(l.w, l.h, r.w, r.h) * 0.96) END),
u AS (SELECT page_id, a, z FROM e UNION ALL SELECT page_id, z, a FROM e),
c(page_id, id, root) USING KEY (page_id, id) AS (SELECT page_id, id, id FROM b
  UNION (SELECT n.page_id, n.id, min(k.root) FROM c k JOIN u ON k.page_id = u.page_id AND k.id = u.a JOIN recurring.c n ON n.page_id = u.page_id AND n.id = u.z GROUP BY n.page_id, n.id, n.root HAVING min(k.root) < n.root)),
g AS (SELECT b.page_id, root AS cluster_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(sum(area) AS BIGINT) AS area, bool_or(matched) AS matched, count(*) AS members,
  round(max(conf) + 0.18 * count(*) + CASE WHEN bool_or(matched) THEN 0.22 ELSE 0 END, 6) AS score, round(sum(frac), 6) AS area_fraction, arg_min(w, w * h * 1000 + b.id) AS face_w FROM b JOIN c ON b.page_id = c.page_id AND b.id = c.id GROUP BY 1, 2)
"""


def _boxes(t):
    return t.regions.selectExpr("page_id", "region_id AS box_id", "x", "y", "CAST(floor(w / 2) AS INT) AS w", "CAST(floor(h / 2) AS INT) AS h",
                                "CASE WHEN region_id % 3 = 0 THEN region_id % 5 END AS parent", "area", "frac AS area_fraction", "conf AS score", "region_id % 4 = 0 AS matched")


@query("cluster_boxes", _CLUSTERS + "SELECT page_id, cluster_id, x, y, w, h, area, matched, members, score FROM g")
def _(t):
    d = G.cluster_boxes(_boxes(t)).withColumn("score", F.round("score", 6))
    return d.select("page_id", "cluster_id", "x", "y", "w", "h", "area", "matched", "members", "score")


@query("ranked_clusters", _CLUSTERS + """
SELECT page_id, cluster_id, area_fraction, face_w, CAST(row_number() OVER (PARTITION BY page_id ORDER BY matched DESC, score DESC, area DESC, cluster_id) AS INT) AS rank FROM g""")
def _(t):
    d = G.cluster_boxes(_boxes(t).withColumn("face", F.struct("x", "y", "w", "h")))
    return d.select("page_id", "cluster_id", F.round("area_fraction", 6).alias("area_fraction"), F.col("face.w").alias("face_w"), "rank")


@query("box_clusters", _CLUSTERS + "SELECT page_id, id AS box_id, root AS cluster_id FROM c")
def _(t):
    return G.box_clusters(_boxes(t)).select("page_id", "box_id", "cluster_id")


_ADJ = """
o AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) q(dx, dy)),
ad AS (SELECT page_id, src, dst, count(*) AS contact FROM (SELECT DISTINCT p.page_id, p.x, p.y, n.rid AS src, p.rid AS dst FROM m p, o, m n
   WHERE n.page_id = p.page_id AND n.x = p.x + o.dx AND n.y = p.y + o.dy AND p.rid > 0 AND n.rid > 0 AND p.rid <> n.rid) z GROUP BY 1, 2, 3)"""
_MAP = "m AS (SELECT *, CAST(floor((x + page_id) / 7) + 6 * floor(y / 5) + CASE WHEN gray % 29 = 0 THEN -100 ELSE 1 END AS INT) AS r0, greatest(r0, 0) AS rid FROM cells)"


def _map(t):
    rid = F.floor((F.col("x") + F.col("page_id")) / 7) + F.floor(F.col("y") / 5) * 6 + F.when(F.col("gray") % 29 == 0, -100).otherwise(1)
    return t.cells.withColumn("region_id", F.greatest(rid, F.lit(0)).cast("int"))


@query("region_adjacency", f"WITH {_MAP}, {_ADJ} SELECT * FROM ad")
def _(t):
    return G.region_adjacency(_map(t))


@query("grow_selection", f"""
WITH {_MAP}, {_ADJ},
s AS (SELECT page_id, rid, count(*) AS area, avg(gray) AS mean, count(*) FILTER (WHERE gray % 23 = 1) / CAST(count(*) AS DOUBLE) AS p, count(*) FILTER (WHERE gray % 23 = 1) AS np,
   count(*) FILTER (WHERE gray % 31 = 2) / CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE gray % 31 = 2) AS nn, count(*) FILTER (WHERE in_mask > 0) / CAST(count(*) AS DOUBLE) AS r FROM m WHERE rid > 0 GROUP BY 1, 2),
k AS (SELECT *, greatest(p * 4, r) AS score, CASE WHEN n >= 0.04 OR nn >= 3 THEN 'vetoed' WHEN p >= 0.015 OR np >= 2 OR r >= 0.56 THEN 'accepted' ELSE 'none' END AS s0 FROM s),
""".replace("n >= 0.04", "n >= 0.01") + """
g1 AS (SELECT DISTINCT k.page_id, k.rid FROM ad JOIN k a ON ad.page_id = a.page_id AND ad.src = a.rid AND a.s0 = 'accepted' JOIN k ON ad.page_id = k.page_id AND ad.dst = k.rid
   WHERE k.s0 = 'none' AND k.score >= 0.18 AND k.area <= greatest(3000, a.area * 0.35) AND abs(k.mean - a.mean) <= 34),
k1 AS (SELECT k.*, CASE WHEN g1.rid IS NOT NULL THEN 'grown' ELSE s0 END AS s1 FROM k LEFT JOIN g1 ON k.page_id = g1.page_id AND k.rid = g1.rid),
g2 AS (SELECT DISTINCT k.page_id, k.rid FROM ad JOIN k1 a ON ad.page_id = a.page_id AND ad.src = a.rid AND a.s1 IN ('accepted', 'grown') JOIN k1 k ON ad.page_id = k.page_id AND ad.dst = k.rid
   WHERE k.s1 = 'none' AND k.score >= 0.18 AND k.area <= greatest(3000, a.area * 0.35) AND abs(k.mean - a.mean) <= 34)
SELECT k1.page_id, k1.rid AS region_id, area, round(score, 6) AS score, CASE WHEN g2.rid IS NOT NULL THEN 'grown' ELSE s1 END AS status FROM k1 LEFT JOIN g2 ON k1.page_id = g2.page_id AND k1.rid = g2.rid""")
def _(t):
    d = _map(t).withColumns({"pos": (F.col("gray") % 23 == 1).cast("int"), "neg": (F.col("gray") % 31 == 2).cast("int")})
    return G.grow_selection(d, "pos", "neg", "in_mask", 2).withColumn("score", F.round("score", 6))


# Each page is a list of 32 x 32 labels; a recursion step merges one fragment, in id order within a round.
_SIDES = "(p % 32 <> 1 AND l[p - 1] = {r}) OR (p % 32 <> 0 AND l[p + 1] = {r}) OR (p > 32 AND l[p - 32] = {r}) OR (p <= 992 AND l[p + 32] = {r})"


def _border(r):
    return f"list_transform(list_filter(range(1, 1025), lambda p: l[p] > 0 AND l[p] <> {r} AND ({_SIDES.format(r=r)})), lambda p: l[p])"


_TINY = "list_filter(list_sort(list_distinct(list_filter(l, lambda v: v > 0))), lambda q: len(list_filter(l, lambda v: v = q)) <= 20)"
_TARGET = "list_sort(list_transform(list_distinct(b), lambda v: {'c': -len(list_filter(b, lambda w: w = v)), 'v': v}))[1].v"


@query("merge_tiny", f"""
WITH RECURSIVE {_MAP},
g AS (SELECT page_id, p FROM (SELECT DISTINCT page_id FROM m) z, range(1, 1025) r(p)),
pg AS (SELECT g.page_id, list(coalesce(rid, 0) ORDER BY p) AS l FROM g LEFT JOIN m ON m.page_id = g.page_id AND m.y * 32 + m.x + 1 = p GROUP BY g.page_id),
st(page_id, step, turn, changed, l, todo) AS (
  SELECT page_id, 0, 1, false, l, {_TINY} FROM pg
  UNION ALL
  SELECT page_id, step + 1, CASE WHEN len(todo) = 0 THEN turn + 1 ELSE turn END, CASE WHEN len(todo) = 0 THEN false ELSE changed OR len(b) > 0 END,
    CASE WHEN len(b) > 0 THEN list_transform(l, lambda v: CASE WHEN v = todo[1] THEN {_TARGET} ELSE v END) ELSE l END,
    CASE WHEN len(todo) = 0 THEN {_TINY} ELSE todo[2:] END
  FROM (SELECT *, CASE WHEN len(todo) > 0 THEN {_border('todo[1]')} ELSE [] END AS b FROM st WHERE len(todo) > 0 OR (changed AND turn < 6)) z),
last AS (SELECT page_id, max_by(l, step) AS l FROM st GROUP BY page_id),
fin AS (SELECT page_id, l, len(list_filter({_TINY}, lambda r: len({_border('r')}) > 0)) = 0 AS settled FROM last)
SELECT m.page_id, m.x, m.y, CASE WHEN l[y * 32 + x + 1] > 0 THEN CAST(len(list_filter(list_distinct(l), lambda v: v > 0 AND v <= l[y * 32 + x + 1])) AS INT) ELSE 0 END AS region_id, settled
FROM m JOIN fin ON m.page_id = fin.page_id""")
def _(t):
    return G.merge_tiny(_map(t), 20)



@query("filter_components", """
WITH s AS (SELECT *, CAST(floor(area / 900) AS INT) AS a FROM regions)
SELECT 'strokes' AS rule, page_id, region_id FROM s WHERE a >= 8 OR (greatest(w, h) >= 5 AND least(w, h) <= greatest(3, floor(greatest(w, h) / 3)))
UNION ALL SELECT 'blobs', page_id, region_id FROM s WHERE a >= greatest(64, floor(1000 * 1400 * 0.00001)) AND a <= 0.4 * 1400000 AND x > 0 AND y > 0 AND x + w < 900 AND y + h < 1300
UNION ALL SELECT 'foreground', page_id, region_id FROM s WHERE NOT (region_id % 5 = 0 OR frac * 8 > 0.35)""")
def _(t):
    s = t.regions.withColumns({"touches_border": F.col("region_id") % 5 == 0, "frac": F.col("frac") * 8})
    # Areas scaled down so that the small-stroke rule has work to do.
    s = s.withColumn("area", F.floor(F.col("area") / 900).cast("int"))
    parts = [("strokes", G.filter_components(s, "strokes")), ("foreground", G.filter_components(s, "foreground")),
             ("blobs", s.where(G.enclosed_blob(F.lit(900), F.lit(1300), min_share=0.00001)))]
    out = [d.select(F.lit(r).alias("rule"), "page_id", "region_id") for r, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("closed_regions", """
WITH s AS (SELECT page_id * 10 + region_id % 10 AS sel, region_id, area, w, h, region_id % 4 = 1 AS op, 28000 + 200 * page_id AS sa,
   area / CAST(28000 + 200 * page_id AS DOUBLE) AS ra, (w / CAST(240 AS DOUBLE)) * (h / CAST(200 AS DOUBLE)) AS br FROM regions),
k AS (SELECT *, row_number() OVER (PARTITION BY sel ORDER BY area DESC, region_id) AS rn, count(*) OVER (PARTITION BY sel) AS n, sum(area) OVER (PARTITION BY sel) AS t FROM s WHERE NOT op AND ra <= 0.62),
d AS (SELECT * FROM k WHERE NOT (rn = 1 AND n > 1 AND ra > 0.38 AND br > 0.50 AND area > greatest(1, floor((t - area) * 1.5)))),
g AS (SELECT *, sum(area) OVER (PARTITION BY sel) AS left_area FROM d)
SELECT sel, region_id FROM g WHERE left_area / CAST(sa AS DOUBLE) <= 0.68""")
def _(t):
    s = t.regions.withColumns({"sel": F.col("page_id") * 10 + F.col("region_id") % 10, "is_open": F.col("region_id") % 4 == 1,
                               "sel_area": F.col("page_id") * 200 + 28000, "sel_w": F.lit(240), "sel_h": F.lit(200)})
    return G.closed_regions(s, ["sel"]).select("sel", "region_id")
