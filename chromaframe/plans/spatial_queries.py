"""Queries over joins by place and over work tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.functions import geometry as G
from chromaframe.operators import spatial as S
from chromaframe.plans.registry import lab_cols, query, r6


@query("points_to_regions", """
WITH p AS (SELECT page_id, hint_id AS point_id, CAST(round_even(x_norm * 31, 0) AS INT) AS x, CAST(round_even(y_norm * 31, 0) AS INT) AS y FROM hints WHERE page_id IN (SELECT page_id FROM px)),
u AS (SELECT p.*, c.region_id AS r0 FROM p JOIN cells c ON p.page_id = c.page_id AND p.x = c.x AND p.y = c.y),
ar AS (SELECT page_id, region_id, count(*) AS area FROM cells WHERE region_id > 0 GROUP BY 1, 2),
d AS (SELECT u.page_id, point_id, c.region_id, min((c.x - u.x) ** 2 + (c.y - u.y) ** 2) AS d2 FROM u JOIN cells c ON u.page_id = c.page_id AND c.region_id > 0
   AND abs(c.x - u.x) <= 24 AND abs(c.y - u.y) <= 24 WHERE r0 = 0 GROUP BY 1, 2, 3),
n AS (SELECT *, min(d2) OVER (PARTITION BY page_id, point_id) AS m FROM d),
k AS (SELECT n.*, row_number() OVER (PARTITION BY n.page_id, point_id ORDER BY area, n.region_id) AS rn FROM n JOIN ar ON n.page_id = ar.page_id AND n.region_id = ar.region_id WHERE d2 <= m + 4)
SELECT p.page_id, p.point_id, CASE WHEN r0 > 0 THEN r0 ELSE coalesce(k.region_id, 0) END AS region_id FROM p LEFT JOIN u ON u.page_id = p.page_id AND u.point_id = p.point_id LEFT JOIN k ON u.page_id = k.page_id AND u.point_id = k.point_id AND rn = 1""")
def _(t):
    p = t.hints.select("page_id", F.col("hint_id").alias("point_id"), F.bround(F.col("x_norm") * 31).cast("int").alias("x"),
                       F.bround(F.col("y_norm") * 31).cast("int").alias("y"))
    p = p.join(t.px.select("page_id").distinct(), "page_id", "left_semi")
    return S.points_to_regions(p, t.cells).select("page_id", "point_id", "region_id")


@query("hints_to_tiles", """
SELECT h.hint_id, idx AS tile_id, round((x_norm * 1000 - x) / width, 9) AS x_norm, round((y_norm * 1400 - y) / height, 9) AS y_norm,
  round(radius_norm * 1000 / width, 9) AS radius_norm FROM hints h JOIN panels p ON h.page_id = p.page_id
  AND x_norm * 1000 >= x AND x_norm * 1000 < x + width AND y_norm * 1400 >= y AND y_norm * 1400 < y + height""")
def _(t):
    d = S.hints_to_tiles(t.hints, t.panels.withColumnRenamed("idx", "tile_id"), 1000, 1400)
    return d.select("hint_id", "tile_id", *[F.round(c, 9).alias(c) for c in ("x_norm", "y_norm", "radius_norm")])


@query("suppress_near", """
SELECT hint_id FROM hints a WHERE source NOT IN ('manual', 'manual_region') AND NOT EXISTS (SELECT 1 FROM hints m WHERE m.source IN ('manual', 'manual_region')
  AND m.page_id = a.page_id AND (a.x_norm - m.x_norm) * (a.x_norm - m.x_norm) + (a.y_norm - m.y_norm) * (a.y_norm - m.y_norm)
  <= greatest(0.012, a.radius_norm + m.radius_norm) * greatest(0.012, a.radius_norm + m.radius_norm))""")
def _(t):
    manual = F.col("source").isin("manual", "manual_region")
    return S.suppress_near(t.hints.where(~manual), t.hints.where(manual)).select("hint_id")


_HEAD = ("CAST(trunc(CAST(x AS DOUBLE) - w * CAST(1.55 AS DOUBLE)) AS INT) AS bx, CAST(trunc(CAST(y AS DOUBLE) - h * CAST(1.45 AS DOUBLE)) AS INT) AS bty, "
         "w * 5 AS bw, h * 5 AS bh")


def _heads(t):
    a = t.anchors
    return a.select("page_id", "anchor_id", G.whole(F.col("x") - F.col("w") * 1.55).alias("x"),
                    G.whole(F.col("y") - F.col("h") * 1.45).alias("y"), (F.col("w") * 5).alias("w"), (F.col("h") * 5).alias("h"))


@query("pair_regions", f"""
WITH a AS (SELECT page_id, anchor_id, {_HEAD} FROM anchors),
c AS (SELECT page_id, region_id, area, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM regions WHERE frac <= 0.006 AND area >= 3 AND mean_gray BETWEEN 25 AND 225 AND CAST(w AS DOUBLE) / h BETWEEN 0.25 AND 4),
d AS (SELECT a.*, c.region_id, area, cx, cy FROM a JOIN c ON a.page_id = c.page_id AND region_id <> anchor_id AND cx BETWEEN bx + 0.08 * bw AND bx + 0.92 * bw AND cy BETWEEN bty + 0.25 * bh AND bty + 0.70 * bh),
p AS (SELECT l.page_id, l.anchor_id, l.region_id AS first_id, r.region_id AS second_id, round(CAST(abs(l.cy - r.cy) AS DOUBLE) / l.bh + 0.25 * CAST(abs(l.area - r.area) AS DOUBLE) / greatest(l.area, r.area), 9) AS cost
   FROM d l JOIN d r ON l.page_id = r.page_id AND l.anchor_id = r.anchor_id AND l.region_id < r.region_id AND abs(l.cx - r.cx) >= l.bw * 0.12 AND abs(l.cy - r.cy) <= l.bh * 0.12),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, anchor_id ORDER BY cost, first_id, second_id) AS rn FROM p)
SELECT page_id, anchor_id, first_id, second_id, round(cost, 6) AS cost FROM k WHERE rn = 1""")
def _(t):
    return S.pair_regions(t.regions, _heads(t)).withColumn("cost", F.round("cost", 6))


def _face_sql(p, left, up, wide, tall):
    d = lambda v: f"CAST({v} AS DOUBLE)"
    return (f"greatest(0, least(999, CAST(trunc(CAST(x AS DOUBLE) - w * {d(left)}) AS INT))) AS {p}x, "
            f"greatest(0, least(1399, CAST(trunc(CAST(y AS DOUBLE) - h * {d(up)}) AS INT))) AS {p}t, "
            f"greatest(1, least(1000 - {p}x, CAST(trunc(w * {d(wide)}) AS INT))) AS {p}w, "
            f"greatest(1, least(1400 - {p}t, CAST(trunc(h * {d(tall)}) AS INT))) AS {p}h")


@query("attach_regions", f"""
WITH f AS (SELECT page_id, anchor_id AS face_id, x AS fx, y AS ft, w AS fw, h AS fh, {_face_sql('h', 0.34, 0.52, 1.68, 1.78)}, {_face_sql('b', 1.00, 0.30, 3.00, 5.10)} FROM anchors),
j AS (SELECT f.*, region_id, area, frac, mean_gray, CAST(r.x + r.w / 2.0 AS DOUBLE) AS cx, CAST(r.y + r.h / 2.0 AS DOUBLE) AS cy, abs(cx - (fx + fw * 0.5)) / greatest(1.0, fw * 0.5) AS nx, (cy - ft) / greatest(1.0, CAST(fh AS DOUBLE)) AS ny,
   cx BETWEEN fx AND fx + fw AND cy BETWEEN ft AND ft + fh AS inf, cx BETWEEN hx AND hx + hw AND cy BETWEEN ht AND ht + hh AS inh, cx BETWEEN bx AND bx + bw AND cy BETWEEN bt AND bt + bh AS inb
   FROM f JOIN regions r ON f.page_id = r.page_id AND area >= 3),
g AS (SELECT *, inf AND ny BETWEEN 0.20 AND 0.68 AND nx <= 0.92 AND frac <= 0.007 AND mean_gray < 225 AS e,
   inf AND NOT e AND ny BETWEEN 0.08 AND 1.05 AND nx <= 0.95 AND mean_gray BETWEEN 45 AND 252 AS s,
   inh AND NOT (cx BETWEEN fx + fw * 0.15 AND fx + fw * 0.85 AND cy BETWEEN ft + fh * 0.18 AND ft + fh * 0.92) AND mean_gray < 238 AND frac <= 0.09 AS ha,
   inb AND cy > ft + fh * 0.72 AND NOT inh AND mean_gray BETWEEN 25 AND 250 AND frac <= 0.12 AS c FROM j),
u AS (SELECT page_id, face_id, region_id, area, 'eyes' AS attribute, 2 AS k FROM g WHERE e UNION ALL SELECT page_id, face_id, region_id, area, 'skin', 4 FROM g WHERE s
   UNION ALL SELECT page_id, face_id, region_id, area, 'hair', 5 FROM g WHERE ha UNION ALL SELECT page_id, face_id, region_id, area, 'clothing', 5 FROM g WHERE c),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id, face_id, attribute ORDER BY area DESC, region_id DESC) AS INT) AS rank FROM u)
SELECT page_id, face_id, region_id, area, attribute, rank FROM n WHERE rank <= k""")
def _(t):
    return S.attach_regions(t.regions, t.anchors.withColumnRenamed("anchor_id", "face_id"), 1000, 1400)


def _near_sql(p, pad):
    m = f"greatest({p}w, {p}h) * CAST({pad} AS DOUBLE)"
    return f"NOT (x + w < {p}x - {m} OR x > {p}x + {p}w + {m} OR y + h < {p}t - {m} OR y > {p}t + {p}h + {m})"


_PARENT = f"""
WITH f AS (SELECT page_id, anchor_id AS parent_id, {_face_sql('h', 0.34, 0.52, 1.68, 1.78)}, {_face_sql('b', 1.00, 0.30, 3.00, 5.10)} FROM anchors),
j AS (SELECT r.page_id, region_id AS item_id, area, conf, r.x, r.y, r.w, r.h, f.* EXCLUDE (page_id), CAST(r.x + r.w * 0.5 AS DOUBLE) AS cx, CAST(r.y + r.h * 0.5 AS DOUBLE) AS cy FROM regions r JOIN f ON r.page_id = f.page_id WHERE label <> 'hair'),
s AS (SELECT *, round(CASE WHEN {_near_sql('h', 0.95)} THEN 3.0 ELSE 0 END + CASE WHEN {_near_sql('b', 0.18)} THEN 0.95 ELSE 0 END
   + CASE WHEN cx BETWEEN bx - bw * 0.08 AND bx + bw * 1.08 AND cy BETWEEN ht - hh * 0.22 AND bt + bh THEN 0.8 ELSE 0 END
   - 0.55 * (abs(cx - (hx + hw * 0.5)) / greatest(1.0, bw * 0.60)) - 0.20 * (greatest(0.0, cy - (ht + hh * 0.45)) / greatest(1.0, bh * 0.82)), 9) AS score FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, item_id ORDER BY score DESC, parent_id) AS rn FROM s)"""


def _parents(t):
    box = ("x", "y", "w", "h")
    hb, bb = G.head_box_from_face(box, 1000, 1400), G.body_box_from_face(box, 1000, 1400)
    return t.anchors.select("page_id", F.col("anchor_id").alias("parent_id"), *[c.alias(f"h{n}") for c, n in zip(hb, "xywh")],
                            *[c.alias(f"b{n}") for c, n in zip(bb, "xywh")])


@query("best_parent", _PARENT + " SELECT page_id, item_id, parent_id, CAST(round(score, 6) AS DOUBLE) AS score FROM k WHERE rn = 1 AND score >= 0.85")
def _(t):
    items = t.regions.where("label <> 'hair'").withColumnRenamed("region_id", "item_id")
    return S.best_parent(items, _parents(t)).withColumn("score", F.round("score", 6))


@query("parent_groups", _PARENT + """ SELECT page_id, parent_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(sum(area) AS BIGINT) AS area,
  count(*) AS members, round(max(conf) + 1.6 + 0.12 * count(*), 6) AS score FROM k WHERE rn = 1 AND score >= 0.85 GROUP BY 1, 2""")
def _(t):
    items = t.regions.where("label <> 'hair'").withColumnRenamed("region_id", "item_id").withColumnRenamed("conf", "item_score")
    d = S.parent_groups(items, S.best_parent(items, _parents(t)))
    return d.withColumn("score", F.round("score", 6))


_VEC = ("WITH v AS (SELECT r.*, CAST(e.embedding AS DOUBLE[]) AS e FROM regions r JOIN embeddings e ON e.vec_id = r.page_id * 50 + r.region_id - 1)")


@query("anchor_similarity", _VEC + """,
j AS (SELECT r.page_id, r.region_id, a.region_id AS aid, sqrt(CAST((r.x + r.w / 2.0 - a.x - a.w / 2.0) AS DOUBLE) ** 2 + CAST((r.y + r.h / 2.0 - a.y - a.h / 2.0) AS DOUBLE) ** 2) / 1720.0 AS sp,
   sqrt(CAST(greatest(0, greatest(r.x, a.x) - least(r.x + r.w, a.x + a.w)) AS DOUBLE) ** 2 + CAST(greatest(0, greatest(r.y, a.y) - least(r.y + r.h, a.y + a.h)) AS DOUBLE) ** 2) / 1720.0 AS gap,
   list_dot_product(r.e, a.e) AS sim, CASE WHEN (r.region_id + a.region_id) % 5 <> 0 THEN CAST((r.region_id * 3 + a.region_id) % 60 AS DOUBLE) / 100 ELSE 0 END AS ink FROM v r JOIN v a ON r.page_id = a.page_id AND a.label = 'hair'),
s AS (SELECT page_id, region_id, max(greatest(-1.0, least(1.0, sim)) * (0.68 + 0.20 * greatest(0.0, 1 - sp / 0.34) + 0.12 * greatest(0.0, 1 - gap / 0.16)) * greatest(0.65, least(1.0, 1 - greatest(0.0, ink - 0.20) / 0.22))) AS s
  FROM j WHERE sp <= 0.34 AND gap <= 0.16 AND ink <= 0.42 GROUP BY 1, 2)
SELECT v.page_id, v.region_id, round(greatest(0.0, least(1.0, coalesce(s, 0))), 6) AS similarity FROM v LEFT JOIN s ON v.page_id = s.page_id AND v.region_id = s.region_id""")
def _(t):
    e = t.embeddings.select(F.floor(F.col("vec_id") / 50).cast("int").alias("page_id"),
                            (F.col("vec_id") % 50 + 1).cast("int").alias("region_id"), "embedding")
    v = t.regions.join(e, ["page_id", "region_id"])
    anchors = v.where("label = 'hair'")
    # One ink row per (region, region offset): the edge table of a page.
    ink = v.select("page_id", "region_id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("anchor_id")).where(
        "(region_id + anchor_id) % 5 <> 0").withColumn("ink_ratio", (F.col("region_id") * 3 + F.col("anchor_id")) % 60 / 100.0)
    return S.anchor_similarity(v, anchors, 1720.0, ink).withColumn("similarity", F.round("similarity", 6))


@query("mask_overlap", """SELECT page_id, region_id, count(*) AS area, count(*) FILTER (WHERE in_mask > 0) AS in_mask_pixels,
  round(count(*) FILTER (WHERE in_mask > 0) / CAST(count(*) AS DOUBLE), 6) AS in_mask_share FROM cells WHERE region_id > 0 GROUP BY 1, 2""")
def _(t):
    return S.mask_overlap(t.cells, ["in_mask"]).withColumn("in_mask_share", F.round("in_mask_share", 6))


@query("snap_to_regions", """
WITH m AS (SELECT *, CASE WHEN in_mask = 1 AND (region_id + page_id) % 3 <> 0 THEN 1 ELSE 0 END AS pr FROM cells),
pg AS (SELECT page_id, count(*) AS n, sum(pr) AS bf FROM m GROUP BY 1),
r AS (SELECT m.page_id, region_id, count(*) AS a, sum(pr) AS o, first(n) AS n, first(bf) AS bf FROM m JOIN pg ON m.page_id = pg.page_id WHERE region_id > 0 GROUP BY 1, 2),
k AS (SELECT * FROM r WHERE a <= n * 0.16 AND o / CAST(a AS DOUBLE) >= CASE WHEN a >= 80 THEN 0.34 ELSE 0.26 END AND o >= greatest(5, CAST(trunc(a * 0.20) AS INT))),
g AS (SELECT page_id FROM k GROUP BY 1 HAVING first(bf) + sum(a - o) <= floor(greatest(first(bf) + 16, first(bf) * 1.80)))
SELECT m.page_id, m.x, m.y, pr = 0 AS added FROM m LEFT JOIN (SELECT page_id, region_id FROM k WHERE page_id IN (SELECT page_id FROM g)) z
  ON m.page_id = z.page_id AND m.region_id = z.region_id WHERE pr = 1 OR z.region_id IS NOT NULL""")
def _(t):
    d = t.cells.withColumn("pr", F.when((F.col("in_mask") == 1) & ((F.col("region_id") + F.col("page_id")) % 3 != 0), 1).otherwise(0))
    return S.snap_to_regions(d, "pr", max_growth=1.80).select("page_id", "x", "y", "added")


_GOAL = f"g AS (SELECT {lab_cols('180', '120', '60', 't_')})"
_BOTH = f"p AS (SELECT *, {lab_cols('r', 'g', 'b', 'k_')}, {lab_cols('r2', 'g2', 'b2', 'n_')} FROM cells)"
_DIST = ("greatest(abs(r2 - r), abs(g2 - g), abs(b2 - b)) AS dl, sqrt((k_lab_l - t_lab_l) ** 2 + (k_lab_a - t_lab_a) ** 2 + (k_lab_b - t_lab_b) ** 2) AS d0, "
         "sqrt((n_lab_l - t_lab_l) ** 2 + (n_lab_a - t_lab_a) ** 2 + (n_lab_b - t_lab_b) ** 2) AS d1")


@query("compare_runs", f"""
WITH {_GOAL}, {_BOTH}, q AS (SELECT page_id, in_mask, region_id, {_DIST} FROM p, g)
SELECT page_id, count(*) FILTER (WHERE in_mask = 1) AS mask_pixels,
  round(100.0 * count(*) FILTER (WHERE in_mask = 1 AND d1 + 0.5 < d0) / nullif(count(*) FILTER (WHERE in_mask = 1), 0), 6) AS coverage_percent,
  round(100.0 * count(*) FILTER (WHERE in_mask = 1 AND dl > 1) / nullif(count(*) FILTER (WHERE in_mask = 1), 0), 6) AS changed_percent,
  round(avg(d0) FILTER (WHERE in_mask = 1), 6) AS delta_e_before, round(avg(d1) FILTER (WHERE in_mask = 1), 6) AS delta_e_after,
  count(*) FILTER (WHERE in_mask = 1 AND dl <= 1) AS unchanged_inside, count(*) FILTER (WHERE in_mask = 0 AND dl > 1) AS outside_changed,
  round(100.0 * count(*) FILTER (WHERE in_mask = 0 AND dl > 1) / greatest(1, count(*) FILTER (WHERE in_mask = 0)), 6) AS outside_percent,
  count(*) FILTER (WHERE region_id > 0) AS region_id_pixels, round(100.0 * count(*) FILTER (WHERE region_id > 0 AND dl > 1) / nullif(count(*) FILTER (WHERE region_id > 0), 0), 6) AS region_id_leak_percent
FROM q GROUP BY page_id""")
def _(t):
    d = S.compare_runs(t.cells, "in_mask", (180, 120, 60), ["region_id"])
    keep = ("coverage_percent", "changed_percent", "delta_e_before", "delta_e_after", "outside_percent", "region_id_leak_percent")
    return d.withColumns({c: F.round(c, 6) for c in keep})


@query("candidate_evidence", f"""
WITH {_GOAL}, {_BOTH}, q AS (SELECT page_id, in_mask, region_id, {_DIST} FROM p, g)
SELECT page_id, count(*) FILTER (WHERE dl > 8) AS changed_pixels, round(avg(dl), 6) AS mean_change, round(avg(dl) FILTER (WHERE in_mask > 0), 6) AS positive_change,
  round(avg(dl) FILTER (WHERE region_id > 0), 6) AS negative_change, count(*) FILTER (WHERE dl > 8 AND region_id > 0) AS negative_changed,
  round(avg(d0 - d1) FILTER (WHERE in_mask > 0), 6) AS target_gain FROM q GROUP BY page_id""")
def _(t):
    d = S.candidate_evidence(t.cells, "in_mask", "region_id", (180, 120, 60))
    return d.withColumns({c: F.round(c, 6) for c in ("mean_change", "positive_change", "negative_change", "target_gain")})


_AGREE = """WITH c AS (SELECT page_id, x, y, in_mask, CASE WHEN region_id = 5 THEN 1 ELSE 0 END AS neg,
   least(sqrt(CAST((r2 - r) ** 2 + (g2 - g) ** 2 + (b2 - b) ** 2 AS DOUBLE)), sqrt(CAST((g2 - r) ** 2 + (r2 - g) ** 2 + (b2 - b) ** 2 AS DOUBLE))) AS cf FROM cells)"""


def _agree(t):
    d = t.cells.withColumn("neg", F.when(F.col("region_id") == 5, 1).otherwise(0))
    return S.agreement(d, ("r", "g", "b"), ("r2", "g2", "b2"), ("g2", "r2", "b2"), "in_mask", "neg", threshold=9.5)


@query("agreement", _AGREE + " SELECT page_id, x, y, round(cf, 6) AS confidence, cf > 9.5 AS raw, cf > 9.5 AND in_mask = 1 AND neg = 0 AS selected FROM c")
def _(t):
    return _agree(t).select("page_id", "x", "y", r6("confidence", "confidence"), "raw", "selected")


@query("agreement_counts", _AGREE + """ SELECT page_id, count(*) FILTER (WHERE in_mask > 0) AS rough_pixels, count(*) FILTER (WHERE cf > 9.5) AS raw_pixels,
  count(*) FILTER (WHERE cf > 9.5 AND in_mask = 1 AND neg = 0) AS candidate_pixels, count(*) FILTER (WHERE cf > 9.5 AND in_mask = 0) AS removed_outside,
  count(*) FILTER (WHERE cf > 9.5 AND in_mask = 1 AND neg = 1) AS removed_negative FROM c GROUP BY page_id""")
def _(t):
    return S.agreement_counts(_agree(t), "in_mask", "neg")


_SEL = """
WITH h AS (SELECT *, CAST(round_even(x_norm * 31, 0) AS INT) AS x, CAST(round_even(y_norm * 31, 0) AS INT) AS y FROM hints),
s AS (SELECT page_id, x, y FROM cells WHERE in_mask = 1), e AS (SELECT page_id, x, y FROM cells WHERE in_mask = 1 OR region_id > 0),
f AS (SELECT h.*, s.x IS NOT NULL AS ins, e.x IS NOT NULL AS nearby, source IN ('manual', 'manual_region') AS man FROM h LEFT JOIN s ON h.page_id = s.page_id AND h.x = s.x AND h.y = s.y
   LEFT JOIN e ON h.page_id = e.page_id AND h.x = e.x AND h.y = e.y),
l AS (SELECT DISTINCT page_id FROM f WHERE nearby AND man),
k AS (SELECT *, nearby AND NOT (NOT man AND ins AND page_id IN (SELECT page_id FROM l)) AS keep FROM f)"""


def _kept(t):
    return S.points_in_selection(t.hints, t.cells.where("in_mask = 1"), t.cells.where("in_mask = 1 OR region_id > 0"), 32, 32)


@query("points_in_selection", _SEL + " SELECT hint_id, x, y, keep FROM k")
def _(t):
    return _kept(t).select("hint_id", "x", "y", "keep")


@query("count_in_selection", _SEL + " SELECT page_id, count(*) FILTER (WHERE keep) AS points_in, count(*) FILTER (WHERE NOT keep) AS points_out FROM k GROUP BY 1")
def _(t):
    return S.count_in_selection(_kept(t))


@query("delete_in_selection", _SEL + " SELECT hint_id FROM f WHERE NOT (man AND ins)")
def _(t):
    return S.delete_in_selection(t.hints, t.cells.where("in_mask = 1"), 32, 32).select("hint_id")


@query("pending", """
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS p, l_returnflag FROM lineitem),
d AS (SELECT DISTINCT l_partkey, round(l_extendedprice, 1) AS p, l_returnflag FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, l_linenumber FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.l_partkey = i.l_partkey AND d.p = i.p AND d.l_returnflag = i.l_returnflag)""")
def _(t):
    key = {"l_partkey": None, "l_extendedprice": 1, "l_returnflag": None}
    return S.pending(t.lineitem, t.lineitem.where("l_linestatus = 'F'"), key).select("l_orderkey", "l_linenumber")


@query("commit_if_unchanged", """
WITH c AS (SELECT page_id, cell AS layer, max(seq) AS revision FROM edit_log GROUP BY 1, 2)
SELECT e.seq, coalesce(e.seq = c.revision, FALSE) AS accepted FROM edit_log e LEFT JOIN c ON e.page_id = c.page_id AND e.cell = c.layer""")
def _(t):
    log = t.edit_log.withColumnRenamed("cell", "layer")
    now = log.groupBy("page_id", "layer").agg(F.max("seq").alias("revision"))
    return S.commit_if_unchanged(now, log.withColumn("revision", F.col("seq"))).select("seq", "accepted")
