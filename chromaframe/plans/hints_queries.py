"""Queries over hint operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.operators import hints as H
from chromaframe.operators import windows as W
from chromaframe.plans.registry import query, r6

_RAW = """
SELECT hint_id, CASE WHEN hint_id % 5 IN (0, 1) THEN 'tuple' WHEN hint_id % 97 = 4 THEN 'blob' ELSE 'record' END AS kind,
       CASE WHEN hint_id % 41 <> 3 THEN x_norm * 1.5 - 0.2 END AS x_norm, y_norm * 1.2 AS y_norm, r * 2 - 50 AS r, g, b, radius_norm, strength,
       CASE WHEN hint_id % 7 <> 0 THEN source END AS source, confidence * 1.3 AS confidence FROM hints"""


@query("normalize_hints", f"""
WITH h AS ({_RAW}),
k AS (SELECT *, coalesce(source, 'auto_instance') AS src, kind = 'tuple' AS t, CASE WHEN kind = 'tuple' THEN 'auto_instance' ELSE coalesce(source, 'auto_instance') END AS s FROM h
      WHERE (kind = 'tuple' AND hint_id % 10 <> 5) OR (kind = 'record' AND x_norm IS NOT NULL))
SELECT hint_id, s AS source, round(greatest(0.0, least(1.0, coalesce(x_norm, 0.25))), 6) AS x_norm, CASE WHEN NOT t AND hint_id % 3 = 0 THEN 128 ELSE greatest(0, least(255, r)) END AS r,
  round(CASE WHEN t AND hint_id % 10 = 0 THEN 0.004 WHEN t THEN 0.0005 WHEN hint_id % 4 = 2 THEN 0.004 ELSE radius_norm END, 6) AS radius_norm,
  round(CASE WHEN t OR hint_id % 9 = 4 THEN CASE s WHEN 'auto_instance' THEN 0.32 WHEN 'manual' THEN 0.72 WHEN 'manual_region' THEN 1.0 WHEN 'scene_palette' THEN 0.28 ELSE 0.58 END ELSE strength END, 6) AS strength,
  round(CASE WHEN t THEN 1.0 ELSE least(1.0, confidence) END, 6) AS confidence,
  CASE s WHEN 'auto_instance' THEN 40 WHEN 'manual' THEN 100 WHEN 'manual_region' THEN 100 WHEN 'scene_palette' THEN 20 ELSE 70 END AS priority FROM k""")
def _(t):
    h = t.spark.sql(_RAW.replace("FROM hints", "FROM {hints}"), hints=t.hints)
    rgb = F.array("r", "g", "b")
    txt = lambda c: F.col(c).cast("string")
    xy = [F.coalesce(txt("x_norm"), F.lit("0.25")), txt("y_norm"), F.concat_ws(" ", txt("r"), txt("g"), txt("b"))]
    items = (F.when(F.col("hint_id") % 10 == 5, F.array(*xy[:2])).when(F.col("hint_id") % 10 == 0, F.array(*xy))
             .otherwise(F.array(*xy, F.lit("0.0001"))))
    raw = h.select("hint_id", "kind", "x_norm", "y_norm", F.when(F.col("hint_id") % 3 == 1, rgb).alias("rgb"),
                   F.when(F.col("hint_id") % 3 == 2, rgb).alias("color"),
                   F.when(F.col("hint_id") % 4 != 2, F.col("radius_norm")).alias("radius_norm"),
                   F.when(F.col("hint_id") % 9 != 4, F.col("strength")).alias("strength"), "source", "confidence",
                   F.lit(None).cast("int").alias("priority"), F.when(F.col("kind") == "tuple", items).alias("items"))
    good, _ = H.normalize_hints(raw)
    return good.select("hint_id", "source", r6("x_norm", "x_norm"), "r", r6("radius_norm", "radius_norm"),
                       r6("strength", "strength"), r6("confidence", "confidence"), "priority")


@query("override_by_region", """
WITH o AS (SELECT page_id, region_id, max(seq) AS s FROM hints WHERE source = 'manual_region' AND region_id > 0 AND hint_id % 3 = 0 GROUP BY 1, 2)
SELECT hint_id, 'auto' AS part FROM hints h WHERE NOT (source = 'manual_region' AND hint_id % 3 = 0) AND NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = h.page_id AND o.region_id = h.region_id)
UNION ALL SELECT s, 'region' FROM o""")
def _(t):
    # Every hint has a role: a third of the region hints override, all others stand as automatic ones.
    override = (F.col("source") == "manual_region") & (F.col("hint_id") % 3 == 0)
    kept, last = H.override_by_region(t.hints.where(~override), t.hints.where(override))
    return kept.select("hint_id", F.lit("auto").alias("part")).unionByName(last.select("hint_id", F.lit("region").alias("part")))


def _density(src, frac="frac", cap=120):
    """Three rounds of the best hint far enough from those chosen, then the page cap."""
    far = lambda a: f"(d.x_norm - {a}.x_norm) * (d.x_norm - {a}.x_norm) + (d.y_norm - {a}.y_norm) * (d.y_norm - {a}.y_norm) > 0.05 * 0.05"
    key = "page_id, region_id, source, character_id"
    on = lambda a: " AND ".join(f"d.{k} = {a}.{k}" for k in ("page_id", "region_id", "source", "character_id"))
    pick = f"row_number() OVER (PARTITION BY {', '.join('d.' + k for k in ('page_id', 'region_id', 'source', 'character_id'))} ORDER BY d.priority DESC, d.eff DESC, d.seq) AS rn"
    return f"""
d AS (SELECT h.*, greatest(0.0, least(1.0, strength * confidence)) AS eff, CASE WHEN {frac} IS NULL OR h.region_id = 0 THEN 2 WHEN {frac} <= 0.006 THEN 1 WHEN {frac} <= 0.04 THEN 2 ELSE 3 END AS lim
   FROM {src} h LEFT JOIN fr ON h.page_id = fr.page_id AND h.region_id = fr.region_id),
k1 AS (SELECT * FROM (SELECT d.*, {pick} FROM d) z WHERE rn = 1),
k2 AS (SELECT * EXCLUDE (rn) FROM (SELECT d.*, {pick} FROM d JOIN k1 ON {on('k1')} WHERE k1.lim >= 2 AND {far('k1')}) z WHERE rn = 1),
k3 AS (SELECT * EXCLUDE (rn) FROM (SELECT d.*, {pick} FROM d JOIN k1 ON {on('k1')} JOIN k2 ON {on('k2')} WHERE k1.lim >= 3 AND {far('k1')} AND {far('k2')}) z WHERE rn = 1),
al AS (SELECT * EXCLUDE (rn) FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3),
cp AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, eff DESC, seq) AS rn FROM al)"""


_FR = "fr AS (SELECT page_id, region_id, frac * 3 AS frac FROM regions)"


def _frac(t):
    return t.regions.select("page_id", "region_id", (F.col("frac") * 3).alias("frac"))


def _autos(t):
    return t.hints.where(~F.col("source").isin("manual", "manual_region"))


@query("limit_density", f"""
WITH au AS (SELECT * FROM hints WHERE source NOT IN ('manual', 'manual_region')), {_FR}, {_density('au')}
SELECT hint_id FROM cp WHERE rn <= 20""")
def _(t):
    return H.limit_density(_autos(t), _frac(t), 20, 0.05).select("hint_id")


@query("thin_evenly", """
WITH r AS (SELECT hint_id, row_number() OVER (PARTITION BY page_id, source ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY page_id, source) AS n FROM hints)
SELECT hint_id FROM r WHERE n <= 8 OR p = n - 1 OR p IN (SELECT CAST(floor(i * ((n - 1) / CAST(7 AS DOUBLE))) AS BIGINT) FROM (SELECT unnest(generate_series(0, 6)) AS i) z)""")
def _(t):
    return H.thin_evenly(t.hints, ["page_id", "source"], 8, width=1024).select("hint_id")


_COMPOSE = f"""
WITH m AS (SELECT * REPLACE (least(1.0, strength * CAST(1.13 AS DOUBLE)) AS strength, greatest(0.0005, radius_norm * CAST(1.31 AS DOUBLE)) AS radius_norm) FROM hints WHERE source IN ('manual', 'manual_region') AND hint_id % 4 = 0),
ov AS (SELECT page_id, region_id, max(seq) AS s FROM m WHERE source = 'manual_region' AND region_id > 0 GROUP BY 1, 2),
pt AS (SELECT * FROM m WHERE NOT (source = 'manual_region' AND region_id > 0)),
rest AS (SELECT * REPLACE (CASE WHEN source IN ('manual', 'manual_region') THEN 'auto_instance' ELSE source END AS source) FROM hints WHERE NOT (source IN ('manual', 'manual_region') AND hint_id % 4 = 0)),
au AS (SELECT * FROM rest a WHERE source <> 'style_only' AND strength * confidence > 0.01
  AND NOT EXISTS (SELECT 1 FROM ov WHERE ov.page_id = a.page_id AND ov.region_id = a.region_id)
  AND NOT EXISTS (SELECT 1 FROM pt m WHERE m.page_id = a.page_id AND (a.x_norm - m.x_norm) * (a.x_norm - m.x_norm) + (a.y_norm - m.y_norm) * (a.y_norm - m.y_norm)
     <= greatest(0.012, a.radius_norm + m.radius_norm) * greatest(0.012, a.radius_norm + m.radius_norm))
  AND NOT (source = 'character_identity' AND confidence < 0.56) AND NOT (source = 'auto_instance' AND confidence < 0.36)),
{_FR}, {_density('au').replace('0.05 * 0.05', '0.0025 * 0.0025')}"""


@query("compose_hints", _COMPOSE + """
SELECT hint_id, 'automatic' AS part FROM cp WHERE rn <= 120 UNION ALL SELECT s, 'region' FROM ov UNION ALL SELECT hint_id, 'manual' FROM pt""")
def _(t):
    # Manual hints that are not taken as such count as automatic ones, so every hint has a role.
    by_hand = F.col("source").isin("manual", "manual_region")
    manual = by_hand & (F.col("hint_id") % 4 == 0)
    autos = t.hints.where(~manual).withColumn("source", F.when(by_hand, "auto_instance").otherwise(F.col("source")))
    return H.compose_hints(autos, t.hints.where(manual), _frac(t), 0.6).select("hint_id", "part")


@query("expand_region_hints", """
WITH o AS (SELECT * FROM hints WHERE source = 'manual_region'),
e AS (SELECT page_id, region_id, CASE idx WHEN 0 THEN 'mid' ELSE 'shadow' END AS tier, region_id / CAST(20 AS DOUBLE) AS ex FROM (SELECT page_id, region_id, unnest([0, 1]) AS idx FROM regions WHERE region_id % 3 = 0) z)
SELECT o.hint_id, coalesce(e.tier, 'mid') AS tier, round(coalesce(ex, x_norm), 6) AS x_norm, round(greatest(0.002, radius_norm * 1.3), 6) AS radius_norm,
  CASE coalesce(e.tier, 'mid') WHEN 'mid' THEN o.region_id ELSE o.region_id + 100 END AS r FROM o JOIN (SELECT DISTINCT page_id, region_id FROM regions) q ON o.page_id = q.page_id AND o.region_id = q.region_id
  LEFT JOIN e ON o.page_id = e.page_id AND o.region_id = e.region_id""")
def _(t):
    keys = t.regions.select("page_id", "region_id")
    tiers = keys.select("*", F.inline(F.array(*[F.struct(
        F.lit(n).alias("tier"), (F.col("region_id") + v).alias("tier_r"), F.lit(0).alias("tier_g"), F.lit(0).alias("tier_b"))
        for n, v in (("mid", 0), ("shadow", 100), ("highlight", 200))])))
    ex = keys.where("region_id % 3 = 0").select("*", F.explode(F.array(F.lit("mid"), F.lit("shadow"))).alias("tier")).select(
        "*", (F.col("region_id") / 20.0).alias("x_norm"), F.lit(0.5).alias("y_norm"))
    d = H.expand_region_hints(t.hints.where("source = 'manual_region'"), tiers, ex, 0.6)
    return d.select("hint_id", "tier", r6("x_norm", "x_norm"), r6("radius_norm", "radius_norm"), "r")


@query("degrade_for_retry", """
SELECT hint_id, round(CASE WHEN source = 'character_identity' THEN greatest(0.001, radius_norm * 0.55) ELSE radius_norm END, 6) AS radius_norm,
  round(CASE WHEN source = 'character_identity' THEN strength * 0.72 ELSE strength END, 6) AS strength FROM hints WHERE source IN ('manual', 'manual_region', 'character_identity')""")
def _(t):
    return H.degrade_for_retry(t.hints).select("hint_id", r6("radius_norm", "radius_norm"), r6("strength", "strength"))


@query("last_by_source", "SELECT page_id, source, max(hint_id) AS hint_id FROM hints GROUP BY 1, 2")
def _(t):
    return H.last_by_source(t.hints).select("page_id", "source", "hint_id")


@query("clear_by_source", """SELECT hint_id, removed FROM hints h JOIN (SELECT page_id, count(*) FILTER (WHERE source = 'manual') AS removed FROM hints GROUP BY 1) c
  ON h.page_id = c.page_id WHERE source <> 'manual'""")
def _(t):
    return H.clear_by_source(t.hints, "manual").join(H.cleared_counts(t.hints, "manual"), "page_id").select("hint_id", "removed")


@query("pop_last", "SELECT hint_id FROM hints h WHERE seq < (SELECT max(seq) FROM hints z WHERE z.page_id = h.page_id)")
def _(t):
    return H.pop_last(t.hints).select("hint_id")


# --- windows -----------------------------------------------------------------

@query("reading_order", """
WITH RECURSIVE tol AS (SELECT page_id, avg(height) * 0.3 AS tl FROM panels GROUP BY 1),
st AS (SELECT p.page_id, min(y) AS s, 1 AS k FROM panels p GROUP BY 1
  UNION ALL SELECT st.page_id, (SELECT min(y) FROM panels q WHERE q.page_id = st.page_id AND y > s + tl), k + 1 FROM st JOIN tol ON st.page_id = tol.page_id
  WHERE EXISTS (SELECT 1 FROM panels q WHERE q.page_id = st.page_id AND y > s + tl)),
rw AS (SELECT p.page_id, idx, x, y, max(k) AS row FROM panels p JOIN st ON p.page_id = st.page_id AND p.y >= st.s GROUP BY ALL)
SELECT page_id, idx, CAST(row AS INT) AS row, CAST(row_number() OVER (PARTITION BY page_id ORDER BY row, -x, y, idx) - 1 AS INT) AS reading_index FROM rw""")
def _(t):
    return W.reading_order(t.panels, "manga").select("page_id", "idx", "row", "reading_index")


_IOU = "(greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)))"
_IOU = f"({_IOU} / CAST(k.w * k.h + b.w * b.h - {_IOU} AS DOUBLE))"


def _nms_sql(order, thr, cap, where="TRUE"):
    return f"""
WITH RECURSIVE b AS (SELECT page_id, region_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w * 3 AS DOUBLE) AS w, CAST(h * 3 AS DOUBLE) AS h,
   row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rn FROM regions WHERE {where}),
r AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE, id INTEGER)[]) AS kept FROM b
  UNION ALL SELECT r.page_id, b.rn, CASE WHEN len(kept) >= {cap} OR len([1 for k in kept if {_IOU} > {thr}]) > 0 THEN kept
    ELSE list_append(kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 'id': b.region_id}}) END FROM r JOIN b ON b.page_id = r.page_id AND b.rn = r.rn + 1),
l AS (SELECT page_id, arg_max(kept, rn) AS kept FROM r GROUP BY 1), u AS (SELECT page_id, unnest(kept) AS k FROM l)"""


def _boxes(t):
    return t.regions.select("page_id", F.col("region_id").alias("box_id"), "x", "y", (F.col("w") * 3).alias("w"),
                            (F.col("h") * 3).alias("h"), F.col("conf").alias("score"), F.col("region_id").alias("ord"))


@query("nms", _nms_sql("conf DESC, w * h DESC, region_id", 0.28, 12) + " SELECT page_id, k.id AS box_id FROM u")
def _(t):
    return W.nms(_boxes(t), cap=12).select("page_id", "box_id")


@query("crop_boxes", _nms_sql("region_id", 0.72, 999999, "w * 3 * h * 3 >= 1400000 * 0.0008 AND page_id % 4 <> 1") + """,
pg AS (SELECT DISTINCT page_id FROM regions), s AS (SELECT pg.page_id, count(k.id) AS n, max(k.w * k.h) AS a FROM pg LEFT JOIN u ON pg.page_id = u.page_id GROUP BY 1)
SELECT u.page_id, CAST(k.id AS BIGINT) AS box_id, CAST(k.w AS INT) AS w FROM u JOIN s ON u.page_id = s.page_id WHERE NOT (n = 1 AND a > 1400000 * 0.28)
UNION ALL SELECT page_id, NULL, 1000 FROM s WHERE n = 0 OR (n = 1 AND a > 1400000 * 0.28)""")
def _(t):
    pages = t.regions.select("page_id").distinct().select("page_id", F.lit(1000).alias("page_w"), F.lit(1400).alias("page_h"))
    return W.crop_boxes(_boxes(t).withColumns({c: F.when(F.col("page_id") % 4 == 1, 1).otherwise(F.col(c)) for c in "wh"}), pages).select("page_id", "box_id", "w")


@query("systematic_sample", """
WITH r AS (SELECT page_id, x, y, row_number() OVER (PARTITION BY page_id ORDER BY y, x) - 1 AS p, count(*) OVER (PARTITION BY page_id) AS n FROM px)
SELECT page_id, x, y FROM r WHERE n <= 300 OR p = n - 1 OR p IN (SELECT CAST(floor(i * ((n - 1) / CAST(299 AS DOUBLE))) AS BIGINT) FROM (SELECT unnest(generate_series(0, 299)) AS i) z)""")
def _(t):
    return W.systematic_sample(t.px, ["page_id"], 300, ["y", "x"], F.col("y")).select("page_id", "x", "y")


@query("page_palettes")
def _(t):
    from chromaframe.functions import color as C
    from chromaframe.operators.stats import page_palettes
    _, sat, val = C.rgb_to_hsv("r", "g", "b")
    usable = t.px.where(C.is_usable(sat, val, 28, 24, 248))
    return page_palettes(usable)


@query("score_clusters")
def _(t):
    from chromaframe.operators.stats import page_palettes, score_clusters
    d = score_clusters(page_palettes(t.px, max_colors=4), ["page_id"], (180, 145, 150), True)
    return d.withColumn("score", F.round("score", 6))


_EXEMPLAR = """
WITH d AS (SELECT page_id, region_id, x, y, gray, CAST((x * 7 + y * 11) % 9 AS DOUBLE) / 2 AS depth FROM cells WHERE region_id > 0),
f AS (SELECT * FROM d WHERE depth >= 1.25 AND gray BETWEEN 55 AND 242),
q AS (SELECT f.page_id, f.region_id, quantile_cont(gray, 0.5) AS q1, quantile_cont(gray, 0.8) AS q2, quantile_cont(gray, 0.2) AS q3, first(frac) * 3 AS fr
  FROM f JOIN regions r ON f.page_id = r.page_id AND f.region_id = r.region_id GROUP BY 1, 2),
t AS (SELECT *, unnest([1, 2, 3]) AS t FROM q),
c AS (SELECT f.page_id, f.region_id, t, f.x, f.y, f.gray, row_number() OVER (PARTITION BY f.page_id, f.region_id, t ORDER BY abs(gray - CASE t WHEN 1 THEN q1 WHEN 2 THEN q2 ELSE q3 END) + 7.0 / greatest(depth, 0.5), f.y, f.x) AS rn
  FROM f JOIN t ON f.page_id = t.page_id AND f.region_id = t.region_id WHERE t <= CASE WHEN fr <= 0.006 THEN 1 WHEN fr <= 0.04 THEN 2 ELSE 3 END),
a AS (SELECT * FROM c WHERE t = 1 AND rn = 1),
b AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.page_id, c.region_id ORDER BY c.rn) AS k FROM c JOIN a ON c.page_id = a.page_id AND c.region_id = a.region_id WHERE c.t = 2 AND NOT (c.x = a.x AND c.y = a.y)) z WHERE k = 1),
e AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.page_id, c.region_id ORDER BY c.rn) AS k FROM c JOIN a ON c.page_id = a.page_id AND c.region_id = a.region_id
   LEFT JOIN b ON c.page_id = b.page_id AND c.region_id = b.region_id WHERE c.t = 3 AND NOT (c.x = a.x AND c.y = a.y) AND NOT coalesce(c.x = b.x AND c.y = b.y, FALSE)) z WHERE k = 1)
SELECT page_id, region_id, 'mid' AS tier, x, y, gray FROM a UNION ALL SELECT page_id, region_id, 'highlight', x, y, gray FROM b UNION ALL SELECT page_id, region_id, 'shadow', x, y, gray FROM e"""


@query("tone_exemplars", _EXEMPLAR)
def _(t):
    d = t.cells.where("region_id > 0").withColumn("depth", (F.col("x") * 7 + F.col("y") * 11) % 9 / 2.0)
    return W.tone_exemplars(d, _frac(t))


_WHITE = "CASE WHEN (y + page_id) % 16 < 5 OR (x + page_id * 3) % 20 < 4 THEN 250 ELSE gray END"


def _split_sql(p, axis):
    return f"""
{p}n AS (SELECT page_id, max({axis}) + 1 AS len FROM w GROUP BY 1), {p}l AS (SELECT page_id, {axis} AS v, avg(CASE WHEN gray > 230 THEN 1.0 ELSE 0.0 END) AS s FROM w GROUP BY 1, 2),
{p}k AS (SELECT l.page_id, v, len, CAST(floor(len / 20) AS INT) AS m FROM {p}l l JOIN {p}n n ON l.page_id = n.page_id WHERE s >= 0.85),
{p}f AS (SELECT *, v - row_number() OVER (PARTITION BY page_id ORDER BY v) AS g FROM {p}k WHERE v >= m AND v < len - m),
{p}s AS (SELECT page_id, CAST(floor((min(v) + max(v) + 1) / 2) AS INT) AS split FROM {p}f GROUP BY page_id, g HAVING max(v) + 1 - min(v) >= 3 AND max(v) + 1 < first(len) - first(m))"""


def _white(t):
    return t.px.withColumn("gray", F.expr(_WHITE))


_W = f"w AS (SELECT page_id, x, y, {_WHITE} AS gray FROM px)"


@query("gap_splits", f"WITH {_W}, {_split_sql('r', 'y')}, {_split_sql('c', 'x')} SELECT page_id, 'y' AS axis, split FROM rs UNION ALL SELECT page_id, 'x', split FROM cs")
def _(t):
    d = _white(t)
    return W.gap_splits(d, "y", min_gap=3).select("page_id", F.lit("y").alias("axis"), "split").unionByName(
        W.gap_splits(d, "x", min_gap=3).select("page_id", F.lit("x").alias("axis"), "split"))


@query("panel_grid", f"""WITH {_W}, {_split_sql('r', 'y')}, {_split_sql('c', 'x')},
yb AS (SELECT page_id, s AS a, lead(s) OVER (PARTITION BY page_id ORDER BY s) AS z FROM (SELECT page_id, split AS s FROM rs UNION ALL SELECT page_id, 0 FROM rn UNION ALL SELECT page_id, len FROM rn) q),
xb AS (SELECT page_id, s AS a, lead(s) OVER (PARTITION BY page_id ORDER BY s) AS z FROM (SELECT page_id, split AS s FROM cs UNION ALL SELECT page_id, 0 FROM cn UNION ALL SELECT page_id, len FROM cn) q),
g AS (SELECT w.page_id, xb.a AS x, yb.a AS y, xb.z - xb.a AS width, yb.z - yb.a AS height, avg(gray) AS m FROM w JOIN yb ON w.page_id = yb.page_id AND w.y >= yb.a AND w.y < yb.z
  JOIN xb ON w.page_id = xb.page_id AND w.x >= xb.a AND w.x < xb.z GROUP BY ALL),
o AS (SELECT g.page_id, x, y, width, height FROM g JOIN rn ON g.page_id = rn.page_id JOIN cn ON g.page_id = cn.page_id WHERE width * height >= floor(rn.len * cn.len * 0.02) AND m <= 240)
SELECT * FROM o UNION ALL SELECT rn.page_id, 0, 0, cn.len, rn.len FROM rn JOIN cn ON rn.page_id = cn.page_id WHERE rn.page_id NOT IN (SELECT page_id FROM o)""")
def _(t):
    return W.panel_grid(_white(t), min_gap=3)


@query("dense_relabel", """
WITH c AS (SELECT page_id, x, y, CASE WHEN (region_id + page_id) % 3 = 0 THEN 0 ELSE region_id END AS r FROM cells)
SELECT c.page_id, x, y, CAST(coalesce(k, 0) AS INT) AS new_id FROM c LEFT JOIN (SELECT page_id, r, dense_rank() OVER (PARTITION BY page_id ORDER BY r) AS k FROM c WHERE r > 0 GROUP BY 1, 2) z ON c.page_id = z.page_id AND c.r = z.r""")
def _(t):
    d = t.cells.withColumn("region_id", F.when((F.col("region_id") + F.col("page_id")) % 3 == 0, 0).otherwise(F.col("region_id")))
    return W.dense_relabel(d).select("page_id", "x", "y", "new_id")


@query("near_best", """
WITH s AS (SELECT *, area / CAST(1400000 AS DOUBLE) AS fr, CAST(x <= 1 AS INT) + CAST(y <= 1 AS INT) + CAST(x + w >= 999 AS INT) + CAST(y + h >= 1399 AS INT) AS tch FROM regions WHERE area >= 1680),
k AS (SELECT page_id, region_id, mean_gray * pow(area, CAST(0.35 AS DOUBLE)) * (1.15 - least(0.8, sqrt(((x + w / 2.0) / 1000.0 - 0.5) ** 2 + ((y + h / 2.0) / 1400.0 - 0.5) ** 2))) * CASE WHEN tch >= 3 AND fr > 0.12 THEN 0.20 WHEN tch >= 2 AND fr > 0.25 THEN 0.45 ELSE 1 END AS sc FROM s WHERE fr <= 0.72)
SELECT page_id, region_id, round(sc, 4) AS score FROM k WHERE sc >= 0.28 * (SELECT max(sc) FROM k z WHERE z.page_id = k.page_id)""")
def _(t):
    d = t.regions.withColumns({"mean_chroma": F.col("mean_gray"), "cx": F.col("x") + F.col("w") / 2.0, "cy": F.col("y") + F.col("h") / 2.0})
    d = W.component_score(d, F.lit(1000.0), F.lit(1400.0))
    return W.near_best(d).select("page_id", "region_id", F.round("score", 4).alias("score"))


@query("top_components", """
WITH d AS (SELECT page_id, region_id, x, y, (x * 7 + y * 11) % 9 AS depth FROM cells WHERE region_id > 0),
a AS (SELECT page_id, region_id, count(*) AS area FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, region_id) AS rank FROM a WHERE area >= 12),
p AS (SELECT d.page_id, d.region_id, rank, x, y, row_number() OVER (PARTITION BY d.page_id, d.region_id ORDER BY depth DESC, y, x) AS rn FROM d JOIN r ON d.page_id = r.page_id AND d.region_id = r.region_id WHERE rank <= 4)
SELECT page_id, region_id, CAST(rank AS INT) AS rank, x, y FROM p WHERE rn = 1""")
def _(t):
    d = t.cells.where("region_id > 0").withColumn("depth", (F.col("x") * 7 + F.col("y") * 11) % 9)
    stats = d.groupBy("page_id", "region_id").agg(F.count(F.lit(1)).alias("area"))
    return W.component_seeds(d, W.top_components(stats, 4, 12))
