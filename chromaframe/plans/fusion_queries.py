"""Queries over gates, votes, overlays and set rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.operators import fusion as U
from chromaframe.plans.registry import query, r6

_GATE = """
WITH v AS (SELECT item_id % 5 AS model, pred, truth FROM truth WHERE truth <> 255),
s AS (SELECT model, count(*) FILTER (WHERE pred = 1 AND truth = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND truth <> 1) AS fp, count(*) FILTER (WHERE pred <> 1 AND truth = 1) AS fn,
  coalesce(count(*) FILTER (WHERE pred = 1 AND truth = 0) / nullif(CAST(count(*) FILTER (WHERE truth = 0) AS DOUBLE), 0), 0) AS ls,
  coalesce(count(*) FILTER (WHERE pred = 1 AND truth = 5) / nullif(CAST(count(*) FILTER (WHERE truth = 5) AS DOUBLE), 0), 0) AS lg FROM v GROUP BY 1)
SELECT model, tp, fp, fn, round(tp / CAST(greatest(1, tp + fn) AS DOUBLE), 6) AS recall, round(tp / CAST(greatest(1, tp + fp) AS DOUBLE), 6) AS precision,
  round(tp / CAST(greatest(1, tp + fp + fn) AS DOUBLE), 6) AS iou, round(ls, 6) AS leak_skin, round(lg, 6) AS leak_glasses,
  tp >= 0.7 * greatest(1, tp + fn) AND tp >= 0.7 * greatest(1, tp + fp) AND tp >= 0.6 * greatest(1, tp + fp + fn) AND ls <= 0.2 AND lg <= 0.1 AS production_ready FROM s"""


@query("release_gate", _GATE)
def _(t):
    d = U.release_gate(t.truth.withColumn("model", F.col("item_id") % 5), 1, {"skin": 0, "glasses": 5}, ["model"],
                       {"recall": 0.7, "precision": 0.7, "iou": 0.6}, {"skin": 0.2, "glasses": 0.1})
    return d.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "iou", "leak_skin", "leak_glasses")})


@query("label_coverage", """
WITH p AS (SELECT truth AS class_id, count(*) AS items FROM truth GROUP BY 1)
SELECT class_id, items, CAST((SELECT sum(items) FROM p WHERE class_id <> 255) AS BIGINT) AS labelled,
  CAST(coalesce((SELECT sum(items) FROM p WHERE class_id = 255), 0) AS BIGINT) AS ignored FROM p WHERE class_id <> 255""")
def _(t):
    return U.label_coverage(t.truth, "truth")



_TV = """
WITH tot AS (SELECT item_id, sum(prob) AS t FROM votes GROUP BY 1),
pb AS (SELECT v.item_id, class_id, sum(prob) / first(t) AS prob FROM votes v JOIN tot ON v.item_id = tot.item_id GROUP BY 1, 2),
d AS (SELECT pb.*, truth, truth = class_id AS hot FROM pb JOIN truth ON pb.item_id = truth.item_id WHERE truth <> 255),
s AS (SELECT class_id, coalesce(sum(prob) FILTER (WHERE hot), 0) AS tp, coalesce(sum(prob) FILTER (WHERE NOT hot), 0) AS fp, coalesce(sum(1 - prob) FILTER (WHERE hot), 0) AS fn, count(*) FILTER (WHERE hot) AS present FROM d GROUP BY 1),
k AS (SELECT *, (tp + 1) / (tp + (CASE WHEN class_id = 1 THEN 0.22 ELSE 0.5 END) * fp + (CASE WHEN class_id = 1 THEN 0.78 ELSE 0.5 END) * fn + 1) AS score FROM s)"""


def _tversky(t):
    tot = t.votes.groupBy("item_id").agg(F.sum("prob").alias("t"))
    pb = t.votes.groupBy("item_id", "class_id").agg(F.sum("prob").alias("prob")).join(tot, "item_id").select(
        "item_id", "class_id", (F.col("prob") / F.col("t")).alias("prob"))
    return U.tversky_score(pb, t.truth.select("item_id", "truth"), {1: (0.22, 0.78)})


@query("tversky_score", _TV + " SELECT class_id, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, present, round(score, 6) AS score FROM k")
def _(t):
    d = _tversky(t)
    return d.withColumns({c: F.round(c, 6) for c in ("tp", "fp", "fn", "score")})


@query("tversky_mean", _TV + " SELECT round(avg(score), 6) AS mean_score, count(*) AS classes FROM k WHERE present > 0")
def _(t):
    return U.tversky_mean(_tversky(t)).withColumn("mean_score", F.round("mean_score", 6))


_PRIO = "pr AS (SELECT class_id, (class_id * 7) % 10 AS rank FROM votes GROUP BY 1)"


def _priority(t):
    return t.votes.select("class_id").distinct().withColumn("rank", (F.col("class_id") * 7) % 10)


@query("priority_overlay", f"""
WITH {_PRIO}, l AS (SELECT item_id, class_id FROM votes WHERE prob > 0.85 AND item_id % 6 <> 0),
k AS (SELECT item_id, arg_max(l.class_id, rank) AS c FROM l JOIN pr ON l.class_id = pr.class_id GROUP BY 1)
SELECT v.item_id, CAST(coalesce(c, 255) AS INT) AS label FROM (SELECT DISTINCT item_id FROM votes) v LEFT JOIN k ON v.item_id = k.item_id""")
def _(t):
    items = t.votes.select("item_id").distinct()
    return U.priority_overlay(t.votes.where("prob > 0.85").select("item_id", "class_id"), items, _priority(t),
                              items.where("item_id % 6 <> 0"))


_FUSE = f"""
WITH {_PRIO}, w AS (SELECT source, CASE source WHEN 0 THEN 2.2 WHEN 1 THEN 1.8 WHEN 2 THEN 1.25 ELSE 1.45 END AS weight FROM votes GROUP BY 1),
g AS (SELECT item_id, truth AS class_id FROM truth WHERE truth <> 255 AND item_id % 4 = 0),
s AS (SELECT item_id, v.class_id, sum(prob * weight) AS s, max(prob) AS p FROM votes v JOIN w ON v.source = w.source GROUP BY 1, 2),
a AS (SELECT coalesce(s.item_id, g.item_id) AS item_id, coalesce(s.class_id, g.class_id) AS class_id, coalesce(s, 0) + CASE WHEN g.class_id IN (3, 4, 5) THEN 18.0 WHEN g.class_id IS NOT NULL THEN 8.0 ELSE 0 END AS s,
   greatest(coalesce(p, 0), CASE WHEN g.class_id IS NOT NULL THEN 1.0 ELSE 0 END) AS p FROM s FULL JOIN g ON s.item_id = g.item_id AND s.class_id = g.class_id),
n AS (SELECT item_id FROM g WHERE class_id IN (3, 4, 5)),
b AS (SELECT item_id, class_id, round(CASE WHEN class_id = 1 AND item_id IN (SELECT item_id FROM n) THEN -10.0 ELSE s END, 9) AS s, p FROM a
   UNION ALL SELECT item_id, 1, -10.0, 0 FROM n WHERE item_id NOT IN (SELECT item_id FROM a WHERE class_id = 1)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, class_id DESC) AS rn, count(*) OVER (PARTITION BY item_id) AS k FROM b),
t AS (SELECT item_id, max(CASE WHEN rn = 1 THEN s END) AS s1, max(CASE WHEN rn = 1 THEN class_id END) AS c1, max(CASE WHEN rn = 2 THEN s END) AS s2r, first(k) AS k,
   CASE WHEN first(k) < 10 THEN greatest(coalesce(s2r, 0), 0) ELSE s2r END AS s2, max(CASE WHEN class_id = 1 THEN s END) AS rs, max(CASE WHEN class_id = 1 THEN p END) AS rp FROM rk GROUP BY 1),
m AS (SELECT rk.item_id, sum(exp(greatest(-20.0, s - s1))) + (10 - first(t.k)) * exp(greatest(-20.0, -first(s1))) AS mass FROM rk JOIN t ON rk.item_id = t.item_id GROUP BY 1),
v AS (SELECT t.*, mass, CASE WHEN s1 >= 1.05 AND round(s1 - s2, 9) >= 0.18 THEN c1 ELSE 255 END AS vote FROM t JOIN m ON t.item_id = m.item_id),
f AS (SELECT *, coalesce(rp >= 0.42 AND rs > 0 AND vote IN (255, 0, 9), FALSE) AS promoted FROM v)
SELECT f.item_id, CAST(CASE WHEN g.class_id IS NOT NULL THEN g.class_id WHEN promoted THEN 1 ELSE vote END AS INT) AS label, promoted, round(s1, 6) AS top_score, round(s1 - s2, 6) AS margin,
   round(1 / (mass + 0.00000001), 6) AS top_probability FROM f LEFT JOIN g ON f.item_id = g.item_id"""


@query("fuse_votes", _FUSE)
def _(t):
    weight = F.when(F.col("source") == 0, 2.2).when(F.col("source") == 1, 1.8).when(F.col("source") == 2, 1.25).otherwise(1.45)
    weights = t.votes.select("source").distinct().withColumn("weight", weight)
    gold = t.truth.where("truth <> 255 AND item_id % 4 = 0").select("item_id", F.col("truth").alias("class_id"))
    d = U.fuse_votes(t.votes, weights, gold, 1, [3, 4, 5], [0, 9], _priority(t), n_classes=10)
    return d.select("item_id", "label", "promoted", r6("top_score", "top_score"), r6("margin", "margin"), r6("top_probability", "top_probability"))


_OLD, _NEW = "region_id % 2 = 1 AND page_id % 4 <> 3", "in_mask = 1 AND page_id % 3 <> 0"


@query("combine_selection", f"""
WITH o AS (SELECT page_id, x, y FROM cells WHERE {_OLD}), n AS (SELECT page_id, x, y FROM cells WHERE {_NEW}), tp AS (SELECT DISTINCT page_id FROM n)
SELECT 'add' AS mode, * FROM (SELECT * FROM o UNION SELECT * FROM n) UNION ALL SELECT 'subtract', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)
UNION ALL SELECT 'replace', * FROM (SELECT * FROM n UNION SELECT * FROM o WHERE page_id NOT IN (SELECT page_id FROM tp))""")
def _(t):
    old, new = t.cells.where(_OLD), t.cells.where(_NEW)
    out = [U.combine_selection(old, new, m).select(F.lit(m).alias("mode"), "page_id", "x", "y") for m in ("add", "subtract", "replace")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("replay_selection", """
SELECT page_id, cell, arg_max(sel_kind, seq) = 'add' AS selected, bool_or(sel_kind = 'add') AS positive, bool_or(sel_kind = 'erase') AS negative FROM edit_log GROUP BY 1, 2""")
def _(t):
    return U.replay_selection(t.edit_log)


# Pages without any cue (every ninth) keep their regions; they fall back on priors.
_EV = """
SELECT page_id, region_id, CASE WHEN page_id % 9 = 2 THEN 0 ELSE CAST((region_id * 37 + page_id) % 101 AS DOUBLE) / 100 END AS sem_hair,
  CASE WHEN page_id % 9 = 2 THEN 0 ELSE CAST((region_id * 53 + page_id * 3) % 67 AS DOUBLE) / 100 END AS sem_eye,
  CAST((region_id * 29 + page_id * 7) % 100 AS DOUBLE) / 100 AS sem_fg, CASE WHEN page_id % 9 = 2 THEN 0 ELSE CAST((region_id * 71 + page_id) % 100 AS DOUBLE) / 100 END AS sem_bg,
  CASE WHEN page_id % 9 = 2 THEN 'skin' ELSE label END AS clip_label, conf AS clip_conf,
  0.6 + CAST((region_id * 13 + page_id) % 40 AS DOUBLE) / 100 AS sim_hair, 0.6 + CAST((region_id * 17 + page_id) % 40 AS DOUBLE) / 100 AS sim_eye,
  region_id % 7 = 0 AS touches_border, frac * 10 AS area_ratio FROM regions"""


@query("fuse_region_evidence", f"""
WITH e AS ({_EV}),
k AS (SELECT *, CASE WHEN clip_label = 'hair' THEN clip_conf ELSE 0 END AS hc, CASE WHEN clip_label = 'eyes' THEN clip_conf ELSE 0 END AS ec, CASE WHEN clip_label = 'sky' THEN clip_conf ELSE 0 END AS bc,
  least(1.0, 0.56 * sem_hair + 0.20 * hc + greatest(0.0, (sim_hair - 0.76) / 0.24) * CASE WHEN sem_fg >= 0.16 THEN 0.82 ELSE 0.18 END) AS hs,
  least(1.0, 0.72 * sem_eye + 0.18 * ec + 0.10 * greatest(0.0, (sim_eye - 0.80) / 0.20)) AS es,
  greatest(0.0, least(1.0, greatest(0.68 * sem_bg + 0.22 * bc, CASE WHEN touches_border THEN 0.72 ELSE 0 END) - 0.52 * greatest(sem_hair, sem_eye, sem_fg))) AS bs,
  bool_or(sem_hair >= 0.50 OR (clip_label = 'hair' AND ((clip_conf >= 0.58 AND sem_fg >= 0.10) OR (clip_conf >= 0.74 AND NOT touches_border)))) OVER (PARTITION BY page_id) AS anch FROM e),
a AS (SELECT *, anch AND sim_hair >= 0.79 AND sem_fg >= 0.50 AND sem_eye < 0.16 AND clip_label NOT IN ('skin', 'eyes', 'bubble') AS grp, hc >= 0.74 AND NOT touches_border AS dir FROM k),
b AS (SELECT *, (hs >= 0.46 OR grp OR dir) AND area_ratio <= 0.20 AND (NOT touches_border OR sem_hair >= 0.72) AS h,
  (es >= 0.48 OR (ec >= 0.72 AND NOT touches_border)) AND area_ratio <= 0.04 AND NOT touches_border AS e,
  (bs >= 0.58 OR (bc >= 0.78 AND sem_hair < 0.15 AND sem_eye < 0.15)) AND sem_hair < 0.22 AND sem_eye < 0.20 AS g FROM a)
SELECT page_id, region_id, round(hs, 6) AS hair_score, round(es, 6) AS eye_score, round(bs, 6) AS background_score,
  concat_ws(',', CASE WHEN h THEN CASE WHEN dir AND hs < 0.46 AND NOT grp THEN 'hair_clip' WHEN grp AND hs < 0.46 THEN 'hair_grouped' ELSE 'hair' END END, CASE WHEN e THEN 'eye' END, CASE WHEN g THEN 'background' END) AS accepted,
  NOT bool_or(h) OVER (PARTITION BY page_id) AS use_prior_hair, NOT bool_or(e) OVER (PARTITION BY page_id) AS use_prior_eye, NOT bool_or(g) OVER (PARTITION BY page_id) AS use_prior_background FROM b""")
def _(t):
    e = t.spark.sql(_EV.replace("FROM regions", "FROM {regions}"), regions=t.regions)
    d = U.fuse_region_evidence(e)
    return d.select("page_id", "region_id", r6("hair_score", "hair_score"), r6("eye_score", "eye_score"),
                    r6("background_score", "background_score"), F.concat_ws(",", "accepted").alias("accepted"),
                    "use_prior_hair", "use_prior_eye", "use_prior_background")


@query("choose_partitioning", """
WITH f AS (SELECT page_id, x, y, region_id, CASE WHEN in_mask = 1 AND region_id IN (page_id % 6 + 1, 6) THEN 1 ELSE 0 END AS pr, CAST(floor(x / 16) + 2 * floor(y / 16) + 1 AS INT) AS rb FROM cells),
p AS (SELECT page_id, count(*) AS n, sum(pr) AS t, max(x) AS x1, max(y) AS y1 FROM f GROUP BY 1),
r AS (SELECT f.page_id, region_id, count(*) AS a, sum(pr) AS o, min(x) = 0 OR min(y) = 0 OR max(x) = first(x1) OR max(y) = first(y1) AS brd, first(n) AS n, first(t) AS t FROM f JOIN p ON f.page_id = p.page_id WHERE region_id > 0 GROUP BY 1, 2),
s AS (SELECT page_id FROM r GROUP BY 1 HAVING bool_or((a > n * 0.34 OR brd) AND o >= 8 AND o / CAST(greatest(1, t) AS DOUBLE) > 0.04) OR count(*) <= 1)
SELECT page_id, x, y, CASE WHEN page_id IN (SELECT page_id FROM s) THEN rb ELSE region_id END AS region_id, CASE WHEN page_id IN (SELECT page_id FROM s) THEN 'robust' ELSE 'fast' END AS backend FROM f""")
def _(t):
    prior = F.when((F.col("in_mask") == 1) & F.col("region_id").isin(6) | (F.col("in_mask") == 1) & (F.col("region_id") == F.col("page_id") % 6 + 1), 1).otherwise(0)
    fast = t.cells.withColumn("pr", prior)
    robust = t.cells.withColumn("region_id", (F.floor(F.col("x") / 16) + F.floor(F.col("y") / 16) * 2 + 1).cast("int"))
    return U.choose_partitioning(fast, robust, ["pr"])
