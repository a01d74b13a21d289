"""Queries over page quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromaframe.operators import quality as Q
from chromaframe.plans.registry import hsv_cols, lab_cols, query, r6

_HISTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE sat >= 24 AND floor(hue / 15) = {i} AND ok) AS BIGINT) AS h{i}" for i in range(12))
_HMAX = "greatest(" + ", ".join(f"h{i}" for i in range(12)) + ")"
_HSUM = "(" + " + ".join(f"h{i}" for i in range(12)) + ")"
_HOCC = "(" + " + ".join(f"CASE WHEN h{i} >= greatest(2.0, tot * 0.025) THEN 1 ELSE 0 END" for i in range(12)) + ")"

QUALITY_SQL = f"""
WITH p AS (SELECT page_id, gray, {lab_cols('r', 'g', 'b')}, {hsv_cols('r', 'g', 'b')},
                  sqrt((lab_a - 128) * (lab_a - 128) + (lab_b - 128) * (lab_b - 128)) AS chroma FROM px),
q AS (SELECT *, CASE WHEN count(*) FILTER (WHERE gray BETWEEN 35 AND 242) OVER (PARTITION BY page_id) > 0
                     THEN gray BETWEEN 35 AND 242 ELSE TRUE END AS ok FROM p),
a AS (SELECT page_id, quantile_cont(chroma, 0.5) FILTER (WHERE ok) AS cf,
             coalesce(quantile_cont(chroma, 0.75) FILTER (WHERE gray < 55), 0) AS ink, {_HISTS}
      FROM q GROUP BY page_id),
m AS (SELECT *, {_HSUM} AS tot, CASE WHEN tot > 0 THEN CAST({_HMAX} AS DOUBLE) / tot ELSE 1.0 END AS dom,
             CASE WHEN tot > 0 THEN {_HOCC} / CAST(12 AS DOUBLE) ELSE 0.0 END AS div,
             ((dom > 0.80 AND div < 0.34) OR cf < 7) AS wash, ink > 12 AS bleed FROM a)
SELECT page_id,
       CAST(greatest(0, least(100, 100 - CASE WHEN wash THEN 35 ELSE 0 END
         - CASE WHEN div < 0.20 THEN 15 WHEN div < 0.34 THEN 7 ELSE 0 END
         - CASE WHEN bleed THEN least(25, CAST(trunc((ink - 12) * 1.5) AS INT) + 8) ELSE 0 END
         - CASE WHEN cf > 45 THEN 5 ELSE 0 END)) AS INT) AS score,
       round_even(cf, 2) AS colorfulness, round_even(div, 3) AS hue_diversity,
       round_even(dom, 3) AS dominant_hue_ratio, round_even(ink, 2) AS ink_chroma,
       wash AS wash_detected, bleed AS line_bleed_detected,
       concat_ws(',', CASE WHEN wash THEN 'monochrome_wash' END,
                 CASE WHEN div < 0.20 THEN 'low_palette_diversity' END,
                 CASE WHEN bleed THEN 'colored_ink_or_edge_bleed' END) AS reasons
FROM m"""


@query("quality_report", QUALITY_SQL)
def _(t):
    return Q.quality_report(t.px).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("color_fraction", f"""
WITH p AS (SELECT page_id, {lab_cols('r', 'g', 'b')} FROM px),
f AS (SELECT page_id, avg(CASE WHEN sqrt((lab_a - 128) ** 2 + (lab_b - 128) ** 2) > 14 THEN 1.0 ELSE 0.0 END) AS v
      FROM p GROUP BY page_id)
SELECT page_id, round(v, 6) AS color_fraction, v >= 0.03 AS already_colored FROM f""")
def _(t):
    return Q.color_fraction(t.px).select("page_id", r6("color_fraction", "color_fraction"), "already_colored")


_AFTER = lab_cols("r2", "g2", "b2", "n_")


@query("line_bleed_ratio", f"""
WITH p AS (SELECT page_id, gray, {_AFTER} FROM px)
SELECT page_id, round(coalesce(avg(CASE WHEN sqrt((n_lab_a - 128) ** 2 + (n_lab_b - 128) ** 2) > 11 THEN 1.0 ELSE 0.0 END)
       FILTER (WHERE gray < 58), 0), 6) AS bleed FROM p GROUP BY page_id""")
def _(t):
    return Q.line_bleed_ratio(t.px).select("page_id", r6("bleed", "bleed"))


_DIFF = """
d AS (SELECT *, abs(r - q_r) AS dr, abs(g - q_g) AS dg, abs(b - q_b) AS db, ((77 * r + 150 * g + 29 * b + 128) >> 8) < 96 AS dark FROM s),
m AS (SELECT page_id, attempt, count(*) * CAST(3 AS DOUBLE) AS n, sum(dr * dr + dg * dg + db * db) / n AS mse,
        sum(dr + dg + db) / n AS mae, sum(CAST(dr > 8 AS INT) + CAST(dg > 8 AS INT) + CAST(db > 8 AS INT)) / n AS big,
        coalesce(sum(dr + dg + db) FILTER (WHERE dark) / (count(*) FILTER (WHERE dark) * CAST(3 AS DOUBLE)), 0) AS dk FROM d GROUP BY page_id, attempt),
k AS (SELECT *, CASE WHEN mse <= 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(65025 / mse) END AS psnr FROM m)"""


@query("diff_quality", f"""
WITH s AS (SELECT *, 1 AS attempt, r2 AS q_r, g2 AS q_g, b2 AS q_b FROM px), {_DIFF}
SELECT page_id, round(psnr, 6) AS psnr_db, round(mae, 6) AS mean_abs_error, round(big, 6) AS large_error_ratio,
       round(dk, 6) AS dark_mean_abs_error FROM k""")
def _(t):
    return Q.diff_quality(t.px).select("page_id", *[r6(c, c) for c in (
        "psnr_db", "mean_abs_error", "large_error_ratio", "dark_mean_abs_error")])


def _attempts(px):
    """Two decoded variants per pixel: a rough one and one an eighth as far off."""
    return px.select("page_id", "x", "y", "r", "g", "b", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("attempt"),
                     "r2", "g2").select(
        "*", F.when(F.col("attempt") == 1, F.col("r") + F.floor((F.col("r2") - F.col("r")) / 4).cast("int"))
        .otherwise(F.col("r") + F.floor((F.col("r2") - F.col("r")) / (F.lit(5) + F.col("page_id") % 7)).cast("int")).alias("q_r"),
        F.when(F.col("attempt") == 1, F.col("g2")).otherwise(F.col("g")).alias("q_g"), F.col("b").alias("q_b"))


@query("first_passing", f"""
WITH a AS (SELECT *, CAST(unnest(generate_series(1, 2)) AS INT) AS attempt FROM px),
s AS (SELECT page_id, attempt, r, g, b, CASE WHEN attempt = 1 THEN r + CAST(floor((r2 - r) / CAST(4 AS DOUBLE)) AS INT)
        ELSE r + CAST(floor((r2 - r) / CAST(5 + page_id % 7 AS DOUBLE)) AS INT) END AS q_r,
        CASE WHEN attempt = 1 THEN g2 ELSE g END AS q_g, b AS q_b FROM a), {_DIFF}
SELECT page_id, coalesce(min_by(CASE attempt WHEN 1 THEN 'q96-guarded' ELSE 'q98-guarded' END, attempt) FILTER (WHERE
   CASE attempt WHEN 1 THEN psnr >= 45 AND mae <= 1.25 AND big <= 0.0025 AND dk <= 1.55
                ELSE psnr >= 48 AND mae <= 0.90 AND big <= 0.0012 AND dk <= 1.15 END), 'lossless-fallback') AS variant
FROM k GROUP BY page_id""")
def _(t):
    metrics = Q.diff_quality(_attempts(t.px), ("page_id", "attempt"), decoded=("q_r", "q_g", "q_b"))
    return Q.first_passing(metrics)


@query("rank_candidates", f"""
WITH c AS (SELECT *, CAST(unnest(generate_series(0, 2)) AS INT) AS candidate FROM cells),
p AS (SELECT page_id, candidate, gray, {hsv_cols('r2', 'g2', 'b2')},
        (CASE candidate WHEN 0 THEN in_mask = 1 WHEN 1 THEN region_id > 0 AND gray < 120 ELSE gray < 0 END) AS m,
        ((hue <= 24 OR hue >= 170) AND sat >= 72 AND val >= 24) AS warm FROM c),
a AS (SELECT page_id, candidate, count(*) AS n, count(*) FILTER (WHERE m) AS hp, count(*) FILTER (WHERE warm) AS w,
        count(*) FILTER (WHERE m AND warm) AS ov, coalesce(avg(CASE WHEN gray < 160 THEN 1.0 ELSE 0.0 END) FILTER (WHERE m), 0) AS dk,
        coalesce(avg(gray) FILTER (WHERE m), 255) AS mg, hp / CAST(n AS DOUBLE) AS fr, ov / CAST(greatest(1, w) AS DOUBLE) AS rc,
        ov / CAST(greatest(1, hp) AS DOUBLE) AS pr FROM p GROUP BY page_id, candidate),
s AS (SELECT *, CASE WHEN hp = 0 THEN -1.0 ELSE round(0.40 * least(1.0, rc * 2.4) + 0.30 * least(1.0, pr * 5) + 0.20 * dk
        + 0.10 * (CASE WHEN fr BETWEEN 0.00008 AND 0.30 THEN 1.0 ELSE greatest(0.0, 1 - abs(fr - 0.12) * 4) END)
        - CASE WHEN fr > 0.42 THEN 0.35 ELSE 0 END - CASE WHEN mg > 215 THEN 0.18 ELSE 0 END, 6) END AS score FROM a)
SELECT page_id, candidate, CAST(score AS DOUBLE) AS score, hp AS hair_pixels, ov AS warm_overlap, round(rc, 6) AS warm_recall,
       round(pr, 6) AS warm_precision, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, candidate) AS INT) AS rank FROM s""")
def _(t):
    d = t.cells.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(2))))
    mask = (F.when(F.col("candidate") == 0, F.col("in_mask") == 1)
            .when(F.col("candidate") == 1, (F.col("region_id") > 0) & (F.col("gray") < 120))
            .otherwise(F.col("gray") < 0))
    return Q.rank_candidates(d.withColumn("mask", mask.cast("int")))


@query("export_summary", """
WITH s AS (SELECT l_returnflag AS profile, count(*) AS exported, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes_before,
             CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS bytes_after FROM lineitem GROUP BY 1)
SELECT profile, exported, bytes_before, bytes_after,
       round(greatest(0.0, (1.0 - bytes_after / CAST(bytes_before AS DOUBLE)) * 100), 6) AS saved_percent FROM s""")
def _(t):
    items = t.lineitem.selectExpr("l_returnflag AS profile", "CAST(floor(l_extendedprice) AS BIGINT) AS original_bytes",
                                  "CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS compressed_bytes")
    out = Q.export_summary(items, ["profile"])
    return out.select("profile", "exported", "bytes_before", "bytes_after", r6("saved_percent", "saved_percent"))


_RING = f"""
WITH p AS (SELECT page_id, hint_id, CAST(greatest(0, least(31, round_even(x_norm * 32, 0))) AS INT) AS cx,
             CAST(greatest(0, least(31, round_even(y_norm * 32, 0))) AS INT) AS cy,
             CAST(greatest(2, least(8, round_even(radius_norm * 6 * 32, 0))) AS INT) AS rad
           FROM hints WHERE source NOT IN ('manual', 'eyedropper_hint', 'style_only')),
q AS (SELECT * FROM p WHERE least(32, cx + rad * 3 + 1) - greatest(0, cx - rad * 3) >= 5 AND least(32, cy + rad * 3 + 1) - greatest(0, cy - rad * 3) >= 5),
l AS (SELECT page_id, x, y, {lab_cols('r', 'g', 'b')} FROM px),
j AS (SELECT q.page_id, hint_id, lab_l, lab_a, lab_b, rad, sqrt(CAST((x - cx) ** 2 + (y - cy) ** 2 AS DOUBLE)) AS d
      FROM q JOIN l ON q.page_id = l.page_id AND abs(x - cx) <= rad * 3 AND abs(y - cy) <= rad * 3),
m AS (SELECT page_id, hint_id, count(*) FILTER (WHERE d <= greatest(1.5, rad * 0.8)) AS ni,
        count(*) FILTER (WHERE d >= rad * 1.35 AND d <= rad * 2.5) AS no,
        {', '.join(f"quantile_cont({c}, 0.5) FILTER (WHERE d <= greatest(1.5, rad * 0.8)) AS i_{c}, quantile_cont({c}, 0.5) FILTER (WHERE d >= rad * 1.35 AND d <= rad * 2.5) AS o_{c}" for c in ('lab_l', 'lab_a', 'lab_b'))}
      FROM j GROUP BY page_id, hint_id),
c AS (SELECT page_id, hint_id, sqrt((i_lab_l - o_lab_l) ** 2 + (i_lab_a - o_lab_a) ** 2 + (i_lab_b - o_lab_b) ** 2) AS contrast
      FROM m WHERE ni >= 4 AND no >= 8)"""


def _big_hints(t):
    return t.hints.withColumn("radius_norm", F.col("radius_norm") * 6)


@query("ring_contrast", f"{_RING} SELECT page_id, hint_id, round(contrast, 6) AS contrast, contrast >= 14 AS suspicious FROM c")
def _(t):
    return Q.ring_contrast(_big_hints(t), t.px, 32, 32).select(
        "page_id", "hint_id", r6("contrast", "contrast"), "suspicious")


_BLOB = """b AS (SELECT page_id, round(quantile_cont(round(contrast, 4), 0.8), 6) AS blob_score, count(*) FILTER (WHERE contrast >= 14) AS suspicious,
   count(*) AS checked FROM c GROUP BY page_id)"""


@query("blob_report", f"{_RING}, {_BLOB} SELECT *, checked >= 2 AND blob_score >= 14 AS retry FROM b")
def _(t):
    d = Q.blob_report(Q.ring_contrast(_big_hints(t), t.px, 32, 32))
    return d.select("page_id", r6("blob_score", "blob_score"), "suspicious", "checked", "retry")


@query("spot_risk", f"""
WITH p AS (SELECT page_id, hint_id, CAST(round_even(x_norm * 31, 0) AS INT) AS cx, CAST(round_even(y_norm * 31, 0) AS INT) AS cy,
             greatest(2, CAST(round_even(radius_norm * 6 * 32, 0) AS INT)) AS rad
           FROM hints WHERE source <> 'style_only' AND strength * confidence > 0),
l AS (SELECT page_id, x, y, {lab_cols('r', 'g', 'b')}, {_AFTER} FROM px),
j AS (SELECT p.page_id, hint_id, rad, (x - cx) ** 2 + (y - cy) ** 2 AS d2, sqrt((n_lab_a - lab_a) ** 2 + (n_lab_b - lab_b) ** 2) AS ch, abs(n_lab_l - lab_l) AS li
      FROM p JOIN l ON p.page_id = l.page_id AND abs(x - cx) <= rad * 3 AND abs(y - cy) <= rad * 3),
f AS (SELECT *, d2 <= (rad * 0.7) ** 2 AS core, d2 >= (rad * 1.35) ** 2 AND d2 <= (rad * 2.2) ** 2 AS ring FROM j),
m AS (SELECT page_id, hint_id, avg(ch) FILTER (WHERE core) AS ci, avg(ch) FILTER (WHERE ring) AS co,
        avg(li) FILTER (WHERE core) AS lin, avg(li) FILTER (WHERE ring) AS lo FROM f GROUP BY page_id, hint_id)
SELECT page_id, hint_id, round(ci, 6) AS core_chroma, round(ci - co, 6) AS center_ring_gap, round(lin - lo, 6) AS light_gap,
       (ci >= 4.5 AND ci - co >= 3.5) OR (lin >= 6 AND lin - lo >= 5) AS spot_risk FROM m WHERE ci IS NOT NULL AND co IS NOT NULL""")
def _(t):
    return Q.spot_risk(_big_hints(t), t.px, 32, 32).select(
        "page_id", "hint_id", r6("core_chroma", "core_chroma"), r6("center_ring_gap", "center_ring_gap"),
        r6("light_gap", "light_gap"), "spot_risk")


_DRIFT_ROWS = "SELECT page_id, count(*) FILTER (WHERE margin > 0.17) AS drift_alerts FROM assignments GROUP BY page_id"


@query("review_queue", f"{_RING}, {_BLOB}, dr AS ({_DRIFT_ROWS}), qq AS ({QUALITY_SQL.strip()})"
       """ SELECT qq.page_id, score, blob_score, drift_alerts, concat_ws(',', CASE WHEN score < 60 THEN 'low_score' END,
       CASE WHEN coalesce(blob_score, 0) >= 14 THEN 'hint_blob' END, CASE WHEN coalesce(drift_alerts, 0) > 0 THEN 'identity_drift' END) AS why
FROM qq LEFT JOIN b ON qq.page_id = b.page_id LEFT JOIN dr ON qq.page_id = dr.page_id
WHERE score < 60 OR coalesce(blob_score, 0) >= 14 OR coalesce(drift_alerts, 0) > 0""")
def _(t):
    blobs = Q.blob_report(Q.ring_contrast(_big_hints(t), t.px, 32, 32)).select("page_id", r6("blob_score", "blob_score"))
    drift = t.assignments.groupBy("page_id").agg(F.count_if(F.col("margin") > 0.17).alias("drift_alerts"))
    return Q.review_queue(Q.quality_report(t.px), blobs, drift).select(
        "page_id", "score", "blob_score", "drift_alerts", "why")
