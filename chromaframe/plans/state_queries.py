"""Queries over the state operators (batch form) and the plug-in points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions.plugins import embed_with, map_pages
from chromaframe.operators import stats as A
from chromaframe.plans.registry import lab_cols, query
from chromaframe.scale import ensure_checkpoint_dir
from chromaframe.streaming import state as T
from chromaframe.streaming.log import append_latest, read_latest


@query("tone_memory")
def _(t):
    d = t.regions.where("conf >= 0.25").select((F.col("page_id") % 4).alias("book_id"), "label", F.col("page_id").cast("long").alias("seq"),
                                               "region_id", "mean_gray")
    return T.run_batch(T.tone_memory_rule(), d)


def _candidates(t):
    hair = C.rgb_to_hex((F.col("inst_id") * 7) % 64 + 90, (F.col("inst_id") * 11) % 64 + 90, F.lit(120))
    eyes = F.when(F.col("inst_id") % 3 == 0, C.rgb_to_hex((F.col("inst_id") * 5) % 96, F.lit(60), F.lit(90)))
    return t.instances.select("book_id", F.col("inst_id").alias("seq"), "tone", "aspect", "area_frac", "hist", "embedding", "lineart",
                              (F.col("inst_id") % 10 == 0).alias("manual"),
                              F.concat(F.lit("N"), (F.col("inst_id") % 4).cast("string")).alias("name"), hair.alias("hair"), eyes.alias("eyes"))


@query("profile_upsert")
def _(t):
    return T.run_batch(T.profile_upsert_rule(merge_at=0.32), _candidates(t))


def _observations(t):
    med = A.robust_median(t.cells.where("region_id > 0"), ["page_id", "region_id"], F.col("gray") < 200)
    return t.assignments.join(med, ["page_id", "region_id"])


_OBS = "m AS (SELECT page_id, region_id, count(*) AS n, " + ", ".join(
    f"CAST(trunc(CASE WHEN count(*) FILTER (WHERE gray < 200) >= 8 THEN quantile_cont({c}, 0.5) FILTER (WHERE gray < 200) ELSE quantile_cont({c}, 0.5) END) AS INT) AS o_{c}"
    for c in "rgb") + " FROM cells WHERE region_id > 0 GROUP BY 1, 2)"


@query("learnable", f"""
WITH {_OBS}, j AS (SELECT a.*, n, {lab_cols('o_r', 'o_g', 'o_b', 'k_')} FROM assignments a JOIN m ON a.page_id = m.page_id AND a.region_id = m.region_id)
SELECT page_id, region_id, attribute FROM j WHERE (forced OR (lock_allowed AND CASE attribute WHEN 'eyes' THEN match_score >= 0.48 AND semantic_confidence >= 0.18
  WHEN 'clothing' THEN match_score >= 0.44 AND semantic_confidence >= 0.16 AND margin >= 0.015 ELSE match_score >= 0.55 AND semantic_confidence >= 0.22 AND margin >= 0.02 END))
  AND n >= CASE WHEN attribute = 'eyes' THEN 4 ELSE 14 END AND sqrt((k_lab_a - 128) ** 2 + (k_lab_b - 128) ** 2) >= CASE attribute WHEN 'skin' THEN 4 WHEN 'clothing' THEN 6 ELSE 7 END""")
def _(t):
    return T.learnable(_observations(t)).select("page_id", "region_id", "attribute")


@query("learn_identity")
def _(t):
    d = T.learnable(_observations(t)).select(
        F.lit(0).alias("book_id"), "char_id", "attribute", (F.col("page_id").cast("long") * 100 + F.col("region_id")).alias("seq"),
        "color", C.rgb_to_hex("t_r", "t_g", "t_b").alias("start_color"), F.when(F.col("attribute") == "clothing", F.col("region_id") % 3).alias("preferred_slot"))
    return T.run_batch(T.learn_identity_rule(), d)


@query("dedupe_points")
def _(t):
    d = t.hints.where("source IN ('manual', 'manual_region')").withColumns({
        "r": F.col("r") % 4, "g": F.lit(0), "b": F.lit(0), "radius_norm": F.col("radius_norm") * 12, "region_id": F.col("region_id") % 3})
    return T.run_batch(T.dedupe_points_rule(), d)


@query("undo_redo")
def _(t):
    return T.run_batch(T.undo_redo_rule(), t.edit_log)


_STATUS = ("SELECT page_id, seq, CASE kind WHEN 'edit' THEN 'done' WHEN 'undo' THEN 'skipped' ELSE 'error' END AS status, "
           "CASE kind WHEN 'redo' THEN 'failed at ' || payload ELSE kind END AS message FROM edit_log")


def _status(t):
    return t.spark.sql(_STATUS.replace("FROM edit_log", "FROM {edit_log}"), edit_log=t.edit_log)


@query("page_status", f"""
WITH s AS ({_STATUS}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq DESC) AS rn FROM s)
SELECT page_id, status, message, seq FROM k WHERE rn = 1""")
def _(t):
    return T.page_status(_status(t))


@query("status_log", f"""
WITH s AS ({_STATUS}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq DESC) AS rn FROM s)
SELECT page_id, status, message, seq FROM k WHERE rn = 1""")
def _(t):
    """The log as a stream would leave it: five commits by sequence number, compacted on the way."""
    rows = _status(t)
    path = f"{ensure_checkpoint_dir(t.spark)}/status-{uuid.uuid4().hex}"
    for number in range(5):
        append_latest(rows.where(F.floor(F.col("seq") / 500) % 5 == number), path, number, T.page_status, fan=3)
    return read_latest(t.spark, path, T.page_status)


@query("batch_totals", f"""
WITH s AS ({_STATUS}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq DESC) AS rn FROM s), l AS (SELECT * FROM k WHERE rn = 1)
SELECT count(*) AS pages, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'error') AS errors, arg_min(message, seq) FILTER (WHERE status = 'error') AS first_error FROM l""")
def _(t):
    return T.batch_totals(T.page_status(_status(t)))


@query("embed_with")
def _(t):
    def load():
        return lambda texts: [[float(len(s)), float(s.count(" "))] for s in texts]
    return embed_with(t.documents.select("doc_id", "text"), "text", load).select("doc_id", F.get("embedding", F.lit(0)).alias("chars"), "embedding_error")


@query("map_pages", """
SELECT page_id, CASE WHEN contains(html, 'ad 1') THEN NULL ELSE CAST(length(html) AS BIGINT) END AS size, CASE WHEN contains(html, 'ad 1') THEN 'ValueError: bad page' END AS error FROM pages""")
def _(t):
    def measure(row):
        if "ad 1" in row["html"]:
            raise ValueError("bad page")
        return {"size": len(row["html"])}
    return map_pages(t.pages.select("page_id", "html"), measure, "size long")
