"""Page-shaped views over the given tables, in SQL that Spark and DuckDB both run.

Tables stand in braces. Three tokens differ per engine: ``@list(`` builds an array,
``@at(`` reads it from 1, ``@series(`` makes one row per whole number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_HIST = ", ".join(f"abs(@at(embedding, {i}))" for i in range(1, 13))
_HIST_SUM = " + ".join(f"abs(@at(embedding, {i}))" for i in range(1, 13))
_HIST_N = "@list(" + ", ".join(
    f"CAST(abs(@at(embedding, {i})) AS DOUBLE) / CAST({_HIST_SUM} AS DOUBLE)" for i in range(1, 13)) + ")"
_LINE = "@list(" + ", ".join(f"@at(embedding, {i})" for i in range(17, 33)) + ")"

VIEWS: dict[str, str] = {
    "px": """
SELECT CAST(floor(o_orderkey / 1024) AS INT) AS page_id,
       CAST(o_orderkey % 32 AS INT) AS x,
       CAST(floor((o_orderkey % 1024) / 32) AS INT) AS y,
       CAST((o_custkey * 7 + o_orderkey * 3) % 256 AS INT) AS gray,
       CAST((o_custkey * 13 + o_orderkey * 5) % 256 AS INT) AS r,
       CAST((o_custkey * 29 + o_orderkey * 11) % 256 AS INT) AS g,
       CAST((o_custkey * 3 + o_orderkey * 17) % 256 AS INT) AS b,
       CAST(least(255, (o_custkey * 13 + o_orderkey * 5) % 256 + o_custkey % 17) AS INT) AS r2,
       CAST(least(255, (o_custkey * 29 + o_orderkey * 11) % 256 + o_custkey % 5) AS INT) AS g2,
       CAST((o_custkey * 3 + o_orderkey * 17) % 256 AS INT) AS b2
FROM {orders}""",
    "cells": """
SELECT page_id, x, y, gray, r, g, b, r2, g2, b2,
       CASE WHEN (x % 8 = 0 OR y % 8 = 0) AND gray % 7 <> 0 THEN 0 ELSE 1 END AS fillable,
       CASE WHEN (x % 8 = 0 OR y % 8 = 0) THEN 0
            ELSE CAST(floor(y / 8) * 4 + floor(x / 8) + 1 AS INT) END AS region_id,
       CASE WHEN (x * 5 + y * 3) % 11 < 4 THEN 1 ELSE 0 END AS in_mask
FROM {px}""",
    "regions": """
SELECT CAST(floor(p_partkey / 50) AS INT) AS page_id,
       CAST(p_partkey % 50 + 1 AS INT) AS region_id,
       CAST((p_partkey * 37) % 900 AS INT) AS x,
       CAST((p_partkey * 91) % 1300 AS INT) AS y,
       CAST(20 + p_size * 4 AS INT) AS w,
       CAST(30 + (p_partkey * 7) % 160 AS INT) AS h,
       CAST((20 + p_size * 4) * (30 + (p_partkey * 7) % 160) AS INT) AS area,
       CAST((p_partkey * 29) % 256 AS DOUBLE) AS mean_gray,
       CAST((20 + p_size * 4) * (30 + (p_partkey * 7) % 160) AS DOUBLE) / 1400000 AS frac,
       CASE p_partkey % 5 WHEN 0 THEN 'hair' WHEN 1 THEN 'skin' WHEN 2 THEN 'eyes'
                          WHEN 3 THEN 'clothing' ELSE 'sky' END AS label,
       CAST((p_partkey * 53) % 100 AS DOUBLE) / 100 AS conf
FROM {part}""",
    # Matched anchors: every hair region, with the outcome of an identity match.
    "anchors": """
SELECT page_id, region_id AS anchor_id, x, y, w, h,
       CAST((page_id * 3 + region_id) % 10 AS INT) AS char_id,
       CAST((page_id * 7 + region_id * 11) % 60 AS DOUBLE) / 100 AS distance,
       1.0 - CAST((page_id * 7 + region_id * 11) % 60 AS DOUBLE) / 100 AS match_score,
       CAST((page_id * 5 + region_id * 13) % 20 AS DOUBLE) / 100 AS margin,
       ((page_id + region_id) % 3 <> 0) AS lock_allowed,
       (region_id % 17 = 0) AS forced
FROM {regions} WHERE label = 'hair'""",
    # One library per book: the first vector of every class is its profile.
    "profiles": f"""
SELECT book_id, char_id,
       CAST((char_id * 41 + book_id * 13) % 256 AS DOUBLE) AS tone,
       0.5 + CAST(char_id % 7 AS DOUBLE) / 4 AS aspect,
       0.01 + CAST(char_id % 5 AS DOUBLE) / 100 AS area_frac,
       {_HIST_N} AS hist,
       CASE WHEN char_id % 6 = 5 THEN NULL ELSE embedding END AS embedding,
       CASE WHEN char_id % 4 = 3 THEN NULL ELSE {_LINE} END AS lineart,
       CAST((char_id * 67 + book_id * 29) % 256 AS INT) AS hair_r,
       CAST((char_id * 23 + book_id * 31) % 256 AS INT) AS hair_g,
       CAST((char_id * 91 + book_id * 37) % 256 AS INT) AS hair_b
FROM (SELECT CAST(vec_id % 3 AS INT) AS book_id, CAST(label AS INT) AS char_id,
             min_by(embedding, vec_id) AS embedding
      FROM {{embeddings}} GROUP BY 1, 2) firsts""",
    # forced: a profile pinned by a user, -1 = never match, NULL = automatic.
    "instances": f"""
SELECT CAST(vec_id % 3 AS INT) AS book_id, CAST(vec_id % 40 AS INT) AS page_id, vec_id AS inst_id,
       CAST((vec_id * 31) % 256 AS DOUBLE) AS tone,
       0.4 + CAST(vec_id % 9 AS DOUBLE) / 4 AS aspect,
       0.005 + CAST(vec_id % 6 AS DOUBLE) / 100 AS area_frac,
       {_HIST_N} AS hist,
       embedding,
       CASE WHEN vec_id % 5 = 0 THEN NULL ELSE {_LINE} END AS lineart,
       CAST((vec_id * 17) % 100 AS DOUBLE) / 100 AS conf,
       CAST(CASE WHEN vec_id % 50 = 0 THEN -1 WHEN vec_id % 50 = 1 THEN 3 END AS INT) AS forced
FROM {{embeddings}}""",
    "hints": """
SELECT CAST(user_id AS INT) AS page_id, event_id AS hint_id, event_id AS seq,
       CAST((event_id * 7919) % 10000 AS DOUBLE) / 10000 AS x_norm,
       CAST((event_id * 10473) % 10000 AS DOUBLE) / 10000 AS y_norm,
       CAST((event_id * 3) % 256 AS INT) AS r,
       CAST((event_id * 5) % 256 AS INT) AS g,
       CAST((event_id * 7) % 256 AS INT) AS b,
       0.004 + CAST(event_id % 4 AS DOUBLE) / 250 AS radius_norm,
       CAST((event_id * 13) % 100 AS DOUBLE) / 100 AS strength,
       CASE event_type WHEN 'purchase' THEN 'manual' WHEN 'signup' THEN 'manual_region'
                       WHEN 'click' THEN 'auto_instance' WHEN 'view' THEN 'scene_palette'
                       ELSE 'character_identity' END AS source,
       CAST(CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 100
                       WHEN 'click' THEN 40 WHEN 'view' THEN 20 ELSE 70 END AS INT) AS priority,
       CAST(event_id % 12 AS INT) AS region_id,
       CAST(NULL AS VARCHAR(10)) AS semantic,
       CAST(event_id % 5 AS INT) AS character_id,
       least(1.0, value / 490.02) AS confidence
FROM {events}""",
    "edit_log": """
SELECT CAST(user_id AS INT) AS page_id, event_id AS seq,
       CASE event_type WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'edit' END AS kind,
       CAST((event_id * 11) % 6 AS INT) AS payload,
       CASE WHEN event_type = 'error' THEN 'erase' ELSE 'add' END AS sel_kind,
       CAST((event_id * 31) % 64 AS INT) AS cell
FROM {events}""",
    "truth": """
SELECT vec_id AS item_id,
       CAST(CASE WHEN vec_id % 37 = 0 THEN 255 ELSE label END AS INT) AS truth,
       CAST(CASE WHEN vec_id % 9 = 0 THEN (label + 1) % 10 ELSE label END AS INT) AS pred
FROM {embeddings}""",
    # Four sources by ten classes per item.
    "votes": """
SELECT item_id, source, class_id,
       CAST((item_id * 31 + source * 17 + class_id * 53) % 101 AS DOUBLE) / 100 AS prob
FROM (SELECT item_id, CAST(si AS INT) AS source, CAST(ci AS INT) AS class_id
      FROM (SELECT item_id, si, @series(0, 9) AS ci
            FROM (SELECT vec_id AS item_id, @series(0, 3) AS si FROM {embeddings}) s) c) n""",
    "panels": """
SELECT page_id, idx,
       CAST((page_id * 13 + idx * 331) % 700 AS INT) AS x,
       CAST(floor(idx / 2) * 400 + (page_id * 7 + idx * 29) % 180 AS INT) AS y,
       CAST(200 + (idx * 37) % 120 AS INT) AS width,
       CAST(260 + (page_id * 11 + idx * 17) % 100 AS INT) AS height
FROM (SELECT page_id, CAST(i AS INT) AS idx
      FROM (SELECT CAST(s_suppkey AS INT) AS page_id, @series(0, 5) AS i FROM {supplier}) q) p""",
    # Per-region identity assignments of a page.
    "assignments": """
SELECT page_id, region_id, CAST((page_id + region_id) % 8 AS INT) AS char_id, label AS attribute,
       CAST((page_id * 17 + region_id * 29) % 256 AS INT) AS t_r,
       CAST((page_id * 31 + region_id * 7) % 256 AS INT) AS t_g,
       CAST((page_id * 11 + region_id * 43) % 256 AS INT) AS t_b,
       CAST((region_id * 7 + page_id) % 100 AS DOUBLE) / 100 AS match_score,
       CAST((region_id * 3 + page_id) % 20 AS DOUBLE) / 100 AS margin,
       conf AS semantic_confidence,
       ((region_id + page_id) % 4 <> 0) AS lock_allowed,
       (region_id % 19 = 0) AS forced,
       CASE WHEN label = 'clothing' THEN CASE WHEN region_id % 2 = 0 THEN 'upper' ELSE 'lower' END END AS part
FROM {regions} WHERE label <> 'sky'""",
}

_DEPS = {name: re.findall(r"\{(\w+)\}", text) for name, text in VIEWS.items()}


def _spark_text(text: str) -> str:
    text = (text.replace("@list(", "array(").replace("@at(", "element_at(")
            .replace("AS VARCHAR(10)", "AS STRING"))
    return re.sub(r"@series\((\d+), (\d+)\)", r"explode(sequence(\1, \2))", text)


def _duck_text(text: str) -> str:
    text = text.replace("@list(", "list_value(").replace("@at(", "list_extract(")
    return re.sub(r"@series\((\d+), (\d+)\)", r"unnest(generate_series(\1, \2))", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view or a given table, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    inputs = {d: view(spark, sf_dir, d) for d in _DEPS[name]}
    return spark.sql(_spark_text(VIEWS[name]), **inputs)


def _ordered(names) -> list[str]:
    done: list[str] = []

    def visit(n):
        if n in VIEWS and n not in done:
            for d in _DEPS[n]:
                visit(d)
            done.append(n)
    for n in names:
        visit(n)
    return done


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the views it names."""
    sql = sql.strip()
    words = set(re.findall(r"\b[a-z_0-9]+\b", sql))
    names = _ordered([n for n in VIEWS if n in words])
    ctes = ",\n".join(f"{n} AS ({_duck_text(VIEWS[n]).strip().format(**{d: d for d in _DEPS[n]})})" for n in names)
    if not ctes:
        return sql
    head = re.match(r"WITH(\s+RECURSIVE)?\s+", sql)
    if head:
        return f"WITH{head.group(1) or ''} {ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"
