"""Exact duplicates among saved project documents, by sorting their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaframe.llm.base import ascii_lower, shuffle_width, text_of
from chromaframe.scale import cut_lineage

PREFIX = 16


def exact_groups(projects: DataFrame, project_id: str = "project_id", body: str = "body", keep: str = "first",
                 salts: int = 64) -> DataFrame:
    """One row per project document: the group of equal bodies it is in and which row stays.

    Returns ``project_id``, ``keep_id``, ``group_size``, ``kept``, ``body_sha256``.
    Bodies are equal when identical after lower-casing A-Z; null counts as empty. The
    smallest identifier stays (``keep="last"``: the largest). Rows that repeat an
    identifier and a body belong to the group and only one of them is kept; a null
    identifier sorts below all others. An empty table gives no rows. Other columns are ignored.

    Method: the normalised bytes are dealt by sampled splitters (first bytes, then a hash
    that splits texts with one beginning), so a splitter is a few dozen bytes whatever the
    text. Each range is sorted on disk where needed; equal bodies become neighbours, and
    the window compares neighbours in full. A body with more copies than an even share of
    a range is first spread over ``salts`` runs, each decided on its own; the runs' winners
    (at most ``salts`` rows per such body) then meet by digest.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    # Bodies equal after A-Z have equal full lower cases: good for dealing, cheaper to make.
    rows = projects.select(F.col(project_id).alias("__id"), text_of(body).alias("__text"))
    rows = rows.withColumn("__h", F.xxhash64(F.lower("__text")))
    width = shuffle_width(projects)
    sizes = cut_lineage(rows.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    # Fewer than 8 * width hashes can each hold over 1 / (8 * width) of the repeated rows.
    hot = sizes.where(F.col("__n") > F.lit(max(64, total // (8 * width)))).select("__h", F.lit(True).alias("__hot"))
    rows = rows.join(F.broadcast(hot), "__h", "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    spread = F.when(F.col("__hot"), F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(salts))).otherwise(F.lit(0))
    rows = rows.withColumns({"__salt": spread.cast("int"), "__prefix": F.substring(F.lower("__text"), 1, PREFIX)})
    ranged = rows.repartitionByRange("__prefix", "__h", "__salt").withColumn("__norm", ascii_lower(F.col("__text"))).drop("__text")
    run = W.partitionBy("__prefix", "__h", "__salt", "__norm")
    order = F.col("__id").asc_nulls_first() if keep == "first" else F.col("__id").desc_nulls_last()
    decided = ranged.select(
        "__id", "__hot", F.sha2(F.col("__norm"), 256).alias("__sha"), F.row_number().over(run.orderBy(order)).alias("__pos"),
        F.first("__id").over(run.orderBy(order)).alias("__first"), F.count(F.lit(1)).over(run).alias("__size"))
    decided = cut_lineage(decided)
    heads = decided.where("__hot AND __pos = 1").groupBy("__sha").agg(
        F.first(F.col("__first"), ignorenulls=False).alias("__any"),
        (F.min if keep == "first" else F.max)("__first").alias("__best"), F.bool_or(F.col("__first").isNull()).alias("__null"),
        F.sum("__size").alias("__all"))
    # Nulls are below every identifier: first when the smallest stays, last when the largest does.
    best = F.when(F.col("__null"), F.lit(None)).otherwise(F.col("__best")) if keep == "first" else F.col("__best")
    heads = heads.select("__sha", best.alias("__best"), "__all")
    cold = decided.where("NOT __hot").select("__id", "__sha", "__pos", F.col("__first").alias("__keep"), "__size")
    warm = decided.where("__hot").join(F.broadcast(heads), "__sha").select(
        "__id", "__sha", F.when(F.col("__id").eqNullSafe(F.col("__best")), F.col("__pos")).otherwise(F.lit(0)).alias("__pos"),
        F.col("__best").alias("__keep"), F.col("__all").alias("__size"))
    # A row of a spread body stays if it heads its run and carries the winning identifier;
    # equal identifiers hash to one run, so just one row does.
    return cold.unionByName(warm).select(
        F.col("__id").alias(project_id), F.col("__keep").alias("keep_id"), F.col("__size").cast("long").alias("group_size"),
        (F.col("__pos") == 1).alias("kept"), F.col("__sha").alias("body_sha256"))


def keep_one(projects: DataFrame, project_id: str = "project_id", body: str = "body", keep: str = "first") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat identifier and body, one."""
    stay = exact_groups(projects, project_id, body, keep).where("kept").select(
        F.struct(F.col(project_id).alias("i"), F.col("body_sha256").alias("s")).alias("__stay"))
    own = F.struct(F.col(project_id).alias("i"), F.sha2(ascii_lower(text_of(body)), 256).alias("s"))
    # The join has sorted by the key that the window needs.
    left = projects.withColumn("__stay", own).join(stay, "__stay", "left_semi")
    return (left.withColumn("__nth", F.row_number().over(W.partitionBy("__stay").orderBy("__stay")))
            .where("__nth = 1").drop("__stay", "__nth"))
