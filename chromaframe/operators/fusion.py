"""Gates, votes, overlays and set rules over several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions.color import clip
from chromaframe.scale import measured_broadcast

IGNORE = 255

# Release thresholds.
RELEASE = {"recall": 0.990, "precision": 0.980, "iou": 0.970}
LEAK_MAX = {"glasses": 0.005, "clothes": 0.005, "face_shadow": 0.005, "skin": 0.008}


def release_gate(d: DataFrame, target_class: int, leak_classes: dict[str, int], keys: Sequence[str] = (),
                 thresholds: dict | None = None, leak_max: dict | None = None) -> DataFrame:
    """Recall, precision, IoU and leak shares of one class, with the pass decision.

    ``d`` holds ``pred`` and ``truth``; truth 255 is left out.
    """
    th, lm = thresholds or RELEASE, leak_max or LEAK_MAX
    v = d.where(F.col("truth") != IGNORE)
    p, g = F.col("pred") == target_class, F.col("truth") == target_class
    aggs = [F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn")]
    for n, c in leak_classes.items():
        aggs += [F.count_if(F.col("truth") == c).alias(f"__n_{n}"), F.count_if(p & (F.col("truth") == c)).alias(f"__l_{n}")]
    s = v.groupBy(*keys).agg(*aggs)
    one, tp, fp, fn = F.lit(1), F.col("tp"), F.col("fp"), F.col("fn")
    s = s.withColumns({"recall": tp / F.greatest(one, tp + fn), "precision": tp / F.greatest(one, tp + fp),
                       "iou": tp / F.greatest(one, tp + fp + fn),
                       **{f"leak_{n}": F.when(F.col(f"__n_{n}") > 0, F.col(f"__l_{n}") / F.col(f"__n_{n}")).otherwise(0.0)
                          for n in leak_classes}})
    ready = F.lit(True)
    for k, t in th.items():
        ready = ready & (F.col(k) >= t)
    for n in leak_classes:
        ready = ready & (F.col(f"leak_{n}") <= lm[n])
    return s.withColumn("production_ready", ready).drop(*[f"__{a}_{n}" for n in leak_classes for a in "nl"])


def label_coverage(d: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Count per class (255 counts as ignored), with the labelled total."""
    per = d.groupBy(*keys, F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("items"))
    labelled = F.sum(F.when(F.col("class_id") != IGNORE, F.col("items")).otherwise(0)).alias("labelled")
    ignored = F.sum(F.when(F.col("class_id") == IGNORE, F.col("items")).otherwise(0)).alias("ignored")
    if keys:
        d = per.join(per.groupBy(*keys).agg(labelled, ignored), list(keys))
    else:
        d = per.withColumns({"labelled": per.agg(labelled).scalar(), "ignored": per.agg(ignored).scalar()})
    return d.where(F.col("class_id") != IGNORE)


def tversky_score(probs: DataFrame, truth: DataFrame, special: dict[int, tuple[float, float]], eps: float = 1.0,
                  a: float = 0.5, b: float = 0.5) -> DataFrame:
    """Soft per-class scores and their mean over the classes present.

    ``probs``: item_id, class_id, prob. ``truth``: item_id, truth.
    """
    d = probs.join(truth.where(F.col("truth") != IGNORE), "item_id")
    hot = F.col("truth") == F.col("class_id")
    s = d.groupBy("class_id").agg(
        F.sum(F.when(hot, F.col("prob")).otherwise(0.0)).alias("tp"), F.sum(F.when(~hot, F.col("prob")).otherwise(0.0)).alias("fp"),
        F.sum(F.when(hot, F.lit(1.0) - F.col("prob")).otherwise(0.0)).alias("fn"), F.count_if(hot).alias("present"))
    al, be = F.lit(a), F.lit(b)
    for c, (x, y) in special.items():
        al, be = F.when(F.col("class_id") == c, x).otherwise(al), F.when(F.col("class_id") == c, y).otherwise(be)
    return s.withColumn("score", (F.col("tp") + eps) / (F.col("tp") + al * F.col("fp") + be * F.col("fn") + eps))


def tversky_mean(scores: DataFrame) -> DataFrame:
    return scores.where("present > 0").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("classes"))


def priority_overlay(layers: DataFrame, items: DataFrame, priority: DataFrame, valid: DataFrame | None = None,
                     keys: Sequence[str] = ("item_id",), ignore: int = IGNORE) -> DataFrame:
    """The highest-priority class covering an item; 255 where none does or the item is not valid."""
    keys = list(keys)
    d = layers.join(measured_broadcast(priority), "class_id")
    if valid is not None:
        d = d.join(valid.select(*keys), keys, "left_semi")
    top = d.groupBy(*keys).agg(F.max_by("class_id", "rank").alias("label"))
    return items.select(*keys).join(top, keys, "left").withColumn("label", F.coalesce("label", F.lit(ignore)))


# Vote weights and thresholds.
VOTE = {"gold": 8.0, "negative": 10.0, "min_score": 1.05, "margin": 0.18, "support": 0.42}


def fuse_votes(votes: DataFrame, weights: DataFrame, gold: DataFrame, recall_class: int, negatives: Sequence[int],
               generic: Sequence[int], priority: DataFrame, cfg: dict | None = None,
               n_classes: int | None = None) -> DataFrame:
    """Weighted votes with gold labels, explicit negatives and recall promotion, one row per item.

    ``votes``: item_id, source, class_id, prob. ``weights``: source, weight. ``gold``:
    item_id, class_id. A gold negative class forbids the recall class; gold overlays last.
    With ``n_classes``, classes nobody voted for take part with score 0.
    """
    c = cfg or VOTE
    w = votes.join(measured_broadcast(weights), "source", "left").fillna({"weight": 1.0})
    prob = clip("prob", 0.0, 1.0)
    soft = w.select("item_id", "class_id", (prob * F.col("weight")).alias("s"), prob.alias("p"), F.lit(False).alias("neg"),
                    F.lit(None).cast("int").alias("gold"))
    g = gold.join(measured_broadcast(priority), "class_id", "left")
    is_neg = F.col("class_id").isin(*negatives)
    hard = g.select("item_id", "class_id", (F.lit(c["gold"]) + F.when(is_neg, c["negative"]).otherwise(0.0)).alias("s"),
                    F.lit(1.0).alias("p"), F.lit(False).alias("neg"), F.coalesce("rank", F.lit(0)).cast("int").alias("gold"))
    guard = g.where(is_neg).select("item_id", F.lit(recall_class).alias("class_id"), F.lit(0.0).alias("s"), F.lit(0.0).alias("p"),
                                   F.lit(True).alias("neg"), F.lit(None).cast("int").alias("gold"))
    # Equal (item, class) rows shrink before anything looks at a whole item.
    per = soft.unionByName(hard).unionByName(guard).groupBy("item_id", "class_id").agg(
        F.sum("s").alias("s"), F.max("p").alias("p"), F.max("neg").alias("neg"), F.max("gold").alias("gold"))
    per = per.withColumn("s", F.round(F.when(F.col("neg"), -c["negative"]).otherwise(F.col("s")), 9))
    top = F.max(F.struct("s", "class_id"))
    item = per.groupBy("item_id").agg(
        top.alias("t"), F.array_sort(F.collect_list(F.struct(-F.col("s"), "class_id"))).alias("all"),
        F.max(F.when(F.col("class_id") == recall_class, F.struct("s", "p", "neg"))).alias("r"),
        F.max_by("class_id", "gold").alias("gold_class"), F.max("gold").alias("has_gold"))
    second = -F.get("all", F.lit(1))["col1"]
    silent = F.greatest(F.lit(0), F.lit(n_classes or 0) - F.size("all"))
    second = F.when(silent > 0, F.greatest(F.coalesce(second, F.lit(0.0)), F.lit(0.0))).otherwise(second)
    margin = F.col("t")["s"] - F.coalesce(second, F.lit(0.0))
    sure = (F.col("t")["s"] >= c["min_score"]) & (F.round(margin, 9) >= c["margin"])
    item = item.withColumn("vote", F.when(sure, F.col("t")["class_id"]).otherwise(IGNORE))
    r = F.col("r")
    promote = F.coalesce((r["p"] >= c["support"]) & (r["s"] > 0) & ~r["neg"], F.lit(False)) & F.col("vote").isin(IGNORE, *generic)
    fused = F.when(promote, recall_class).otherwise(F.col("vote"))
    label = F.when(F.col("has_gold").isNotNull(), F.col("gold_class")).otherwise(fused)
    mass = F.aggregate("all", F.lit(0.0), lambda t, v: t + F.exp(F.greatest(F.lit(-20.0), -v["col1"] - F.col("t")["s"])))
    mass = mass + silent * F.exp(F.greatest(F.lit(-20.0), -F.col("t")["s"]))
    return item.select("item_id", label.cast("int").alias("label"), promote.alias("promoted"), F.col("t")["s"].alias("top_score"),
                       margin.alias("margin"), (F.lit(1.0) / (mass + 1e-8)).alias("top_probability"))


def combine_selection(existing: DataFrame, incoming: DataFrame, mode: str = "replace", page: str = "page_id",
                      cell: Sequence[str] = ("x", "y")) -> DataFrame:
    """replace / add / subtract per page; a page with no incoming cells keeps what it had."""
    cols = [page, *cell]
    old, new = existing.select(*cols).distinct(), incoming.select(*cols).distinct()
    touched = new.select(page).distinct()
    if mode == "add":
        return old.union(new).distinct()
    if mode == "subtract":
        return old.join(new, cols, "left_anti")
    return new.union(old.join(touched, page, "left_anti"))


def replay_selection(log: DataFrame, keys: Sequence[str] = ("page_id", "cell")) -> DataFrame:
    """Selected cells after a log of add / erase steps, and the two sets kept apart.

    The last step on a cell decides, so the ordered replay is one hash aggregate.
    """
    return log.groupBy(*keys).agg((F.max_by("sel_kind", "seq") == "add").alias("selected"),
                                  F.max(F.col("sel_kind") == "add").alias("positive"),
                                  F.max(F.col("sel_kind") == "erase").alias("negative"))


# Labels that count as background.
BACKGROUND_LABELS = ("background", "sky", "foliage", "stone", "wood", "water")


def evidence_anchors() -> tuple[Column, Column]:
    """High-precision hair and eye anchors."""
    lab, conf, border = F.col("clip_label"), F.col("clip_conf"), F.col("touches_border")
    hair = (F.col("sem_hair") >= 0.50) | ((lab == "hair") & (((conf >= 0.58) & (F.col("sem_fg") >= 0.10)) | ((conf >= 0.74) & ~border)))
    eyes = (F.col("sem_eye") >= 0.48) | ((lab == "eyes") & (conf >= 0.72) & ~border)
    return hair, eyes


def fuse_region_evidence(regions: DataFrame) -> DataFrame:
    """Hair, eye and background scores and the accepted sets, per region.

    Columns in: sem_hair, sem_eye, sem_fg, sem_bg, clip_label, clip_conf, sim_hair,
    sim_eye, touches_border, area_ratio. A page with no accepted region of a kind falls
    back to its prior (``use_prior_*``).
    """
    col = F.col
    lab_conf = lambda *names: F.when(col("clip_label").isin(*names), col("clip_conf")).otherwise(0.0)
    hair_c, eye_c, bg_c = lab_conf("hair"), lab_conf("eyes"), lab_conf(*BACKGROUND_LABELS)
    gen_hair = F.greatest(F.lit(0.0), (col("sim_hair") - 0.76) / 0.24) * F.when(col("sem_fg") >= 0.16, 0.82).otherwise(0.18)
    gen_eye = F.greatest(F.lit(0.0), (col("sim_eye") - 0.80) / 0.20)
    border = col("touches_border")
    d = regions.withColumns({
        "hair_score": clip(col("sem_hair") * 0.56 + hair_c * 0.20 + gen_hair, 0.0, 1.0),
        "eye_score": clip(col("sem_eye") * 0.72 + eye_c * 0.18 + gen_eye * 0.10, 0.0, 1.0),
        "background_score": clip(F.greatest(col("sem_bg") * 0.68 + bg_c * 0.22, F.when(border, 0.72).otherwise(0.0))
                                 - F.greatest("sem_hair", "sem_eye", "sem_fg") * 0.52, 0.0, 1.0)})
    anchor, _ = evidence_anchors()
    page = d.groupBy("page_id").agg(F.max(F.coalesce(anchor, F.lit(False))).alias("__anchored"))
    d = d.join(page, "page_id")
    grouped = (col("__anchored") & (col("sim_hair") >= 0.79) & (col("sem_fg") >= 0.50) & (col("sem_eye") < 0.16)
               & ~F.coalesce(col("clip_label").isin("skin", "eyes", "bubble"), F.lit(False)))
    direct = (hair_c >= 0.74) & ~border
    hair = (((col("hair_score") >= 0.46) | grouped | direct) & (col("area_ratio") <= 0.20) & (~border | (col("sem_hair") >= 0.72)))
    reason = (F.when(direct & (col("hair_score") < 0.46) & ~grouped, "hair_clip")
              .when(grouped & (col("hair_score") < 0.46), "hair_grouped").otherwise("hair"))
    eye = ((col("eye_score") >= 0.48) | ((eye_c >= 0.72) & ~border)) & (col("area_ratio") <= 0.04) & ~border
    bg = (((col("background_score") >= 0.58) | ((bg_c >= 0.78) & (col("sem_hair") < 0.15) & (col("sem_eye") < 0.15)))
          & (col("sem_hair") < 0.22) & (col("sem_eye") < 0.20))
    d = d.withColumn("accepted", F.filter(F.array(F.when(hair, reason), F.when(eye, F.lit("eye")), F.when(bg, F.lit("background"))),
                                          lambda v: v.isNotNull()))
    has = lambda k: F.exists("accepted", lambda v: v.startswith(k))
    sums = d.groupBy("page_id").agg(*[(F.count_if(has(k)) == 0).alias(f"use_prior_{k}") for k in ("hair", "eye", "background")])
    return d.drop("__anchored").join(sums, "page_id")


def choose_partitioning(fast: DataFrame, robust: DataFrame, priors: Sequence[str], max_share: float = 0.34) -> DataFrame:
    """Per page, the fast label map or, when it looks leaky, the robust one (if it has two regions).

    Leaky: at most one region, or a prior with more than 4 % of its pixels (and at least 8)
    in a region that touches the border or exceeds 34 % of the page.
    """
    page = fast.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("region_id") > 0, F.col("region_id"))).alias("k"),
                                       *[F.count_if(F.col(p) > 0).alias(f"t_{p}") for p in priors],
                                       F.max("x").alias("x1"), F.max("y").alias("y1"))
    r = fast.where("region_id > 0").groupBy("page_id", "region_id").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("rx0"), F.max("x").alias("rx1"), F.min("y").alias("ry0"),
        F.max("y").alias("ry1"), *[F.count_if(F.col(p) > 0).alias(f"o_{p}") for p in priors]).join(page, "page_id")
    open_ = ((F.col("area") > F.col("n") * max_share) | (F.col("rx0") == 0) | (F.col("ry0") == 0)
             | (F.col("rx1") == F.col("x1")) | (F.col("ry1") == F.col("y1")))
    hit = F.lit(False)
    for p in priors:
        hit = hit | ((F.col(f"o_{p}") >= 8) & (F.col(f"o_{p}") / F.greatest(F.lit(1), F.col(f"t_{p}")) > 0.04))
    leaky = r.where(open_ & hit).select("page_id").union(page.where("k <= 1").select("page_id")).distinct()
    able = robust.where("region_id > 0").groupBy("page_id").agg(F.countDistinct("region_id").alias("k")).where("k >= 2")
    swap = leaky.join(able.select("page_id"), "page_id", "left_semi")
    cols = ["page_id", "x", "y", "region_id"]
    return (fast.join(swap, "page_id", "left_anti").select(*cols, F.lit("fast").alias("backend"))
            .unionByName(robust.join(swap, "page_id", "left_semi").select(*cols, F.lit("robust").alias("backend"))))
