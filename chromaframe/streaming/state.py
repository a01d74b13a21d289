"""Ordered state operators. Each is one update rule, run over sorted batches or as a stream.

The rules are sequential by definition: a key's rows are folded in ``seq`` order, with
the key's state (not its rows) in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions.vectors import FEATURE_WEIGHTS, LOG_TERMS, TONE_SCALE
from chromaframe.operators.stats import robust_median
from chromaframe.streaming import colors as K
from chromaframe.streaming.fold import keyed_fold


@dataclass(frozen=True)
class Rule:
    """keys, order inside a key, columns read, event schema, initial state, update."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    columns: tuple[str, ...]
    schema: str
    init: Callable[[], dict]
    step: Callable[[dict, object], list[tuple]]


def run_batch(rule: Rule, df: DataFrame) -> DataFrame:
    return keyed_fold(df.select(*rule.columns), rule.keys, rule.order, rule.init, rule.step, rule.schema)


# --- tone memory -------------------------------------------------------------

# Fallback colours of unseeded slots.
FALLBACK_COLORS = ("#2c2c2c", "#f6c945", "#5b8fd6", "#e8746b", "#7fbf6a", "#c07fd6", "#e89b4a", "#4ac0c0", "#d6567f", "#8a6a48")


def tone_memory_rule(max_slots: int = 8, tolerance: float = 28.0, seeds: dict | None = None) -> Rule:
    """Slots per (book, label): nearest free slot of the page, else a new one, else the closest.

    Rows of a page come darkest first; a slot serves a page once unless the bank is full.
    ``seeds`` maps label to [(tone, color)] of locked slots.
    """
    def step(state, row):
        if not state["ready"]:
            state["slots"] = [[t, c, 1, True] for t, c in (seeds or {}).get(row.label, [])[:max_slots]]
            state["ready"] = True
        if state["page"] != row.seq:
            state["page"], state["used"] = int(row.seq), []
        slots, tone = state["slots"], float(row.mean_gray)
        free = [(abs(s[0] - tone), i) for i, s in enumerate(slots) if i not in state["used"]]
        free = [f for f in free if f[0] < tolerance]
        if free:
            i = min(free)[1]
            state["used"].append(i)
            if not slots[i][3]:
                slots[i][0] = (slots[i][0] * slots[i][2] + tone) / (slots[i][2] + 1)
                slots[i][2] += 1
        elif len(slots) < max_slots:
            i = len(slots)
            slots.append([tone, FALLBACK_COLORS[i % len(FALLBACK_COLORS)], 1, False])
            state["used"].append(i)
        else:
            i = min(range(len(slots)), key=lambda j: (abs(slots[j][0] - tone), j))
        return [(int(row.book_id), row.label, int(row.seq), int(row.region_id), i, slots[i][1])]
    cols = ("book_id", "label", "seq", "region_id", "mean_gray")
    return Rule(("book_id", "label"), ("seq", "mean_gray", "region_id"), cols,
                "book_id int, label string, seq long, region_id int, slot int, color string",
                lambda: {"slots": [], "page": None, "used": [], "ready": False}, step)


def seed_slots(px: DataFrame, regions: DataFrame, label: str, n: int = 8) -> list[tuple[float, str]]:
    """Locked slots from a colour reference: brightest region medians of a label, at most ``n``."""
    mid = robust_median(px, ["page_id", "region_id"], F.lit(True))
    d = mid.join(regions.where((F.col("label") == label) & (F.col("conf") >= 0.25)).select("page_id", "region_id"), ["page_id", "region_id"])
    lum = F.col("med_b") * 0.114 + F.col("med_g") * 0.587 + F.col("med_r") * 0.299
    rows = d.select(lum.alias("tone"), C.rgb_to_hex("med_r", "med_g", "med_b").alias("color"), "page_id", "region_id") \
        .orderBy(F.desc("tone"), "page_id", "region_id").limit(n).collect()
    return [(r["tone"], r["color"]) for r in rows]


# --- profiles ----------------------------------------------------------------

def _bank(profiles: list[dict], field: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A field of all profiles as rows, and which of them have it in this size."""
    has = np.array([size > 0 and len(p[field]) == size for p in profiles])
    rows = np.zeros((len(profiles), size))
    if has.any():
        rows[has] = [p[field] for p, h in zip(profiles, has) if h]
    return rows, has


def feature_gaps(profiles: list[dict], new: dict) -> np.ndarray:
    """Distance of a candidate to every profile of its book at once; the weights are those of ``feature_distance``."""
    column = lambda k: np.array([p[k] for p in profiles], float)
    terms = {"tone": np.minimum(1.0, np.abs(column("tone") - new["tone"]) / TONE_SCALE)}
    for k, (floor, scale) in LOG_TERMS.items():
        terms[k] = np.minimum(1.0, np.abs(np.log(max(new[k], floor) / np.maximum(column(k), floor))) / scale)
    rows, has = _bank(profiles, "hist", len(new["hist"]))
    overlap = np.sqrt(rows * np.array(new["hist"], float)).sum(axis=1)
    terms["hist"] = np.where(has, np.sqrt(np.maximum(0.0, 1.0 - overlap)), 0.5)
    for k in ("embedding", "lineart"):
        rows, has = _bank(profiles, k, len(new[k]))
        mine = np.array(new[k], float)
        scale = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((mine * mine).sum())
        sound = has & (scale > 1e-8)
        terms[k] = np.where(sound, np.clip(1.0 - rows @ mine / np.where(sound, scale, 1.0), 0.0, 2.0) / 2.0, np.nan)
    out = np.full(len(profiles), np.nan)
    for known, weights in FEATURE_WEIGHTS.items():
        mix = sum(terms[k] * w for k, w in weights.items())
        out = np.where(np.isnan(out) & ~np.isnan(mix), mix, out)
    return out


def _mean(old: float, new: float, w: float) -> float:
    return old * (1.0 - w) + new * w


def _mixed(old: list, new: list, w: float, size) -> list:
    """Weighted mean of two lists, scaled by ``size``; an empty side gives way, unlike lengths keep the old one."""
    if not old or not new:
        return list(old or new)
    if len(old) != len(new):
        return list(old)
    v = np.array(old, float) * (1.0 - w) + np.array(new, float) * w
    s = size(v)
    return (v / s if s > 1e-8 else v).tolist()


#: How each measured field of a profile takes in another sample.
FIELD_RULES = {"tone": _mean, "aspect": _mean, "area_frac": _mean,
               "embedding": lambda a, b, w: _mixed(a, b, w, np.linalg.norm), "lineart": lambda a, b, w: _mixed(a, b, w, np.linalg.norm)}
# What a sample adds to its weight in a colour, and the most it may have there, for found and for manual ones.
COLOR_LIFT = {False: (0.15, 0.40), True: (0.12, 0.38)}


def _take_in(profile: dict, new: dict) -> None:
    w = 1.0 / (max(1, profile["samples"]) + 1.0)
    profile |= {field: rule(profile[field], new[field], w) for field, rule in FIELD_RULES.items()}
    # Only a manual sample may bring a histogram that the profile lacks or has in another size.
    if profile["hist"] and len(profile["hist"]) == len(new["hist"]):
        profile["hist"] = _mixed(profile["hist"], new["hist"], w, np.sum)
    elif new["manual"] and new["hist"]:
        profile["hist"] = list(new["hist"])
    lift, most = COLOR_LIFT[new["manual"]]
    for attr, color in new["colors"].items():
        old = profile["colors"].get(attr)
        profile["colors"][attr] = K.blend(old, color, min(most, w + lift)) if old else color
        profile["slots"][attr] = K.merge_slots(profile["slots"].get(attr), [color])
    profile["samples"] += 1


def profile_upsert_rule(max_profiles: int = 24, merge_at: float = 0.18) -> Rule:
    """Merge a candidate into the nearest agreeing profile of its book, else add it.

    A manual candidate merges only into a profile of the same case-folded name.
    """
    as_list = lambda v: [] if v is None else [float(e) for e in v]

    def step(state, row):
        new = {"tone": float(row.tone), "aspect": float(row.aspect), "area_frac": float(row.area_frac), "hist": as_list(row.hist),
               "embedding": as_list(row.embedding), "lineart": as_list(row.lineart), "manual": bool(row.manual),
               "name": (row.name or "").strip(), "colors": {k: v for k, v in (("hair", row.hair), ("eyes", row.eyes)) if v},
               "slots": {}, "samples": 1}
        all_ = state["profiles"]
        target = None
        if new["manual"]:
            if new["name"]:
                target = next((p for p in all_ if p["name"].casefold() == new["name"].casefold()), None)
        elif all_:
            gaps = feature_gaps(all_, new)
            i = int(gaps.argmin())
            if gaps[i] <= merge_at:
                ds = [d for k in ("hair", "eyes", "skin")
                      if (d := K.distance(new["colors"].get(k), all_[i]["colors"].get(k))) is not None]
                hair = K.distance(new["colors"].get("hair"), all_[i]["colors"].get("hair"))
                if (hair is None or hair <= 18.0) and (not ds or sum(ds) / len(ds) <= 26.0):
                    target = all_[i]
        if target is not None:
            _take_in(target, new)
            action, p = "merged", target
        elif len(all_) >= max_profiles:
            return [(int(row.book_id), int(row.seq), "refused", -1, 0, None, state["revision"])]
        else:
            new["id"] = max((p["id"] for p in all_), default=-1) + 1
            new["slots"] = {k: K.clean_slots([v]) for k, v in new["colors"].items()}
            all_.append(new)
            action, p = "added", new
        if new["manual"]:
            p["manual"] = True
        state["revision"] += 1
        return [(int(row.book_id), int(row.seq), action, p["id"], p["samples"], p["colors"].get("hair"), state["revision"])]
    cols = ("book_id", "seq", "tone", "aspect", "area_frac", "hist", "embedding", "lineart", "manual", "name", "hair", "eyes")
    return Rule(("book_id",), ("seq",), cols,
                "book_id int, seq long, action string, char_id int, samples int, hair string, revision int",
                lambda: {"profiles": [], "revision": 0}, step)


# --- colour learning ---------------------------------------------------------

def learnable(observations: DataFrame) -> DataFrame:
    """The stateless gates of learning: score, confidence, margin, pixels, chroma.

    Columns in: attribute, lock_allowed, forced, match_score, semantic_confidence, margin,
    n (pixels), med_r, med_g, med_b. Adds ``color``.
    """
    attr, score, sem, margin = (F.col(c) for c in ("attribute", "match_score", "semantic_confidence", "margin"))
    gate = (F.when(attr == "eyes", (score >= 0.48) & (sem >= 0.18))
            .when(attr == "clothing", (score >= 0.44) & (sem >= 0.16) & (margin >= 0.015))
            .otherwise((score >= 0.55) & (sem >= 0.22) & (margin >= 0.02)))
    d = observations.where(F.col("forced") | (F.col("lock_allowed") & gate))
    d = d.where(F.col("n") >= F.when(F.col("attribute") == "eyes", 4).otherwise(14))
    d = d.withColumns({f"__{c}": F.col(f"med_{c}").cast("int") for c in "rgb"})
    d = C.with_lab(d, ("__r", "__g", "__b"), ("__l", "__a", "__bb"))
    floor = F.when(F.col("attribute") == "skin", 4.0).when(F.col("attribute") == "clothing", 6.0).otherwise(7.0)
    return (d.where(C.chroma("__a", "__bb") >= floor).withColumn("color", C.rgb_to_hex("__r", "__g", "__b"))
            .drop("__r", "__g", "__b", "__l", "__a", "__bb"))


def learn_identity_rule(strength: float = 1.0) -> Rule:
    """Blend the primary colour and update the slots of one (book, character, attribute)."""
    s = max(0.0, min(1.0, strength))

    def step(state, row):
        if s <= 0.02:
            return []
        if not state["ready"]:
            state["primary"] = row.start_color
            state["slots"] = K.clean_slots([row.start_color] if row.start_color else [])
            state["ready"] = True
        before = (state["primary"], list(state["slots"]))
        slots = K.merge_slots(state["slots"], [row.color])
        if row.attribute == "clothing" and row.preferred_slot is not None and row.preferred_slot == row.preferred_slot and slots:
            state["primary"] = slots[min(max(int(row.preferred_slot), 0), len(slots) - 1)]
        else:
            base = state["primary"] or (slots[0] if slots else row.color)
            state["primary"] = K.blend(base, row.color, min(0.16 + 0.24 * s, 0.36))
        state["slots"] = slots
        changed = before != (state["primary"], slots)
        state["revision"] += int(changed)
        return [(int(row.book_id), int(row.char_id), row.attribute, int(row.seq), state["primary"], ",".join(slots), changed, state["revision"])]
    cols = ("book_id", "char_id", "attribute", "seq", "color", "start_color", "preferred_slot")
    return Rule(("book_id", "char_id", "attribute"), ("seq",), cols,
                "book_id int, char_id int, attribute string, seq long, primary_color string, slots string, changed boolean, revision int",
                lambda: {"ready": False, "primary": None, "slots": [], "revision": 0}, step)


# --- points ------------------------------------------------------------------

def dedupe_points_rule(window: int = 16, max_samples: int = 8) -> Rule:
    """Merge a point into one of the last 16 alike and near; else append and thin its colour to 8.

    Live points are kept in order under their sequence numbers, and listed by region and colour,
    so a row looks at the last ``window`` points and at one list of at most ``max_samples`` + 1.
    """
    def step(state, row):
        points, alike = state["points"], state["alike"]
        x, y = (max(0.0, min(1.0, float(v))) for v in (row.x_norm, row.y_norm))
        rad = max(0.001, float(row.radius_norm))
        region = "" if row.region_id is None or row.region_id != row.region_id else int(row.region_id)
        kind = f"{region}|{int(row.r)},{int(row.g)},{int(row.b)}"
        reach = max(0.003, rad * 0.65)
        for name in islice(reversed(points), window):
            p = points[name]
            if (p["kind"], p["source"]) == (kind, row.source) and (p["x"] - x) ** 2 + (p["y"] - y) ** 2 <= reach * reach:
                p |= {"x": (p["x"] + x) * 0.5, "y": (p["y"] + y) * 0.5, "rad": max(p["rad"], rad)}
                return [(int(row.page_id), int(row.seq), "merged", int(name), p["x"], p["y"], p["rad"], len(points))]
        me = str(int(row.seq))
        points[me] = {"kind": kind, "source": row.source, "x": x, "y": y, "rad": rad}
        names = alike.setdefault(kind, [])
        names.append(me)
        if len(names) > max_samples:
            pace = (len(names) - 1) / (max_samples - 1)
            stay = {*(names[int(i * pace)] for i in range(max_samples - 1)), me}
            for gone in [n for n in names if n not in stay]:
                del points[gone]
            alike[kind] = [n for n in names if n in stay]
        return [(int(row.page_id), int(row.seq), "added", int(row.seq), x, y, rad, len(points))]
    cols = ("page_id", "seq", "x_norm", "y_norm", "r", "g", "b", "radius_norm", "source", "region_id")
    return Rule(("page_id",), ("seq",), cols,
                "page_id int, seq long, action string, point_seq long, x_norm double, y_norm double, radius_norm double, live int",
                lambda: {"points": {}, "alike": {}}, step)


# --- undo --------------------------------------------------------------------

def undo_redo_rule(depth: int = 20) -> Rule:
    """Two stacks per page: equal snapshots are not pushed, an edit clears redo, undo skips equal states."""
    def push(stack, value):
        stack.append(value)
        if len(stack) > depth:
            stack.pop(0)

    def move(state, source, target):
        while state[source]:
            candidate = state[source].pop()
            if candidate != state["now"]:
                push(state[target], state["now"])
                state["now"] = candidate
                return True
        return False

    def step(state, row):
        if row.kind == "edit":
            if not state["undo"] or state["undo"][-1] != state["now"]:
                push(state["undo"], state["now"])
            state["redo"] = []
            state["now"], done = int(row.payload), True
        else:
            done = move(state, "undo", "redo") if row.kind == "undo" else move(state, "redo", "undo")
        return [(int(row.page_id), int(row.seq), row.kind, done, state["now"], len(state["undo"]), len(state["redo"]))]
    return Rule(("page_id",), ("seq",), ("page_id", "seq", "kind", "payload"),
                "page_id int, seq long, kind string, applied boolean, payload int, undo_depth int, redo_depth int",
                lambda: {"now": -1, "undo": [], "redo": []}, step)


# --- page status -------------------------------------------------------------

def page_status(events: DataFrame) -> DataFrame:
    """Latest status and message per page; works on batches and as a streaming aggregate."""
    latest = F.max_by(F.struct("status", "message", "seq"), "seq").alias("s")
    return events.groupBy("page_id").agg(latest).select("page_id", "s.status", "s.message", "s.seq")


def batch_totals(status: DataFrame) -> DataFrame:
    """Progress counts and the first error of a batch (earliest by seq)."""
    err = F.col("status") == "error"
    return status.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "done").alias("done"),
                      F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(err).alias("errors"),
                      F.min_by(F.when(err, F.col("message")), F.when(err, F.col("seq"))).alias("first_error"))
