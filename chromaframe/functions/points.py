"""Hint point expressions: per-source defaults, effective strength, crop coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions.color import _c, clip

# Priority and default strength of each hint source.
SOURCE_PRIORITY = {"style_only": 0, "scene_palette": 20, "auto_instance": 40, "character_identity": 70,
                   "manual": 100, "manual_region": 100, "eyedropper_hint": 100}
SOURCE_STRENGTH = {"style_only": 0.12, "scene_palette": 0.28, "auto_instance": 0.32,
                   "character_identity": 0.58, "manual": 0.72, "manual_region": 1.00, "eyedropper_hint": 0.88}
MANUAL_SOURCES = ("manual", "manual_region", "eyedropper_hint")


def _lookup(table: dict, key, default) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(key)), F.lit(default))


def source_priority(source) -> Column:
    return _lookup(SOURCE_PRIORITY, source, 0)


def source_strength(source) -> Column:
    return _lookup(SOURCE_STRENGTH, source, 1.0)


def effective_strength(strength="strength", confidence="confidence") -> Column:
    return clip(_c(strength) * _c(confidence), 0.0, 1.0)


def remap_to_crop(hints: DataFrame, crop, page_w, page_h, canvas_w=None, canvas_h=None) -> DataFrame:
    """Keep points inside the half-open crop and express them in canvas coordinates."""
    cx, cy, cw, ch = (_c(v) for v in crop)
    kw, kh = _c(canvas_w) if canvas_w is not None else cw, _c(canvas_h) if canvas_h is not None else ch
    px, py = F.col("x_norm") * _c(page_w), F.col("y_norm") * _c(page_h)
    inside = (cw > 0) & (ch > 0) & (px >= cx) & (px < cx + cw) & (py >= cy) & (py < cy + ch)
    return hints.where(inside).withColumns({
        "x_norm": (px - cx) / kw, "y_norm": (py - cy) / kh,
        "radius_norm": F.col("radius_norm") * _c(page_w) / F.greatest(F.lit(1), kw)})
