"""Short colour lists kept in one array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chromaframe.functions.color import _c, blend_lab, hex_lab_struct, lab_struct_distance, let


def normalize_palette(colors, k: int = 3) -> Column:
    """Trim, lowercase, keep 7-character ``#`` values, first-seen distinct, first ``k``."""
    clean = F.transform(F.coalesce(_c(colors), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
    valid = F.filter(clean, lambda v: (F.length(v) == 7) & v.startswith("#"))
    return F.slice(F.array_distinct(valid), 1, k)


def _replace_at(arr: Column, index: Column, value: Column) -> Column:
    return F.transform(arr, lambda v, i: F.when(i == index, value).otherwise(v))


def merge_palette(slots, candidates, k: int = 3) -> Column:
    """Fold the candidates, in order, into at most ``k`` slots.

    A near colour (distance <= 12) is blended in at 0.35; otherwise it is appended
    while there is room; otherwise it is blended at 0.45 into the nearest slot when it
    lies closer to that slot than the slot lies to the first one.
    """
    def known(v):
        return F.struct(v.alias("hex"), hex_lab_struct(v).alias("lab"))

    def nearest(acc, color):
        ranked = F.transform(acc, lambda s, i: F.struct(lab_struct_distance(s["lab"], color["lab"]).alias("d"), i.alias("i")))
        return F.array_min(F.filter(ranked, lambda e: e["d"].isNotNull()))

    def blended(acc, i, color, weight):
        return _replace_at(acc, i, let(blend_lab(F.get(acc, i)["lab"], color["lab"], weight), known))

    def place(acc, color, best):
        d, i = best["d"], best["i"]
        to_first = lab_struct_distance(F.get(acc, i)["lab"], F.get(acc, F.lit(0))["lab"])
        to_first = F.coalesce(F.nullif(to_first, F.lit(0.0)), F.lit(999.0))
        return (F.when(d <= 12.0, blended(acc, i, color, 0.35))
                .when(F.size(acc) < k, F.array_append(acc, color))
                .when(d < to_first, blended(acc, i, color, 0.45))
                .otherwise(acc))

    def step(acc, color):
        return F.when(F.exists(acc, lambda s: s["hex"] == color["hex"]), acc).otherwise(
            let(nearest(acc, color), lambda best: place(acc, color, best)))
    # Lab values are computed once per colour and kept beside it.
    merged = F.aggregate(F.transform(normalize_palette(candidates, k), known), F.transform(normalize_palette(slots, k), known), step)
    return normalize_palette(F.transform(merged, lambda v: v["hex"]), k)
