"""Distances over arrays, and the weighted feature distance of identity matching."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from chromaframe.functions.color import _c, let


def _fold(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return _fold(F.zip_with(_c(a), _c(b), lambda p, q: p.cast("double") * q.cast("double")))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _comparable(a, b) -> Column:
    a, b = _c(a), _c(b)
    return a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))


def hellinger(a, b) -> Column:
    """sqrt(1 - sum sqrt(ab)); 0.5 when the histograms cannot be compared."""
    overlap = _fold(F.zip_with(_c(a), _c(b), lambda p, q: F.sqrt(p.cast("double") * q.cast("double"))))
    return F.when(_comparable(a, b), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - overlap))).otherwise(0.5)


def cosine_half(a, b, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """(1 - cos) / 2 in 0..1, null when either vector is missing or zero."""
    scale = (norm_a if norm_a is not None else norm(a)) * (norm_b if norm_b is not None else norm(b))
    half = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.lit(1.0) - dot(a, b) / scale)) / 2.0
    return F.when(_comparable(a, b), F.when(scale > 1e-8, half))


def blend_unit(a, b, weight_b) -> Column:
    """Weighted mean of two vectors, scaled to length 1; keeps ``a`` when they differ in size."""
    a, b, w = _c(a), _c(b), _c(weight_b)
    mixed = F.zip_with(a, b, lambda p, q: p.cast("double") * (F.lit(1.0) - w) + q.cast("double") * w)
    size = norm(mixed)
    unit = F.when(size > 1e-8, F.transform(mixed, lambda v: v / size)).otherwise(mixed)
    as_double = lambda v: F.transform(v, lambda e: e.cast("double"))
    missing_a = a.isNull() | (F.size(a) == 0)
    return F.when(missing_a, as_double(b)).when(_comparable(a, b), unit).otherwise(as_double(a))


def log_ratio(p, q, floor: float, scale: float) -> Column:
    one = F.lit(1.0)
    ratio = F.greatest(_c(p), F.lit(floor)) / F.greatest(_c(q), F.lit(floor))
    return F.least(one, F.abs(F.log(ratio)) / scale)


# Weights of the distance terms, by the cosine terms that both sides have.
FEATURE_WEIGHTS = {
    ("embedding", "lineart"): {"embedding": 0.42, "lineart": 0.28, "tone": 0.10, "hist": 0.10, "aspect": 0.06, "area_frac": 0.04},
    ("embedding",): {"embedding": 0.56, "tone": 0.14, "hist": 0.15, "aspect": 0.10, "area_frac": 0.05},
    ("lineart",): {"lineart": 0.55, "tone": 0.16, "hist": 0.16, "aspect": 0.08, "area_frac": 0.05},
    (): {"tone": 0.30, "hist": 0.35, "aspect": 0.22, "area_frac": 0.13},
}
# Tone difference of distance 1; floor and scale of the logarithmic terms.
TONE_SCALE = 100.0
LOG_TERMS = {"aspect": (1e-3, 1.7), "area_frac": (1e-6, 3.2)}


def feature_distance(query, profile) -> Column:
    """Mix of tone, histogram, shape and up to two cosine terms, by ``FEATURE_WEIGHTS``.

    ``query`` and ``profile`` map the names tone, hist, aspect, area_frac, embedding,
    lineart (and optionally embedding_norm, lineart_norm) to columns.
    """
    q, p = query, profile
    terms = {"tone": F.least(F.lit(1.0), F.abs(p["tone"] - q["tone"]) / TONE_SCALE), "hist": hellinger(p["hist"], q["hist"])}
    terms |= {k: log_ratio(q[k], p[k], floor, scale) for k, (floor, scale) in LOG_TERMS.items()}
    terms |= {k: cosine_half(p[k], q[k], p.get(f"{k}_norm"), q.get(f"{k}_norm")) for k in ("embedding", "lineart")}

    def mix(v):
        out = F.lit(None).cast("double")
        for known, weights in reversed(FEATURE_WEIGHTS.items()):
            total = reduce(add, [v[k] * w for k, w in weights.items()])
            cond = reduce(and_, [v[k].isNotNull() for k in known], F.lit(True))
            out = F.when(cond, total).otherwise(out)
        return out
    return let(F.struct(*[c.alias(k) for k, c in terms.items()]), mix)
