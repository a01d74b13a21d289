"""Rectangle and point expressions. A box is four columns (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chromaframe.functions.color import _c

Box = tuple


def whole(v) -> Column:
    """Truncate toward zero."""
    return _c(v).cast("int")


def bbox_clip(box: Box, page_w, page_h) -> Box:
    """Clip to the page; width and height stay at least 1. Inputs are whole numbers."""
    x, y, w, h = (_c(v) for v in box)
    W, H = _c(page_w), _c(page_h)
    x = F.greatest(F.lit(0), F.least(W - 1, x))
    y = F.greatest(F.lit(0), F.least(H - 1, y))
    return (x, y, F.greatest(F.lit(1), F.least(W - x, w)), F.greatest(F.lit(1), F.least(H - y, h)))


def _overlap_1d(a, al, b, bl) -> Column:
    return F.greatest(F.lit(0), F.least(_c(a) + _c(al), _c(b) + _c(bl)) - F.greatest(_c(a), _c(b)))


def bbox_iou(p: Box, q: Box) -> Column:
    inter = _overlap_1d(p[0], p[2], q[0], q[2]) * _overlap_1d(p[1], p[3], q[1], q[3])
    union = _c(p[2]) * _c(p[3]) + _c(q[2]) * _c(q[3]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def bbox_gap(p: Box, q: Box) -> Column:
    """Euclidean gap, 0 when the boxes touch or overlap."""
    def gap(a, al, b, bl):
        return F.greatest(F.lit(0.0), (F.greatest(_c(a), _c(b))
                                       - F.least(_c(a) + _c(al), _c(b) + _c(bl))).cast("double"))
    dx, dy = gap(p[0], p[2], q[0], q[2]), gap(p[1], p[3], q[1], q[3])
    return F.sqrt(dx * dx + dy * dy)


def bbox_near(p: Box, q: Box, pad_ratio) -> Column:
    """True when p meets q grown by ``pad_ratio`` times q's longer side."""
    pad = F.greatest(_c(q[2]), _c(q[3])) * _c(pad_ratio)
    (px, py, pw, ph), (qx, qy, qw, qh) = [[_c(v) for v in b] for b in (p, q)]
    return ~((px + pw < qx - pad) | (px > qx + qw + pad) | (py + ph < qy - pad) | (py > qy + qh + pad))


def bbox_union(box: Box) -> Box:
    """Aggregates: the smallest box around a group of boxes."""
    x, y, w, h = (_c(v) for v in box)
    x0, y0 = F.min(x), F.min(y)
    return x0, y0, F.greatest(F.lit(1), F.max(x + w) - x0), F.greatest(F.lit(1), F.max(y + h) - y0)


def contains(box: Box, px, py) -> Column:
    x, y, w, h = (_c(v) for v in box)
    return _c(px).between(x, x + w) & _c(py).between(y, y + h)


def _expand(box: Box, left, up, wide, tall, page_w, page_h) -> Box:
    x, y, w, h = (_c(v) for v in box)
    bx, by = whole(x - w * left), whole(y - h * up)
    bw, bh = whole(w * wide), whole(h * tall)
    if page_w is not None:
        bx, by = F.greatest(F.lit(0), bx), F.greatest(F.lit(0), by)
        bw, bh = F.least(_c(page_w) - bx, bw), F.least(_c(page_h) - by, bh)
    return bx, by, F.greatest(F.lit(1), bw), F.greatest(F.lit(1), bh)


def head_box(anchor: Box, page_w=None, page_h=None) -> Box:
    return _expand(anchor, 0.55, 0.45, 2.10, 2.10, page_w, page_h)


def body_box(anchor: Box, page_w=None, page_h=None) -> Box:
    return _expand(anchor, 0.65, 0.20, 2.30, 5.20, page_w, page_h)


def _from_face(face: Box, left, up, wide, tall, page_w, page_h) -> Box:
    x, y, w, h = (_c(v) for v in face)
    return bbox_clip((whole(x - w * left), whole(y - h * up), whole(w * wide), whole(h * tall)), page_w, page_h)


def head_box_from_face(face: Box, page_w, page_h) -> Box:
    return _from_face(face, 0.34, 0.52, 1.68, 1.78, page_w, page_h)


def body_box_from_face(face: Box, page_w, page_h) -> Box:
    return _from_face(face, 1.00, 0.30, 3.00, 5.10, page_w, page_h)


def classify_part(region: Box, frac, body: Box | None) -> Column:
    """upper / lower / accessory from stable geometry; ``body`` may be all null."""
    x, y, w, h = (_c(v) for v in region)
    thin = F.least(w, h) <= 8
    alone = F.when((_c(frac) < 0.006) | thin, "accessory").otherwise("upper")
    if body is None:
        return alone
    bx, by, bw, bh = (_c(v) for v in body)
    one = F.lit(1.0)
    rx = (x + w / 2.0 - bx) / F.greatest(one, bw.cast("double"))
    ry = (y + h / 2.0 - by) / F.greatest(one, bh.cast("double"))
    area = (w * h) / F.greatest(one, (bw * bh).cast("double"))
    aspect = w / F.greatest(one, h.cast("double"))
    odd = (area < 0.035) | thin | (aspect > 4.2) | (aspect < 0.23)
    inner = rx.between(0.12, 0.88) & ry.between(0.08, 0.82)
    return (F.when(bx.isNull(), alone).when(odd & inner, "accessory")
            .when(ry < 0.56, "upper").otherwise("lower"))


def preferred_slot(part, n_slots) -> Column:
    """0-based slot of a clothing part among ``n_slots`` colours."""
    n = F.coalesce(_c(n_slots), F.lit(0))
    return (F.when(n <= 1, 0).when(_c(part) == "lower", 1)
            .when(_c(part) == "accessory", F.when(n >= 3, 2).otherwise(1)).otherwise(0))


def target_color(slots, index, fallback) -> Column:
    """The slot colour at a clamped index, or the fallback when there are no slots."""
    s = _c(slots)
    n = F.coalesce(F.size(s), F.lit(0))
    i = F.greatest(F.lit(0), F.least(n - 1, F.coalesce(_c(index), F.lit(0))))
    return F.when(n > 0, F.get(s, i)).otherwise(_c(fallback))
