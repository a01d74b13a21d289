"""Colour column expressions: codecs, colour spaces, distances, blends, pixel predicates.

8-bit conventions throughout: HSV hue 0..179 with S and V 0..255, Lab as
(L*255/100, a+128, b+128) rounded to whole numbers.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB to XYZ (D65) and back, white point, CIE thresholds.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
TO_RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
WHITE_X, WHITE_Z = 0.950456, 1.088754
LAB_EPS, LAB_KAPPA = 0.008856, 903.3


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else (v if isinstance(v, Column) else F.lit(v))


def clip(v, lo, hi) -> Column:
    """Clamp; null stays null."""
    c = _c(v)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside one expression: ``body`` sees it as a variable.

    Keeps deep formulas linear in size. Stages of ``withColumns`` do the same for
    per-pixel work and stay inside generated code, so use those there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(v) -> Column:
    """Round to the nearest whole number, as a double."""
    return F.floor(_c(v) + 0.5).cast("double")


def round_even(v, digits: int) -> Column:
    """Round to ``digits`` decimals, halves to even, on the binary value itself."""
    return F.rint(_c(v) * float(10 ** digits)) / float(10 ** digits)


# --- codec -------------------------------------------------------------------

HEX_RULE = "^#[0-9a-fA-F]{6}$"


def hex_channel(value, index: int) -> Column:
    v = _c(value)
    part = F.conv(F.substring(v, 2 + 2 * index, 2), 16, 10).cast("int")
    return F.when(v.rlike(HEX_RULE), part)


def hex_to_rgb(value) -> tuple[Column, Column, Column]:
    return tuple(hex_channel(value, i) for i in range(3))


def rgb_to_hex(r, g, b) -> Column:
    """Clamped channels as ``#rrggbb``; null when a channel is null."""
    def two(v):
        return F.lpad(F.lower(F.hex(clip(_c(v).cast("int"), 0, 255))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


# --- grey, HSV, HLS ----------------------------------------------------------

def rgb_to_gray(r, g, b) -> Column:
    return F.floor((_c(r) * 299 + _c(g) * 587 + _c(b) * 114 + 500) / 1000).cast("int")


def luma_fast(r, g, b) -> Column:
    """Whole-number BT.601 luma with weights 77, 150, 29 over 256."""
    return F.shiftright((_c(r) * 77 + _c(g) * 150 + _c(b) * 29 + 128).cast("int"), 8)


def _hue_sextant(r, g, b, hi, span) -> Column:
    """Hue in units of 60 degrees, range -1..5, 0 for greys."""
    r, g, b = _c(r), _c(g), _c(b)
    return (F.when(span == 0, F.lit(0.0))
            .when(hi == r, (g - b) / span)
            .when(hi == g, (b - r) / span + 2.0)
            .otherwise((r - g) / span + 4.0))


def rgb_to_hsv(r, g, b) -> tuple[Column, Column, Column]:
    r, g, b = _c(r), _c(g), _c(b)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = (hi - lo)
    hue = half_up(_hue_sextant(r, g, b, hi, span) * 30.0)
    hue = F.when(hue < 0, hue + 180.0).otherwise(hue)
    sat = F.when(hi == 0, F.lit(0.0)).otherwise(half_up(span * 255.0 / hi))
    return hue.cast("int"), sat.cast("int"), hi.cast("int")


def with_hsv(df: DataFrame, rgb=("r", "g", "b"), out=("hue", "sat", "val")) -> DataFrame:
    """Add 8-bit HSV columns in stages.

    Per-pixel work is best cut into short projections: each becomes a method of its own
    in the generated code, small enough for the JVM to compile.
    """
    r, g, b = (F.col(c) for c in rgb)
    hi, span, sext = F.col("__hi"), F.col("__span"), F.col("__sext")
    df = df.withColumns({"__hi": F.greatest(r, g, b), "__lo": F.least(r, g, b)})
    df = df.withColumn("__span", hi - F.col("__lo"))
    df = df.withColumn("__sext", _hue_sextant(r, g, b, hi, span))
    df = df.withColumn("__sext", half_up(sext * 30.0))
    df = df.withColumns({out[0]: F.when(sext < 0, sext + 180.0).otherwise(sext).cast("int"),
                         out[1]: F.when(hi == 0, F.lit(0.0)).otherwise(half_up(span * 255.0 / hi)).cast("int"), out[2]: hi.cast("int")})
    return df.drop("__hi", "__lo", "__span", "__sext")


def rgb_to_hls(r, g, b) -> tuple[Column, Column, Column]:
    """Hue in degrees 0..360, lightness and saturation 0..1."""
    r, g, b = _c(r), _c(g), _c(b)
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    light = (hi + lo) / 510.0
    hue = F.pmod(_hue_sextant(r, g, b, hi, span) * 60.0 + 360.0, F.lit(360.0))
    sat = (F.when(span == 0, F.lit(0.0))
           .when(light < 0.5, span / (hi + lo).cast("double"))
           .otherwise(span / (510.0 - hi - lo)))
    return hue, light, sat


def with_hsv_rgb(df: DataFrame, hsv=("hue", "sat", "val"), out=("back_r", "back_g", "back_b")) -> DataFrame:
    """Add 8-bit RGB columns from 8-bit HSV ones, in stages."""
    h, s, v = (F.col(c) for c in hsv)
    sec, frac, sat, val = F.col("__sec"), F.col("__frac"), F.col("__sat"), F.col("__val")
    df = df.withColumns({"__h": h / 30.0, "__sat": s / 255.0, "__val": v.cast("double")})
    df = df.withColumn("__sec", F.floor("__h").cast("int"))
    df = df.withColumn("__frac", F.col("__h") - sec)
    one = F.lit(1.0)
    df = df.withColumns({"__p": val * (one - sat), "__q": val * (one - sat * frac), "__t": val * (one - sat * (one - frac))})
    p, q, t = F.col("__p"), F.col("__q"), F.col("__t")
    table = ((val, t, p), (q, val, p), (p, val, t), (p, q, val), (t, p, val), (val, p, q))

    def pick(i):
        c = F.when(sec == 0, table[0][i])
        for k in range(1, 5):
            c = c.when(sec == k, table[k][i])
        return c.otherwise(table[5][i])
    df = df.withColumns({n: pick(i) for i, n in enumerate(out)})
    df = df.withColumns({n: half_up(n).cast("int") for n in out})
    return df.drop("__h", "__sat", "__val", "__sec", "__frac", "__p", "__q", "__t")


# --- Lab ---------------------------------------------------------------------

def _linear_rule(c: float) -> float:
    return c / 12.92 if c <= 0.04045 else math.pow((c + 0.055) / 1.055, 2.4)


# The 256 possible channel values, computed from the sRGB rule once per process.
_LINEAR_SQL = "array(" + ",".join(f"{_linear_rule(i / 255.0)!r}D" for i in range(256)) + ")"


def linear_channel(c) -> Column:
    """Linear light of an 8-bit channel; null outside 0..255."""
    return F.get(F.expr(_LINEAR_SQL), _c(c).cast("int"))


def _f(t: Column) -> Column:
    return F.when(t > LAB_EPS, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)


def _lab_from_linear(lr, lg, lb, quantise: bool) -> tuple[Column, Column, Column]:
    x = (lr * TO_XYZ[0][0] + lg * TO_XYZ[0][1] + lb * TO_XYZ[0][2]) / WHITE_X
    y = lr * TO_XYZ[1][0] + lg * TO_XYZ[1][1] + lb * TO_XYZ[1][2]
    z = (lr * TO_XYZ[2][0] + lg * TO_XYZ[2][1] + lb * TO_XYZ[2][2]) / WHITE_Z
    light = F.when(y > LAB_EPS, F.cbrt(y) * 116.0 - 16.0).otherwise(y * LAB_KAPPA)
    a, b = (_f(x) - _f(y)) * 500.0, (_f(y) - _f(z)) * 200.0
    out = (light * 255.0 / 100.0, a + 128.0, b + 128.0)
    return tuple(half_up(v) for v in out) if quantise else out


def rgb_to_lab(r, g, b, quantise: bool = True) -> tuple[Column, Column, Column]:
    return _lab_from_linear(linear_channel(r), linear_channel(g), linear_channel(b), quantise)


def with_lab(df: DataFrame, rgb=("r", "g", "b"), out=("lab_l", "lab_a", "lab_b"),
             quantise: bool = True) -> DataFrame:
    """Add Lab columns in two stages, so each channel is linearised once per row."""
    tmp = ("__lin_r", "__lin_g", "__lin_b")
    df = df.withColumns({t: linear_channel(c) for t, c in zip(tmp, rgb)})
    lab = _lab_from_linear(*[F.col(t) for t in tmp], quantise)
    return df.withColumns(dict(zip(out, lab))).drop(*tmp)


def _fxyz(l, a, b) -> tuple[Column, Column, Column]:
    light = _c(l) * (100.0 / 255.0)
    fy = F.when(light > LAB_EPS * LAB_KAPPA, (light + 16.0) / 116.0).otherwise(
        light / LAB_KAPPA * 7.787 + 16.0 / 116.0)
    return (_c(a) - 128.0) / 500.0 + fy, fy, fy - (_c(b) - 128.0) / 200.0


def _xyz(fx, fy, fz) -> tuple[Column, Column, Column]:
    def inverse(t):
        return F.when(t > 0.206893, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)
    return inverse(fx) * WHITE_X, inverse(fy), inverse(fz) * WHITE_Z


def _rgb_linear(x, y, z) -> tuple[Column, Column, Column]:
    return tuple(clip(x * m[0] + y * m[1] + z * m[2], 0.0, 1.0) for m in TO_RGB)


def _encode(c) -> Column:
    v = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return half_up(v * 255.0).cast("int")


def with_rgb(df: DataFrame, lab=("lab_l", "lab_a", "lab_b"), out=("back_r", "back_g", "back_b")) -> DataFrame:
    """Add 8-bit RGB columns from 8-bit Lab ones, in stages."""
    names = ("__t0", "__t1", "__t2")
    cols = tuple(F.col(c) for c in names)
    df = df.withColumns(dict(zip(names, _fxyz(*lab))))
    df = df.withColumns(dict(zip(names, _xyz(*cols))))
    df = df.withColumns(dict(zip(names, _rgb_linear(*cols))))
    return df.withColumns(dict(zip(out, [_encode(c) for c in cols]))).drop(*names)


def _s(cols) -> Column:
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])


def _u(s) -> tuple[Column, Column, Column]:
    return s["c0"], s["c1"], s["c2"]


def lab_to_rgb_struct(l, a, b) -> Column:
    """8-bit Lab to 8-bit RGB as struct<c0, c1, c2>, in one expression."""
    return let(_s(_fxyz(l, a, b)), lambda f: let(_s(_xyz(*_u(f))), lambda x: let(
        _s(_rgb_linear(*_u(x))), lambda c: _s([_encode(v) for v in _u(c)]))))


def hex_lab_struct(value) -> Column:
    """8-bit Lab of a hex colour as struct<c0, c1, c2>; null when invalid."""
    channels = lambda n: _s([linear_channel(F.shiftright(n, 16 - 8 * i).bitwiseAND(F.lit(255))) for i in range(3)])
    return F.when(_c(value).rlike(HEX_RULE), let(F.conv(F.substring(_c(value), 2, 6), 16, 10).cast("int"), lambda n: let(
        channels(n), lambda c: _s(_lab_from_linear(*_u(c), True)))))


def chroma(a, b) -> Column:
    da, db = _c(a) - 128.0, _c(b) - 128.0
    return F.sqrt(da * da + db * db)


def lab_distance(p, q) -> Column:
    return F.sqrt(reduce(lambda s, t: s + t, [(_c(u) - _c(v)) * (_c(u) - _c(v)) for u, v in zip(p, q)]))


def delta_e(rgb_a, rgb_b) -> Column:
    return lab_distance(rgb_to_lab(*rgb_a), rgb_to_lab(*rgb_b))


def hex_distance(a, b) -> Column:
    """Lab distance of two hex colours; null when either is missing or invalid."""
    return let(F.struct(hex_lab_struct(a).alias("p"), hex_lab_struct(b).alias("q")),
               lambda v: lab_distance(_u(v["p"]), _u(v["q"])))


def lab_struct_distance(p, q) -> Column:
    """Distance of two values of ``hex_lab_struct``; null when either is."""
    return lab_distance(_u(p), _u(q))


def blend_lab(p, q, weight_q=0.35) -> Column:
    """The hex colour of a mix of two values of ``hex_lab_struct`` (truncated to whole numbers)."""
    w = _c(weight_q)
    mix = _s([F.floor(clip(u * (F.lit(1.0) - w) + v * w, 0.0, 255.0)) for u, v in zip(_u(p), _u(q))])
    return let(mix, lambda m: let(lab_to_rgb_struct(*_u(m)), lambda c: rgb_to_hex(*_u(c))))


def blend_hex(a, b, weight_b=0.35) -> Column:
    """Mix two hex colours in 8-bit Lab (the mix is truncated to whole numbers)."""
    pair = F.struct(hex_lab_struct(a).alias("p"), hex_lab_struct(b).alias("q"))
    out = let(pair, lambda v: blend_lab(v["p"], v["q"], weight_b))
    return F.when(_c(a).rlike(HEX_RULE) & _c(b).rlike(HEX_RULE), out).otherwise(_c(b))


# --- hue circle --------------------------------------------------------------

def hue_delta(target, source) -> Column:
    return F.pmod(_c(target) - _c(source) + 180.0, F.lit(360.0)) - 180.0


def hue_lerp(current, target, amount) -> Column:
    return F.pmod(_c(current) + hue_delta(target, current) * _c(amount), F.lit(360.0))


# --- pixel predicates --------------------------------------------------------

def is_ink(gray, low=60) -> Column:
    return _c(gray) <= low


def is_content(gray) -> Column:
    return _c(gray).between(35, 242)


def is_paper(gray, threshold=235) -> Column:
    return _c(gray) > threshold


def _spread(r, g, b):
    hi, lo = F.greatest(_c(r), _c(g), _c(b)), F.least(_c(r), _c(g), _c(b))
    return hi, hi - lo


def is_black_like(r, g, b) -> Column:
    hi, spread = _spread(r, g, b)
    return (hi <= 96) & (spread <= 34)


def is_neutral_ink(r, g, b) -> Column:
    hi, spread = _spread(r, g, b)
    return (hi <= 48) & (spread <= 6)


def is_chromatic(sat, val) -> Column:
    return (_c(sat) > 30) & (_c(val) > 25) & (_c(val) < 245)


def is_usable(sat, val, min_sat=12, min_val=18, max_val=248) -> Column:
    return (_c(sat) > min_sat) & (_c(val) > min_val) & (_c(val) < max_val)


def tone_weight(light, tone_range: str) -> Column:
    """Triangular weight of an 8-bit lightness for one tone range."""
    n = clip(_c(light) / 255.0, 0.0, 1.0)
    if tone_range == "highlights":
        return clip((n - 0.58) / 0.30, 0.0, 1.0)
    if tone_range == "shadows":
        return clip((F.lit(0.42) - n) / 0.30, 0.0, 1.0)
    if tone_range == "midtones":
        return clip(F.lit(1.0) - F.abs(n - 0.52) / 0.28, 0.0, 1.0)
    return F.lit(1.0)


def effective_alpha(alpha, authority) -> Column:
    base, power = clip(alpha, 0.0, 1.0), clip(authority, 0.0, 2.0)
    beyond = clip(base + (F.lit(1.0) - base) * (power - 1.0) * 0.72, 0.0, 1.0)
    return F.when(power <= 1.0, base * power).otherwise(beyond)
