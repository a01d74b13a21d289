"""Style tables: tier colours, style-aware colours, preset lookup, record conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaframe.functions.color import (_c, clip, lab_to_rgb_struct, round_even, with_hsv, with_hsv_rgb, with_lab)
from chromaframe.scale import measured_broadcast

DESCRIPTOR_FIELDS = {"warm_bias": 0.0, "shadow_bias": 0.0, "shadow_desat": 0.0, "shadow_hue_rotate": 0.0,
                     "highlight_bias": 0.0, "highlight_desat": 0.0, "highlight_hue_rotate": 0.0,
                     "saturation_scale": 1.0, "global_warm_cool": 0.0, "global_saturation": 1.0}


def style_tiers(colors: DataFrame, styles: DataFrame, strength=1.0, on=("style_id", "region")) -> DataFrame:
    """Three rows (highlight, mid, shadow) per seed colour, shifted by the region's descriptor.

    A missing descriptor means the neutral one. ``styles`` is a dimension table.
    """
    d = colors.join(measured_broadcast(styles), list(on), "left").fillna(DESCRIPTOR_FIELDS)
    d = with_lab(d, out=("__l", "__a", "__b")).withColumn("__s", clip(strength, 0.0, 1.0))
    s = F.col("__s")

    def scaled(v, by):
        return (v - 128.0) * by + 128.0
    sat = F.lit(1.0) + (F.col("saturation_scale") * F.col("global_saturation") - 1.0) * s
    d = d.withColumns({"__ma": scaled(F.col("__a"), sat),
                       "__mb": scaled(F.col("__b") + (F.col("warm_bias") + F.col("global_warm_cool")) * s, sat)})

    def tier(name, dl, side):
        if side is None:
            ta, tb = F.col("__ma"), F.col("__mb")
        else:
            ta = F.col("__ma") + F.col(f"{side}_hue_rotate") * s
            tb = F.col("__mb") + F.col(f"{side}_bias") * s
            fade = F.lit(1.0) - F.when(F.col(f"{side}_desat") > 0, F.col(f"{side}_desat")).otherwise(0.0) * s
            ta, tb = scaled(ta, fade), scaled(tb, fade)
        lab = [F.floor(clip(v, 0.0, 255.0)) for v in (F.col("__l") + dl, ta, tb)]
        return F.struct(F.lit(name).alias("tier"), lab_to_rgb_struct(*lab).alias("rgb"))
    tiers = F.array(tier("highlight", 30.0, "highlight"), tier("mid", 0.0, None), tier("shadow", -35.0, "shadow"))
    keep = [c for c in colors.columns]
    return (d.select(*keep, F.inline(tiers))
            .select(*keep, "tier", *[F.col(f"rgb.c{i}").alias(f"tier_{c}") for i, c in enumerate("rgb")]))


def adapt_to_style(df: DataFrame, presets: DataFrame, on: str = "style_key") -> DataFrame:
    """Style-adjusted colour: an HSV result and a Lab result, mixed 0.62 or 0.40.

    Rows whose style is missing or 'none' keep their colour.
    """
    d = df.join(measured_broadcast(presets), on, "left")
    boost = clip(F.col("saturation_boost"), 0.05, 3.0)
    d = with_hsv(with_lab(d, out=("__l", "__a", "__b")), out=("__h", "__s", "__v")).withColumn("__boost", boost)
    boost = F.col("__boost")
    factor = F.when(boost < 1.0, clip(boost * 0.90 + 0.10, 0.08, 1.0)).otherwise(
        clip((boost - 1.0) * 0.10 + 0.94, 0.90, 1.18))
    pale = clip((F.lit(1.0) - boost) / 0.92, 0.0, 1.0)
    value = F.when(pale > 0.0, clip(F.col("__v") + (F.lit(255.0) - F.col("__v")) * (pale * 0.16 + 0.10), 0.0, 255.0)
                   ).otherwise(F.col("__v").cast("double"))
    tone = clip(F.pow(F.greatest(F.col("__l") / 255.0, F.lit(1e-4)), clip("l_gamma", 0.65, 1.6)), 0.0, 1.0)
    lab = (F.floor(tone * 255.0), F.floor(clip(F.col("__a") + F.col("chroma_red_shift") * 0.55, 0.0, 255.0)),
           F.floor(clip(F.col("__b") + F.col("chroma_warm_shift") * 0.75, 0.0, 255.0)))
    d = d.withColumns({"__s2": F.floor(clip(F.col("__s") * factor, 0.0, 255.0)), "__v2": F.floor(value),
                       "__l2": lab[0], "__a2": lab[1], "__b2": lab[2]})
    d = d.withColumn("__rgb", lab_to_rgb_struct("__l2", "__a2", "__b2"))
    d = with_hsv_rgb(d, ("__h", "__s2", "__v2"), ("__hr", "__hg", "__hb"))
    one, two = [F.col(f"__h{c}") for c in "rgb"], [F.col(f"__rgb.c{i}") for i in range(3)]
    share = F.when(boost < 1.0, 0.62).otherwise(0.40)
    plain = F.col("saturation_boost").isNull() | (F.col(on) == "none")
    out = {n: F.when(plain, F.col(c)).otherwise(
        F.floor(clip(p * share + q * (F.lit(1.0) - share), 0.0, 255.0)).cast("int"))
        for n, c, p, q in zip(("styled_r", "styled_g", "styled_b"), "rgb", one, two)}
    return d.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def preset_lookup(df: DataFrame, presets: DataFrame, key: str, preset_key: str, default: str,
                  aliases: dict[str, str] | None = None) -> DataFrame:
    """Join preset rows by trimmed, case-folded key; unknown keys take the default row."""
    norm = F.lower(F.trim(F.col(key)))
    for old, new in (aliases or {}).items():
        norm = F.when(norm == old, new).otherwise(norm)
    side = measured_broadcast(presets)
    known = side.select(F.col(preset_key).alias("__known"))
    d = (df.withColumn("__want", norm)
         .join(measured_broadcast(known), F.col("__want") == F.col("__known"), "left")
         .withColumn("__want", F.coalesce("__known", F.lit(default))).drop("__known"))
    return d.join(side, F.col("__want") == F.col(preset_key), "left").drop("__want")


def temperature_shift(temperature, amount: float) -> Column:
    t = _c(temperature)
    return F.when(t == "warm", amount).when(t == "cool", -amount).otherwise(0.0)


def profile_to_descriptor(df: DataFrame, extra_warm=0.0, sat_mult=1.0) -> DataFrame:
    """Relative rendering language of a style profile, for one region class."""
    warm = temperature_shift("temperature", 4.0)
    sat, con, grad = F.col("saturation"), F.col("contrast"), F.col("gradient")
    out = {"warm_bias": round_even(warm + _c(extra_warm), 2), "shadow_bias": round_even(warm * -0.3, 2),
           "shadow_desat": round_even((F.lit(1.0) - grad) * 0.3, 3), "highlight_bias": round_even(warm * 0.2, 2),
           "saturation_scale": round_even(sat * 1.2 * _c(sat_mult), 3), "region_gradient": round_even(grad, 3),
           "region_contrast": round_even(F.greatest(F.lit(0.7), con * 1.2), 3),
           "global_warm_cool": round_even(warm * 0.3, 2), "global_saturation": round_even(sat * 1.2, 3),
           "global_contrast": round_even(con * 1.2, 3),
           "global_shadow_lift": round_even(F.col("shadow_strength") * 0.3, 3),
           "cel_flatten": round_even(F.greatest(F.lit(0.0), F.lit(1.0) - grad * 1.5), 3)}
    return df.select("*", *[v.alias(k) for k, v in out.items()])


# Smoothing of a preset made from a descriptor, and the version of a style document.
PRESET_DENOISE = 15
STYLE_VERSION = 3


def _given(df: DataFrame, name: str, kind: str) -> Column:
    """A column of the table, or null where it has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def descriptor_to_preset(df: DataFrame, key: str | None = None) -> DataFrame:
    """Grading preset of a descriptor's global statistics (clipped linear rules), with its key, label and description.

    ``key`` names a column with the wanted keys; where it is null, the key is made from the name.
    """
    ambience = clip(F.coalesce(F.col("global_ambience"), F.lit(0.20)), 0.0, 1.0)
    con = F.col("contrast")
    made = F.concat(F.lit("descriptor_"), F.replace(F.lower("name"), F.lit(" "), F.lit("_")))
    wanted = F.nullif(F.col(key), F.lit("")) if key else F.lit(None).cast("string")
    out = {
        "preset_key": F.coalesce(wanted, made), "label": F.concat("name", F.lit(" (descriptor)")),
        "preset_description": F.coalesce(F.nullif(_given(df, "description", "string"), F.lit("")), F.col("name")),
        "saturation_boost": clip((F.col("saturation") - 0.7) * 0.45 + 1.0, 0.85, 1.35),
        "white_threshold": clip((con * 25 + 210).cast("int"), 205, 238),
        "black_threshold": clip((F.col("shadow_strength") * 25 + 20).cast("int"), 15, 45),
        "l_gamma": clip(F.lit(1.15) - con * 0.3, 0.85, 1.15),
        "chroma_warm_shift": (temperature_shift("temperature", 3.0) + F.col("global_warm_cool") * 0.25) * ambience,
        "preset_cel_flatten": clip(F.coalesce(_given(df, "cel_flatten", "double"), F.lit(0.0)), 0.0, 0.85),
        "neutral_fade_floor": clip(F.col("gradient") * 0.3 + 0.25, 0.25, 0.6), "denoise_sigma": F.lit(PRESET_DENOISE)}
    return df.select("*", *[v.alias(k) for k, v in out.items()])


def descriptor_to_profile(df: DataFrame) -> DataFrame:
    """The style profile inside a descriptor, with its palette, description, source and document version."""
    return df.select("name", _given(df, "palette", "map<string,string>").alias("palette"), "saturation", "contrast", "temperature", "shadow_strength", "gradient",
                     _given(df, "description", "string").alias("description"), _given(df, "source", "string").alias("source"), F.lit(STYLE_VERSION).alias("version"))


def convert_style(df: DataFrame, to: str, key: str | None = None) -> DataFrame:
    """Convert profile rows to 'descriptor', or descriptor rows to 'profile' or 'preset'."""
    if to == "descriptor":
        return profile_to_descriptor(df)
    if to == "preset":
        return descriptor_to_preset(df, key)
    if to == "profile":
        return descriptor_to_profile(df)
    raise ValueError(f"unknown target: {to}")
