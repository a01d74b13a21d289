"""Colour functions against independent statements of the rules."""

import colorsys
import random

from pyspark.sql import functions as F

from chromaframe.functions import color as C
from chromaframe.functions import palette as P
from chromaframe.streaming import colors as K


def _rgbs(n=400, seed=3):
    rnd = random.Random(seed)
    edge = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (1, 1, 1), (10, 11, 11)]
    return edge + [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(n)]


def test_lab_and_hex_agree_with_scalar_rules(spark):
    rows = _rgbs()
    df = C.with_rgb(C.with_lab(spark.createDataFrame(rows, "r int, g int, b int")))
    for r in df.select("*", C.rgb_to_hex("r", "g", "b").alias("h")).collect():
        rgb = (r.r, r.g, r.b)
        assert (r.lab_l, r.lab_a, r.lab_b) == K.rgb_lab(rgb)
        assert "#{:02x}{:02x}{:02x}".format(*rgb) == r.h and K.hex_rgb(r.h) == rgb
        assert "#{:02x}{:02x}{:02x}".format(r.back_r, r.back_g, r.back_b) == K.lab_hex((r.lab_l, r.lab_a, r.lab_b))


def test_hsv_matches_standard_library(spark):
    h, s, v = C.rgb_to_hsv("r", "g", "b")
    df = C.with_hsv(spark.createDataFrame(_rgbs(), "r int, g int, b int"), out=("h", "s", "v"))
    df = C.with_hsv_rgb(df, ("h", "s", "v"), ("b0", "b1", "b2")).withColumns({"h2": h, "s2": s, "v2": v})
    for r in df.collect():
        assert (r.h, r.s, r.v) == (r.h2, r.s2, r.v2)
        hh, ss, vv = colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255)
        assert abs((r.h - hh * 180 + 90) % 180 - 90) <= 0.51 and abs(r.s - ss * 255) <= 0.51 and r.v == round(vv * 255)
        assert max(abs(r.b0 - r.r), abs(r.b1 - r.g), abs(r.b2 - r.b)) <= 8


def test_invalid_colours_give_null(spark):
    df = spark.createDataFrame([("#12345g", "#000000"), (None, "#ffffff"), ("red", None)], "a string, b string")
    out = df.select(C.hex_channel("a", 0).alias("c"), C.hex_distance("a", "b").alias("d")).collect()
    assert all(r.c is None and r.d is None for r in out)


def test_merge_palette_fold(spark):
    rnd = random.Random(5)
    near = lambda: "#{:02x}{:02x}{:02x}".format(*[rnd.choice((40, 44, 60, 120, 200, 210)) for _ in range(3)])
    rows = [([near() for _ in range(rnd.randrange(4))], [near() for _ in range(rnd.randrange(5))] + ["#XYZ", None]) for _ in range(150)]
    rows += [([], []), (["#000000"] * 3, ["#000001"])]
    df = spark.createDataFrame(rows, "s array<string>, c array<string>")
    got = df.select("s", "c", P.merge_palette("s", "c").alias("m")).collect()
    assert [r.m for r in got] == [K.merge_slots(r.s, r.c) for r in got]


def test_hue_delta_range(spark):
    df = spark.range(0, 720, 7).select(F.col("id").alias("t"), (F.col("id") * 5 % 360).alias("s"))
    for r in df.select("t", "s", C.hue_delta("t", "s").alias("d")).collect():
        assert -180 <= r.d < 180 and abs((r.s + r.d - r.t) % 360) in (0, 360)
