"""The page analysis falls back on faces where a page has no hair anchor."""

from chromaframe.operators.analysis import analyze_pages


def test_face_fallback(spark):
    regions = spark.createDataFrame(
        [(1, 1, 1, "hair", 0.9, 100, 100, 60, 60, 120.0, 0.02), (1, 1, 2, "skin", 0.9, 110, 120, 20, 20, 180.0, 0.01),
         (1, 2, 1, "skin", 0.9, 100, 100, 60, 60, 120.0, 0.02), (1, 2, 3, "sky", 0.1, 0, 0, 9, 9, 120.0, 0.02)],
        "book_id int, page_id int, region_id int, label string, conf double, x int, y int, w int, h int, mean_gray double, frac double")
    vector = [1.0] + [0.0] * 15
    profiles = spark.createDataFrame([(1, 5, 120.0, 1.0, 0.02, [1.0] + [0.0] * 11, vector, vector), (1, 6, 10.0, 3.0, 0.3, [0.0] * 11 + [1.0], vector[::-1], vector[::-1])],
                                     "book_id int, char_id int, tone double, aspect double, area_frac double, hist array<double>, embedding array<float>, lineart array<float>")
    palette = spark.createDataFrame([(1, c, a, f"#0{c}0{c}0{c}") for c in (5, 6) for a in ("hair", "skin")], "book_id int, char_id int, attribute string, color string")
    face = lambda page: (1, page, 900 + page, 0.9, 0.9, 50.0, 120.0, 1.0, 0.02, [1.0] + [0.0] * 11, vector, vector, [("hair", 7, None), ("skin", 1, None)])
    faces = spark.createDataFrame([face(1), face(2)], "book_id int, page_id int, face_id int, confidence double, conf double, area double, tone double, aspect double, area_frac double, "
                                  "hist array<double>, embedding array<float>, lineart array<float>, regions array<struct<attribute: string, region_id: int, forced: int>>")
    features = spark.createDataFrame([(1, 1, [1.0] + [0.0] * 11, vector, vector)], "page_id int, region_id int, hist array<double>, embedding array<float>, lineart array<float>")
    out = analyze_pages(regions, profiles, palette, features=features, faces=faces)
    got = {(r.page_id, r.region_id): (r.attribute, r.char_id, r.way) for r in out["assignments"].collect()}
    assert got[(1, 1)] == ("hair", 5, "anchor") and got[(2, 1)] == ("skin", 5, "face") and got[(2, 7)] == ("hair", 5, "face")
    assert all(way == "anchor" for (page, _), (_, _, way) in got.items() if page == 1)
    assert {(r.page_id, r.reason) for r in out["diagnostics"].collect()} == {(1, None), (2, "no_hair_anchor")}
    assert out["hints"].where("page_id = 1 AND region_id = 1").count() == 3
