"""Steps whose cost must grow no faster than their input."""

import base64

from chromaframe.functions import palette as P
from chromaframe.operators import graph as G
from chromaframe.operators import spatial as S
from chromaframe.operators import stats as A
from chromaframe.operators import windows as W
from chromaframe.plans import load_all
from chromaframe.plans.registry import QUERIES
from chromaframe.sources import files as FS
from chromaframe.sources import pages as PG
from pyspark.sql import functions as F


load_all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps_are_not_broadcast(spark):
    rows = [(1, i, i * 3.0, 0.0, 10.0, 10.0, 0.5) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x double, y double, w double, h double, score double")
    assert "Broadcast" not in _plan(W.overlap_edges(df, ["page_id"], 0.28, "box_id", F.col("box_id")))


def test_crops_keep_all_but_the_overlapped(spark):
    rows = [(1, i, (i // 2) * 300, 0, 100, 100, i) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x int, y int, w int, h int, ord int")
    pages = spark.createDataFrame([(1, 1000, 1400), (2, 1000, 1400)], "page_id int, page_w int, page_h int")
    got = W.crop_boxes(df, pages)
    assert {(r.page_id, r.box_id) for r in got.collect()} == {(1, 0), (1, 2), (1, 4), (2, None)}


def test_boxes_are_dealt_before_they_spread(spark, monkeypatch):
    monkeypatch.setattr(W, "CELL_BOXES", 10)
    rows = [(i % 3, i, i // 6 * 70, i % 2, 40, 50 + i % 2) for i in range(300)] + [(None, 900, 0, 0, 40, 50), (1, None, 0, 0, 40, 50), (1, 901, 0, 0, None, 50)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x int, y int, w int, h int").coalesce(1)
    edges = W.overlap_edges(df, ["page_id"], 0.72, "box_id", F.col("box_id"))
    got = {(r.page_id, r.hi, r.lo) for r in edges.collect()}
    assert got == {(i % 3, i, i + 3) for i in range(300) if i % 6 < 3}
    # 302 boxes of one read task leave it for 31 tasks, once for both sides, before their cells are made.
    final = _plan(edges).split("Initial Plan")[0]
    assert final.count("31), REPARTITION_BY_NUM") == 2 and final.count("ReusedExchange") == 1


def test_overlaps_across_size_classes(spark):
    # Thin boxes from one corner: the IoU is the ratio of their widths, so classes lie as far apart as they can.
    wide = [1 + i * 0.75 for i in range(90)]
    df = spark.createDataFrame([(1, i, 0.0, 0.0, w, 0.5) for i, w in enumerate(wide)], "page_id int, box_id int, x double, y double, w double, h double")
    for limit in (0.28, 0.5, 0.72, 1.0):
        got = {(r.hi, r.lo) for r in W.overlap_edges(df, ["page_id"], limit, "box_id", F.col("box_id")).collect()}
        assert got == {(i, k) for i in range(90) for k in range(i + 1, 90) if wide[i] * 0.5 / (wide[i] * 0.5 + wide[k] * 0.5 - wide[i] * 0.5) > limit}


def test_reassembled_text(spark):
    text = base64.b64encode(bytes(range(200))).decode()
    parts = [(1, f"x/part-{i}.b64", text[i * 30:(i + 1) * 30]) for i in range(9)] + [(2, "x/part-1.b64", None), (3, "x/part-1.b64", "A" * 5000), (4, "x/part-1.b64", "* *")]
    df = spark.createDataFrame(parts, "payload_id int, name string, body string").repartition(4)
    got = {r.payload_id: r.encoded for r in FS.reassemble_chunks(df, max_bytes=2000, piece=64).collect()}
    assert got == {1: text, 2: "", 3: None, 4: "**"}


def test_pages_are_packed_without_a_grid(spark, monkeypatch):
    monkeypatch.setattr(PG, "PACK_PIXELS", 2)
    px = [(1, 2, 0, 9, 8, 7), (1, 1, 1, 1, 2, 3), (1, 1, 1, 4, 0, None), (2, 7, 7, 1, 1, 1), (3, 0, 0, -5, 255, 16), (None, 2, 1, 1, 1, 1)]
    df = spark.createDataFrame(px, "page_id int, x int, y int, r int, g int, b int")
    packed = PG.pack_pixels(df, 3, 2)
    assert "Generate" not in _plan(packed) and "Union" not in _plan(packed)
    got = {r.page_id: bytes(r.image["data"]).hex() for r in packed.collect()}
    black = "000000"
    assert got == {1: black * 2 + "070809" + black + "030204" + black, 2: black * 6, 3: "10ff00" + black * 5, None: black * 5 + "010101"}


def test_points_of_clusters_are_packed(spark, monkeypatch):
    made, cut = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda d: made.append(cut(d)) or made[-1])
    rows = [(k, (i * 37) % 256, (i * 11) % 256, (i * 3) % 256) for k in (1, 2) for i in range(2000)]
    found = A.page_palettes(spark.createDataFrame(rows, "page_id int, r int, g int, b int"), max_colors=3).collect()
    assert made[0].count() <= 64 and sum(r.pixels for r in found if r.page_id == 1) == 2000


def test_lab_once_per_colour(spark):
    df = spark.createDataFrame([(["#102030", "#ffffff"], ["#102031", "#00ff00", "#0000ff"])], "s array<string>, c array<string>")
    merged = df.select(P.merge_palette("s", "c").alias("m"))
    assert merged._jdf.queryExecution().analyzed().toString().count("conv(") <= 4
    assert len(merged.first().m) == 3


def test_palettes_are_dealt(spark, tmp_path):
    spark.range(300).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    d = QUERIES["merge_palette"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in _plan(d) and d.count() == 240


def test_parents_are_not_broadcast(spark):
    items = spark.createDataFrame([(1, i, i * 90, 40, 60, 700, 5, 0.5) for i in range(9)], "page_id int, item_id int, x int, y int, w int, h int, area int, item_score double")
    parents = spark.createDataFrame([(1, p, p * 300.0, 0.0, 200.0, 200.0, p * 300.0, 200.0, 200.0, 500.0) for p in range(3)],
                                    "page_id int, parent_id int, hx double, hy double, hw double, hh double, bx double, by double, bw double, bh double")
    owned = S.best_parent(items, parents)
    assert "Broadcast" not in _plan(owned) and "Broadcast" not in _plan(S.parent_groups(items, owned))
    head, body = ("hx", "hy", "hw", "hh"), ("bx", "by", "bw", "bh")
    score = F.round(S.parent_score(("x", "y", "w", "h"), head, body), 9)
    want = items.join(parents, "page_id").withColumn("s", score).where("s >= 0.85").groupBy("item_id").agg(F.max("s").alias("s"))
    assert {(r.item_id, r.score) for r in owned.collect()} == {(r.item_id, r.s) for r in want.collect()}


def test_fragments_wait_without_rewriting_sizes(spark, monkeypatch):
    made, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda d: made.append(d.columns) or cut(d))
    # A staircase of fragments: each waits for the one before; a large pair beside them rests.
    rows = [(1, x, y, 9 - x if y == 0 else 20) for x in range(8) for y in range(4)]
    got = G.merge_tiny(spark.createDataFrame(rows, "page_id int, x int, y int, region_id int"), 3).collect()
    assert {r.region_id for r in got} == {1} and all(r.settled for r in got)
    assert sum("cur" in c for c in made) <= 2
