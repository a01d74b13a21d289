"""Files written by the test, and the naming, document and fragment rules."""

import base64
import json
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.functions.plugins import embed_with, map_pages
from chromaframe.operators import fusion as U
from chromaframe.sources import files as FS
from chromaframe.sources import pages as PG
from chromaframe.sources import projects as PJ


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))
    part = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_scan_and_explode(spark, tmp_path):
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    os.makedirs(tmp_path / "sub")
    _png(tmp_path / "a.png", one)
    _png(tmp_path / "sub" / "B.PNG", two)
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    good, bad = PG.scan_pages(spark, str(tmp_path))
    assert [os.path.basename(r.path) for r in bad.collect()] == ["broken.png"]
    d = good.withColumn("page_id", PG.file_of(F.col("path")))
    px = {(r.page_id, r.x, r.y): (r.r, r.g, r.b, r.gray) for r in PG.explode_pixels(d).collect()}
    assert len(px) == 35 + 12
    for name, img in (("a.png", one), ("B.PNG", two)):
        for y in range(img.shape[0]):
            for x in range(img.shape[1]):
                r, g, b = (int(v) for v in img[y, x])
                assert px[(name, x, y)] == (r, g, b, (299 * r + 587 * g + 114 * b + 500) // 1000)
    thin = PG.explode_pixels(d, stride=2).where("page_id = 'a.png'").collect()
    assert sorted((r.x, r.y) for r in thin) == [(x, y) for x in (0, 2, 4, 6) for y in (0, 2, 4)]


def test_raster_containers(spark, tmp_path):
    rng = np.random.default_rng(1)
    colour, grey = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), rng.integers(0, 256, (4, 3), dtype=np.uint8)
    p6 = b"P6\n# by hand\n7 5\n255\n" + colour.tobytes()
    p5 = b"P5 3 4 255\n" + grey.tobytes()
    (tmp_path / "two.ppm").write_bytes(p6 + p5)
    (tmp_path / "cut.ppm").write_bytes(p5 + p6[:-1])
    (tmp_path / "deep.pgm").write_bytes(b"P5 1 1 65535\n\0\0")
    (tmp_path / "text.pgm").write_bytes(b"no raster at all")
    (tmp_path / "huge.pgm").write_bytes(b"P5 999999999 999999999 255\n12")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(PG.file_of(F.col("path")).alias("path"), "content")
    files = files.unionByName(spark.createDataFrame([("empty.pgm", bytearray(b"")), ("none.pgm", None)], "path string, content binary"))
    good, bad = PG.read_rasters(files)
    assert sorted(map(tuple, bad.collect())) == [("cut.ppm", 1, "cut short"), ("deep.pgm", 0, "not 8 bits"), ("empty.pgm", 0, "no raster"),
                                                 ("huge.pgm", 0, "cut short"), ("none.pgm", 0, "no raster"), ("text.pgm", 0, "no raster")]
    px = PG.explode_pixels(good.withColumn("page_id", F.concat("path", F.lit("/"), "nth"))).collect()
    got = {(r.page_id, r.x, r.y): (r.r, r.g, r.b) for r in px}
    want = {("two.ppm/0", x, y): tuple(int(v) for v in colour[y, x]) for y in range(5) for x in range(7)}
    want |= {(n, x, y): (int(grey[y, x]),) * 3 for n in ("two.ppm/1", "cut.ppm/0") for y in range(4) for x in range(3)}
    assert got == want
    page = spark.createDataFrame(px).where("page_id = 'two.ppm/0' AND NOT (x = 2 AND y = 1)")
    again = {(r.x, r.y): (r.r, r.g, r.b) for r in PG.explode_pixels(PG.pack_pixels(page, 7, 5)).collect()}
    assert again == {k[1:]: (0, 0, 0) if k[1:] == (2, 1) else v for k, v in want.items() if k[0] == "two.ppm/0"}


def test_natural_order(spark):
    names = ["page10.png", "page2.png", "Page1.png", "page02b.png", "2.png", "10.png", "a.png", "page.png", "page2a10.png", "page2a9.png"]
    rows = [(f"/x/{n}",) for n in names] + [("/b/z1.png",), ("/b/z12.png",), ("/b/z3.png",)]
    random.Random(1).shuffle(rows)
    got = [r.p for r in PG.natural_order(spark.createDataFrame(rows, "p string"), "p").collect()]
    key = lambda p: (os.path.dirname(p), [int(t) if t.isdigit() else t.lower() for t in re.split(r"(\d+)", os.path.basename(p))])
    assert [key(p) for p in got] == sorted(key(p) for (p,) in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unique_names_with_clashing_stems(spark, seed):
    rnd = random.Random(seed)
    stems = ["a", "a_2", "a_2_2", "b", "a_3"]
    req = [("f", rnd.choice(stems), ".png", i) for i in range(60)]
    taken = [("f", n) for n in ("a.png", "b_4.png", "a_2_3.png", "a_5.png", "b_x.png")]
    used, want = {n for _, n in taken}, {}
    for f, s, e, i in req:
        n = 1
        while (name := s + ("" if n == 1 else f"_{n}") + e) in used:
            n += 1
        used.add(name)
        want[i] = name
    got = FS.unique_names(spark.createDataFrame(req, "folder string, stem string, ext string, seq long"),
                          spark.createDataFrame(taken, "folder string, name string"), 8)
    assert {r.seq: r.name for r in got.collect()} == want


def test_project_round_trip(spark):
    pages = spark.createDataFrame([(p, i, f"/b/{p}/{i}.png") for p in (1, 2) for i in range(12)], "project_id int, page_ord int, path string")
    hints = spark.createDataFrame([(1, 3, "manual", k, 0.1 * k, [k, 2, 3]) for k in range(11)],
                                  "project_id int, page_ord int, kind string, hint_ord int, x_norm double, rgb array<int>")
    docs = PJ.save_project(pages, hints)
    back = PJ.load_project(docs)
    rows = sorted(map(tuple, back["pages"].select("project_id", "page_ord", "path").collect()))
    assert rows == sorted(map(tuple, pages.collect()))
    again = PJ.load_project(PJ.save_project(back["pages"].select("project_id", "page_ord", "path"), back["hints"]))
    pick = lambda d: sorted(map(tuple, d["hints"].select("project_id", "page_ord", "kind", "hint_ord", "x_norm", "rgb").collect()))
    assert pick(back) == pick(again) == sorted((1, 3, "manual", k, 0.1 * k, [k, 2, 3]) for k in range(11))
    broken = PJ.load_project(spark.createDataFrame([(7, "{oops"), (8, "{}")], "project_id int, body string"))["broken"]
    assert sorted(r.project_id for r in broken.collect()) == [7, 8]


def test_projects_in_pieces(spark):
    """One project has a third of all pages, and one of its pages a third of all hints."""
    rnd = random.Random(6)
    pages = [(0, i, f"/b/0/{i}.png", None if i % 3 else "ai") for i in range(60)] + [(p, i * 9000, f"/b/{p}/{i}", "x\"y") for p in range(1, 31) for i in range(4)]
    hints = [(0, 5, k, i, i / 7.0) for k in ("auto", "manual") for i in range(40)] + [(p, 0, "manual", i, 0.5) for p in range(1, 31) for i in range(5)]
    chars = [(p, c, f"n{c}") for p in range(0, 31, 2) for c in range(3)]
    settings = [(p, k, str(p)) for p in range(31) for k in ("width", "mode")]
    for rows in (pages, hints, chars, settings):
        rnd.shuffle(rows)
    ddl = {"pages": "page_ord int, path string, ai_result string", "hints": "page_ord int, kind string, hint_ord int, x_norm double",
           "characters": "char_id int, name string", "settings": "key string, value string"}
    tables = [spark.createDataFrame(rows, "project_id int, " + d) for rows, d in zip((pages, hints, chars, settings), ddl.values())]
    pieces = PJ.save_pieces(*tables, size=7)
    assert pieces.where("rows > 7 AND part <> 'manifest'").count() == 0
    back = PJ.load_pieces(pieces, {k: v.replace(" ", ": ").replace(",:", ",") for k, v in ddl.items()})
    for (part, rows) in zip(ddl, (pages, hints, chars, settings)):
        assert sorted(map(tuple, back[part].collect()), key=str) == sorted(rows, key=str)
    bodies = pieces.where("project_id = 0 AND part = 'pages'").orderBy("piece").collect()
    assert [q["page_ord"] for b in bodies for q in json.loads(b.body)] == list(range(60))
    assert {r.state for r in PJ.piece_states(pieces).collect()} == {"ok"}
    hurt = pieces.where("NOT (project_id = 0 AND part = 'pages' AND piece = 3) AND NOT (project_id = 2 AND part = 'manifest')")
    hurt = hurt.withColumn("body", F.when((F.col("project_id") == 4) & (F.col("part") == "settings"), "[]").otherwise(F.col("body")))
    states = {r.project_id: r.state for r in PJ.piece_states(hurt).collect()}
    assert states == {p: {0: "incomplete", 2: "no manifest", 4: "incomplete"}.get(p, "ok") for p in range(31)}


def test_fragments(spark):
    data = bytes(range(256)) * 3
    text = base64.b64encode(data).decode()
    parts = [(1, f"d/part-{i}.b64", text[i * 100:(i + 1) * 100] + "\n") for i in range(12)] + [(2, "d/part-1.b64", "***"), (3, "d/part-1.b64", "A" * 5000)]
    random.Random(0).shuffle(parts)
    df = spark.createDataFrame(parts, "payload_id int, name string, body string")
    out = {r.payload_id: r for r in FS.reassemble_chunks(df, max_bytes=2000, piece=256).collect()}
    assert out[1].state == "ok" and out[1].decoded_bytes == len(data) and out[1].pieces == 4 and out[1].fragments == 12
    assert out[2].state == "not decodable" and out[3].state == "oversized" and out[3].pieces == 0 and out[3].decoded_bytes is None
    pieces = FS.chunk_pieces(df, max_bytes=2000, piece=256).where("payload_id = 1").orderBy("piece").collect()
    assert b"".join(bytes(r.bytes) for r in pieces) == data and [r.offset for r in pieces] == [0, 192, 384, 576]


def test_fragments_of_a_large_payload(spark):
    """One payload holds a third of the rows; cuts fall anywhere, and padding is only right at the very end."""
    rnd, want, parts = random.Random(3), {}, []
    for pid in range(25):
        data = rnd.randbytes(rnd.randrange(0, 90) + (9000 if pid == 0 else 0))
        text, at, n = base64.b64encode(data).decode(), 0, 0
        if pid == 7:
            text = base64.b64encode(b"ab").decode() * 300  # padding in the middle
        if pid == 8:
            text = text[:-1] + "="  if len(text) % 4 == 0 else text
            text += "A"  # a length that no text has
        while at < len(text) or n == 0:
            step = rnd.choice([0, 1, 3, 40, 90])
            parts.append((pid, f"x/part{'-' if n % 2 else ''}{n:03d}.b64" if pid else f"x/part-{n}.b64", f" {text[at:at + step]}\n" if step else None))
            at, n = at + step, n + 1
        try:
            want[pid] = base64.b64decode(text, validate=True)
        except ValueError:
            want[pid] = None
    assert want[7] is None and want[8] is None
    parts += [(1, "x/readme.txt", "not a fragment")]
    rnd.shuffle(parts)
    df = spark.createDataFrame(parts, "payload_id int, name string, body string").repartition(5)
    for piece in (4, 64, 196_608):
        got = {r.payload_id: r for r in FS.reassemble_chunks(df, piece=piece).collect()}
        assert {k: r.decoded_bytes for k, r in got.items()} == {k: None if v is None else len(v) for k, v in want.items()}
        rows = sorted((r.payload_id, r.piece, bytes(r.bytes or b"")) for r in FS.chunk_pieces(df, piece=piece).collect())
        for k, v in want.items():
            if v is not None:
                assert b"".join(r[2] for r in rows if r[0] == k) == v


def test_selection_algebra(spark):
    mk = lambda cells: spark.createDataFrame([(p, x, 0) for p, x in cells], "page_id int, x int, y int")
    old, new = {(1, 1), (1, 2), (2, 5)}, {(1, 2), (1, 3)}
    run = lambda m: {(r.page_id, r.x) for r in U.combine_selection(mk(old), mk(new), m).collect()}
    assert run("add") == old | new and run("subtract") == old - new and run("replace") == new | {(2, 5)}


def test_plugins_capture_failures(spark):
    def missing():
        raise ImportError("no model")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "page_id int, t string")
    rows = embed_with(df, "t", missing).collect()
    assert all(r.embedding is None and "no model" in r.embedding_error for r in rows)

    def load():
        def fn(values):
            assert len(values) <= 32
            return [[float(len(v))] for v in values]
        return fn
    assert all(r.embedding == [float(len(r.t))] and r.embedding_error is None for r in embed_with(df, "t", load).collect())

    def fail_odd(row):
        if row["page_id"] % 2:
            raise ValueError("odd")
        return {"n": row["page_id"] * 2}
    out = map_pages(df, fail_odd, "n long").collect()
    assert len(out) == 70 and all((r.n is None) == (r.page_id % 2 == 1) and (r.error is None) == (r.page_id % 2 == 0) for r in out)
