"""Order-dependent operators against short sequential statements of their rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe.operators import hints as H
from chromaframe.operators import identity as I
from chromaframe.operators import windows as W
from chromaframe.streaming import state as T

HINT = ("page_id int, hint_id long, seq long, x_norm double, y_norm double, r int, g int, b int, radius_norm double, strength double, "
        "source string, priority int, region_id int, semantic string, character_id int, confidence double")


def _hints(n=400, seed=7):
    rnd = random.Random(seed)
    prio = {"manual": 100, "auto_instance": 40, "character_identity": 70}
    rows = []
    for i in range(n):
        s = rnd.choice(list(prio))
        rows.append((0 if rnd.random() < 0.6 else rnd.randrange(4), i, i, rnd.randrange(30) / 30, rnd.randrange(30) / 30, 1, 2, 3, 0.01,
                     rnd.randrange(10) / 10, s, prio[s], rnd.choice([None, 1, 2, 3]), rnd.choice([None, "hair"]), None, 0.9))
    return rows


def test_limit_density_greedy_pick(spark):
    rows, frac = _hints(), {(p, r): f for p in range(4) for r, f in ((1, 0.001), (2, 0.03), (3, 0.2))}
    df = spark.createDataFrame(rows, HINT)
    regions = spark.createDataFrame([(p, r, f) for (p, r), f in frac.items()], "page_id int, region_id int, frac double")
    got = sorted(r.hint_id for r in H.limit_density(df, regions, 7, 0.2).collect())
    groups = {}
    for h in rows:
        groups.setdefault((h[0], h[12], h[10], h[13]), []).append(h)
    picked = []
    for (page, region, *_), items in groups.items():
        f = frac.get((page, region)) if region else None
        limit = 2 if f is None else 1 if f <= 0.006 else 2 if f <= 0.04 else 3
        chosen = []
        for h in sorted(items, key=lambda h: (-h[11], -(h[9] * h[15]), h[2])):
            if len(chosen) < limit and all((h[3] - c[3]) ** 2 + (h[4] - c[4]) ** 2 > 0.2 ** 2 for c in chosen):
                chosen.append(h)
        picked += chosen
    want = [h[1] for h in picked if h[10] == "manual"]
    for page in range(4):
        auto = [h for h in picked if h[0] == page and h[10] != "manual"]
        want += [h[1] for h in sorted(auto, key=lambda h: (-h[11], -(h[9] * h[15]), h[2]))[:7]]
    assert got == sorted(want)


def test_nms_with_cap(spark):
    rnd = random.Random(11)
    rows = [(0 if rnd.random() < 0.7 else 1, i, rnd.randrange(300), rnd.randrange(300), rnd.randrange(20, 90), rnd.randrange(20, 90),
             rnd.randrange(20) / 20) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id int, box_id int, x int, y int, w int, h int, score double")
    got = sorted(r.box_id for r in W.nms(df, cap=9).collect())

    def iou(a, b):
        i = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        return i / (a[4] * a[5] + b[4] * b[5] - i)
    want = []
    for page in (0, 1):
        kept = []
        for b in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[6], -(r[4] * r[5]), r[1])):
            if len(kept) < 9 and all(iou(b, k) <= 0.28 for k in kept):
                kept.append(b)
        want += [k[1] for k in kept]
    assert got == sorted(want)


@pytest.mark.parametrize("style", ["western", "manga"])
def test_reading_order_rows(spark, style):
    rnd = random.Random(2)
    rows = [(p, i, rnd.randrange(500), rnd.randrange(600), 100, rnd.randrange(40, 90)) for p in range(6) for i in range(rnd.randrange(1, 12))]
    df = spark.createDataFrame(rows, "page_id int, idx int, x int, y int, width int, height int")
    got = {(r.page_id, r.idx): r.reading_index for r in W.reading_order(df, style).collect()}
    for page in range(6):
        mine = sorted((r for r in rows if r[0] == page), key=lambda r: r[3])
        tol = 0.3 * sum(r[5] for r in mine) / len(mine)
        out, line = [], []
        for r in mine:
            if line and r[3] - line[0][3] > tol:
                out.append(line)
                line = []
            line.append(r)
        out.append(line)
        sign = -1 if style == "manga" else 1
        flat = [r for ln in out for r in sorted(ln, key=lambda r: (sign * r[2], r[3], r[1]))]
        assert [got[(page, r[1])] for r in flat] == list(range(len(flat)))


@pytest.mark.parametrize("n,k", [(5, 8), (9, 8), (23, 8), (100, 7), (50, 1), (64, 3)])
def test_even_positions(spark, n, k):
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("seq"))
    want = list(range(n)) if n <= k else sorted(set(np.linspace(0, n - 1, k).astype(int).tolist()))
    sample = W.systematic_sample(df, ["g"], k, ["seq"], F.floor(F.col("seq") / 4))
    assert sorted(r.seq for r in sample.collect()) == want
    if k > 1:
        thin = H.thin_evenly(df, ["g"], k, width=5)
        assert sorted(r.seq for r in thin.collect()) == want


def test_claims_go_to_the_stronger_face(spark):
    reg = lambda *ids: [(a, i, None) for a, i in ids]
    rows = [(1, 10, 0.9, 50.0, 4, True, False, reg(("hair", 1), ("skin", 2), ("eyes", 3))),
            (1, 11, 0.5, 90.0, 5, True, False, reg(("hair", 1), ("skin", 2))),
            (1, 12, 0.4, 10.0, 6, True, False, reg(("hair", 7), ("skin", 2), ("eyes", 8))),
            (1, 13, 0.3, 10.0, None, False, False, [("hair", 9, 21), ("eyes", 4, None)])]
    schema = ("page_id int, face_id int, confidence double, area double, matched_char int, lock_allowed boolean, was_forced boolean, "
              "regions array<struct<attribute:string,region_id:int,forced:int>>")
    got = {(r.face_id, r.region_id): (r.char_id, r.lock_allowed) for r in I.claim_regions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(10, 1): (4, True), (10, 2): (4, True), (10, 3): (4, True), (12, 7): (6, True), (12, 8): (6, False),
                   (13, 9): (21, True), (13, 4): (21, True)}


def test_undo_redo_stack(spark):
    log = [("edit", 1), ("edit", 2), ("edit", 2), ("undo", 0), ("undo", 0), ("redo", 0), ("edit", 5), ("redo", 0)] + [("edit", i) for i in range(30)] \
        + [("undo", 0)] * 25
    rows = [(1, i, k, v) for i, (k, v) in enumerate(log)]
    out = T.run_batch(T.undo_redo_rule(), spark.createDataFrame(rows, "page_id int, seq long, kind string, payload int").repartition(4))
    got = [(r.payload, r.applied) for r in out.orderBy("seq").collect()]
    assert got[:8] == [(1, True), (2, True), (2, True), (1, True), (-1, True), (1, True), (5, True), (5, False)]
    assert sum(a for _, a in got[-25:]) == 20 and got[-1] == (9, False)


def test_tone_memory_slots(spark):
    tones = {1: [30, 100, 200], 2: [35, 95, 210, 34], 3: [60]}
    rows = [(1, "hair", s, i, float(t)) for s, ts in tones.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "book_id int, label string, seq long, region_id int, mean_gray double")
    got = {(r.seq, r.region_id): r.slot for r in T.run_batch(T.tone_memory_rule(max_slots=4), df).collect()}
    # Page 2: tone 34 comes before 35 and takes slot 0; 35 finds it used and opens slot 3.
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (2, 3): 0, (2, 0): 3, (2, 1): 1, (2, 2): 2, (3, 0): 3}


def test_dedupe_points_keeps_eight_per_colour(spark):
    rows = [(1, i, i / 40, 0.5, 9, 9, 9, 0.004, "manual", 2) for i in range(30)] + [(1, 30, 29 / 40 + 0.001, 0.5, 9, 9, 9, 0.004, "manual", 2)]
    df = spark.createDataFrame(rows, "page_id int, seq long, x_norm double, y_norm double, r int, g int, b int, radius_norm double, source string, region_id int")
    out = T.run_batch(T.dedupe_points_rule(), df).orderBy("seq").collect()
    assert [r.live for r in out] == list(range(1, 9)) + [8] * 23
    assert out[-1].action == "merged" and out[-1].point_seq == 29


def test_profile_upsert_rules(spark):
    base = dict(aspect=1.0, area_frac=0.02, hist=[0.5, 0.5], embedding=None, lineart=None, eyes=None)
    rows = [dict(base, book_id=1, seq=1, tone=100.0, manual=False, name="", hair="#804020"),
            dict(base, book_id=1, seq=2, tone=104.0, manual=False, name="", hair="#824222"),
            dict(base, book_id=1, seq=3, tone=100.0, manual=False, name="", hair="#2040ff"),
            dict(base, book_id=1, seq=4, tone=10.0, manual=True, name="Aki", hair="#ffffff"),
            dict(base, book_id=1, seq=5, tone=10.0, manual=True, name="aki ", hair="#fefefe"),
            dict(base, book_id=1, seq=6, tone=240.0, manual=False, name="", hair="#00ff00")]
    schema = ("book_id int, seq long, tone double, aspect double, area_frac double, hist array<double>, embedding array<float>, "
              "lineart array<float>, manual boolean, name string, hair string, eyes string")
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = [(r.action, r.char_id) for r in T.run_batch(T.profile_upsert_rule(max_profiles=3), df).orderBy("seq").collect()]
    assert got == [("added", 0), ("merged", 0), ("added", 1), ("added", 2), ("merged", 2), ("refused", -1)]
