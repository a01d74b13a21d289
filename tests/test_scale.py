"""Distributed building blocks against plain statements, with one key holding most rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaframe import scale as S
from chromaframe.operators import graph as G
from chromaframe.operators import identity as I
from chromaframe.operators import stats as A


def _hot(n=3000, seed=1):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.6 else rnd.choice([None, "a", "b", "c"]), i, rnd.randrange(50)) for i in range(n)]


def test_rank_within_equals_row_number(spark):
    df = spark.createDataFrame(_hot(), "k string, seq long, v int")
    out = S.rank_within(df, ["k"], ["v", "seq"], F.floor(F.col("v") / 7), "rank", "total").collect()
    assert len(out) == 3000
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append(r)
    for rows in groups.values():
        want = sorted(rows, key=lambda r: (r.v, r.seq))
        assert [r["rank"] for r in want] == list(range(1, len(rows) + 1))
        assert {r.total for r in rows} == {len(rows)}


def test_measured_broadcast_has_a_bound(spark):
    big = spark.range(2000)
    assert S.measured_broadcast(big, max_rows=100) is big
    assert S.measured_broadcast(big, max_bytes=10) is big
    assert S.measured_broadcast(big) is not big


def test_join_library_salted_equals_broadcast(spark, monkeypatch):
    facts = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    lib = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    plain = sorted(map(tuple, S.join_library(facts, lib, ["k"], F.col("id"), "left").select("id", "v").collect()))
    monkeypatch.setattr(S, "measured_broadcast", lambda df, *a: df)
    salted = sorted(map(tuple, S.join_library(facts, lib, ["k"], F.col("id"), "left").select("id", "v").collect()))
    assert plain == salted and len(plain) == 500


@pytest.mark.parametrize("spread", [3, 60, 5000])
def test_closest_pair(spark, spread):
    rnd = random.Random(spread)
    rows = [(k, float(rnd.randrange(spread)), float(rnd.randrange(spread)), 0.0) for k in range(4) for _ in range(25)]
    rows += [(9, 1.0, 1.0, 1.0), (10, 0.0, 0.0, 0.0), (10, 400.0, 300.0, 0.0), (11, 5.0, 5.0, 5.0), (11, 5.0, 5.0, 5.0)]
    got = {r.k: r.min_distance for r in A.closest_pair(
        spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"], ["x", "y", "z"],
        (6.0, 24.0, 96.0, 512.0, 8192.0)).collect()}
    for k in {r[0] for r in rows}:
        pts = [r[1:] for r in rows if r[0] == k]
        want = min((math.dist(p, q) for p, q in itertools.combinations(pts, 2)), default=None)
        assert got[k] == want if want is None else abs(got[k] - want) < 1e-9


def _components(n, edges):
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return [find(v) for v in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_do_not_depend_on_order(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(0, i) for i in range(200, 260)] + [(i, i + 1) for i in range(30)]
    rnd.shuffle(edges)
    nodes = spark.range(300)
    got = {r.id: r.component for r in G.connected_components(nodes, spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()}
    assert [got[i] for i in range(300)] == _components(300, edges)


def test_cluster_boxes_with_copies(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(160):
        x, y, w, h = rnd.randrange(0, 1500, 10), rnd.randrange(0, 1500, 10), rnd.randrange(4, 60), rnd.randrange(4, 60)
        rows += [(1, 2 * i, x, y, w, h, i % 4 if i % 3 else None, w * h, 0.5, i % 5 == 0)]
        if i % 4 == 0:  # an exact copy
            rows += [(1, 2 * i + 1, x, y, w, h, i % 4 if i % 3 else None, w * h, 0.7, False)]

    def near(p, q):
        (ax, ay, aw, ah), (bx, by, bw, bh) = p[2:6], q[2:6]
        pad = max(bw, bh) * (1.05 if p[6] is not None and p[6] == q[6] else 0.72)
        hit = not (ax + aw < bx - pad or ax > bx + bw + pad or ay + ah < by - pad or ay > by + bh + pad)
        if hit or (p[6] is not None and p[6] == q[6]):
            return hit
        m = max(aw, ah, bw, bh)
        return abs(ax + aw * .5 - bx - bw * .5) <= m * 1.08 and abs(ay + ah * .5 - by - bh * .5) <= m * 0.96
    rows.sort(key=lambda r: r[1])
    edges = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near(rows[i], rows[j])]
    comp = _components(len(rows), edges)
    want = {}
    for i, c in enumerate(comp):
        want[rows[c][1]] = want.get(rows[c][1], 0) + 1
    df = spark.createDataFrame(rows, "page_id int, box_id int, x int, y int, w int, h int, parent int, area int, score double, matched boolean")
    got = {r.cluster_id: r.members for r in G.cluster_boxes(df).collect()}
    assert got == want


def test_two_nearest_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    lib = [(0, i, float(rng.integers(256)), 1.0, 0.02, [0.5, 0.5], [float(v) for v in rng.normal(size=4)], None) for i in range(300)]
    inst = [(0, i, float(rng.integers(256)), 1.2, 0.03, [0.4, 0.6], [float(v) for v in rng.normal(size=4)], None, 0.9, None) for i in range(40)]
    cols = "tone double, aspect double, area_frac double, hist array<double>, embedding array<float>, lineart array<float>"
    p = spark.createDataFrame(lib, f"book_id int, char_id int, {cols}")
    q = spark.createDataFrame(inst, f"book_id int, inst_id int, {cols}, conf double, forced int")
    got = {r.inst_id: (r.id1, r.id2) for r in I.two_nearest(q, p).collect()}

    def gap(a, b):
        hist = math.sqrt(max(0.0, 1 - sum(math.sqrt(x * y) for x, y in zip(a[5], b[5]))))
        cos = (1 - float(np.dot(a[6], b[6]) / (np.linalg.norm(a[6]) * np.linalg.norm(b[6])))) / 2
        return (0.56 * cos + 0.14 * min(1, abs(a[2] - b[2]) / 100) + 0.15 * hist + 0.10 * abs(math.log(a[3] / b[3])) / 1.7
                + 0.05 * abs(math.log(a[4] / b[4])) / 3.2)
    for i in inst:
        assert got[i[1]] == tuple(r[1] for r in sorted(lib, key=lambda r: gap(i, r))[:2])
