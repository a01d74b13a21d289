"""Exact percentiles of large and small groups against sorting."""

import math
import random

import pytest

from chromaframe.operators.selection import exact_percentile
from chromaframe.operators.stats import percentile_normalize


def quantile(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if v[lo] == v[hi] else (1 - (at - lo)) * v[lo] + (at - lo) * v[hi]


def groups():
    rnd = random.Random(12)
    out = {"third": [rnd.gauss(0, 1) for _ in range(900)], "small": [rnd.random() for _ in range(30)], "one": [2.5],
           "equal": [7.0] * 300, "two": [1.0] * 150 + [1.0000000000000002] * 151,
           "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-300, 300) for _ in range(301)],
           "ends": [-math.inf] * 20 + [rnd.random() for _ in range(200)] + [math.inf] * 30,
           "whole": [float(rnd.randrange(256)) for _ in range(500)]}
    return out


@pytest.mark.parametrize("p", [0.0, 0.5, 0.97])
def test_equals_sorting(spark, p):
    rows = [(k, v) for k, vs in groups().items() for v in vs] + [("small", None), (None, 3.0), (None, 4.0), ("nan", math.nan)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "page_id string, v double").repartition(5)
    want = {k: quantile(vs, p) for k, vs in groups().items()} | {None: quantile([3.0, 4.0], p)}
    for small, bins in ((40, 64), (10_000, 4096)):
        got = {r.page_id: r.q for r in exact_percentile(df, ["page_id"], "v", p, "q", small, bins).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_normalised_by_an_exact_scale(spark):
    vs = groups()["third"]
    df = spark.createDataFrame([(1, i, 0, v) for i, v in enumerate(vs)] + [(2, 0, 0, 0.0)], "page_id int, x int, y int, v double")
    got = {(r.page_id, r.x): r.normalized for r in percentile_normalize(df, "v", 90.0).collect()}
    top = quantile(vs, 0.9)
    assert got[(2, 0)] == 0.0
    assert all(got[(1, i)] == pytest.approx(min(1.0, max(0.0, v / top))) for i, v in enumerate(vs))
