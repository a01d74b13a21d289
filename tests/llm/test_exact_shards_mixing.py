import hashlib
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chromaframe.llm.exact import exact_groups, keep_one
from chromaframe.llm.mixing import mix_styles
from chromaframe.llm.shards import shard_pages

PROJECT = "project_id long, body string, keep_id string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(1)
    bodies = ["", None, "Äpage", "äpage", "PAGE one", "page ONE", "x" * 200_000, "X" * 200_000, "K", "k", "same start " * 3 + "a", "same start " * 3 + "b"]
    rows = [(i, rng.choice(bodies), "n") for i in range(300)] + [(1000 + i, "hot Body", "n") for i in range(900)]
    df = spark.createDataFrame(rows, PROJECT).repartition(6)
    groups = defaultdict(list)
    for i, b, _ in rows:
        groups[low(b)].append(i)
    for keep, best in (("first", min), ("last", max)):
        want = {(i, best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
        assert {tuple(r) for r in exact_groups(df, keep=keep).collect()} == want
        kept = keep_one(df, keep=keep)
        assert kept.columns == df.columns and sorted(r.project_id for r in kept.collect()) == sorted(best(g) for g in groups.values())


def test_exact_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "n"), (1, "A", "n"), (1, "a", "n"), (None, "b", "n"), (2, "b", "n")], PROJECT)
    got = exact_groups(df).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {3, 2}
    assert {r.keep_id for r in got if r.group_size == 2} == {None}
    assert keep_one(df).count() == 2
    empty = spark.createDataFrame([], PROJECT)
    assert exact_groups(empty).count() == 0 and keep_one(empty).count() == 0


def test_shards(spark):
    df = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("x").alias("shard")).unionByName(
        spark.createDataFrame([(None, "y"), (5, "y")], "page_id long, shard string"))
    got = shard_pages(df, weights=(1.0,) * 16, grown_weights=(1.0,) * 17, slot_buckets=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert len(got) == 6002 and set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r.shard for r in got if r.page_id == 5}) == 1
    moved = sum(r.grown_shard == 16 for r in got)
    assert abs(moved - 6000 / 17) < 100 and all(abs(len(s) - 375) < 100 for s in by.values())
    heavy = Counter(r.shard for r in shard_pages(df, weights=(3.0, 1.0, 0.0)).collect())
    assert abs(heavy[0] / heavy[1] - 3) < 0.4 and 2 not in heavy
    assert shard_pages(df.limit(0)).count() == 0


def poisson(lam, u):
    n, p, c = 0, math.exp(-lam), math.exp(-lam)
    while u >= c and n < 64:
        n += 1
        p *= lam / n
        c += p
    return n


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2 ** 52


def test_mixing_against_brute_force(spark):
    rows = [(i, "big" if i % 10 else "small", f"d{i}", 7) for i in range(2000)] + [(5000, None, None, 7), (5000, None, "x", 7)]
    df = spark.createDataFrame(rows, "style_key long, source string, description string, copy int")
    weights, sizes = {"big": 1.0, "small": 3.0}, Counter(r[1] for r in rows)
    sums = 1.0 + 3.0 + 0.5
    want = Counter()
    for key, source, text, _ in rows:
        lam = weights.get(source, 0.5) / sums * len(rows) / sizes[source]
        parts = max(1, math.ceil(lam / 8))
        for copy in range(sum(poisson(lam / parts, unit(17, key, j)) for j in range(1, parts + 1))):
            want[(key, source, text, copy, hashlib.md5(f"17-place:{key}:{copy}".encode()).hexdigest()[:16])] += 1
    got = mix_styles(df, weights, 0.5)
    assert Counter((r.style_key, r.source, r.description, r.copy, r.place) for r in got.collect()) == want
    assert abs(sum(n for k, n in want.items() if k[1] == "small") / len(rows) - 3 / sums) < 0.07
    places = [r.place for r in got.collect()]
    assert places == sorted(places)
    assert mix_styles(df, {"big": 0.0}, 0.0).count() == 0 and mix_styles(df.limit(0), weights).count() == 0
