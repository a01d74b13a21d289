"""Region merging, components and palettes: parity on chain-free input and invariants."""

import random

from pyspark.sql import functions as F

from chromaframe.operators import graph as G
from chromaframe.operators import stats as A
from chromaframe.operators import windows as W


def _grid(spark, rows):
    cells = [(1, x, y, v) for y, line in enumerate(rows) for x, v in enumerate(line)]
    return spark.createDataFrame(cells, "page_id int, x int, y int, region_id int")


def _picture(df):
    out = {}
    for r in df.collect():
        out[(r.x, r.y)] = r.region_id
    return out


def test_merge_tiny_without_chains(spark):
    rows = [[1, 1, 1, 1, 2, 2, 2, 2],
            [1, 1, 5, 1, 2, 2, 2, 2],
            [1, 1, 1, 1, 2, 7, 7, 2],
            [1, 1, 1, 1, 0, 0, 2, 2],
            [3, 3, 3, 3, 3, 3, 3, 3]]
    got = _picture(G.merge_tiny(_grid(spark, rows), max_area=3))
    # 5 joins 1, 7 joins 2 (most contact); ids turn dense and 0 stays 0.
    for (x, y), v in got.items():
        old = {5: 1, 7: 2}.get(rows[y][x], rows[y][x])
        assert v == old, (x, y)


def _merged_one_by_one(rows, max_area, max_rounds):
    """The rule as it is told: fragments in id order, each looking at the map as it then is."""
    grid = [list(r) for r in rows]
    h, w = len(grid), len(grid[0])

    def around(rid):
        found = {}
        for y in range(h):
            for x in range(w):
                if grid[y][x] > 0 and grid[y][x] != rid and any(
                        0 <= y + b < h and 0 <= x + a < w and grid[y + b][x + a] == rid for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))):
                    found[grid[y][x]] = found.get(grid[y][x], 0) + 1
        return found

    def tiny():
        flat = [v for r in grid for v in r if v > 0]
        return [v for v in sorted(set(flat)) if flat.count(v) <= max_area]
    for _ in range(max_rounds):
        changed = False
        for rid in tiny():
            near = around(rid)
            if near:
                to = min(near, key=lambda k: (-near[k], k))
                grid = [[to if v == rid else v for v in r] for r in grid]
                changed = True
        if not changed:
            break
    settled = not any(around(r) for r in tiny())
    dense = {v: i for i, v in enumerate(sorted({v for r in grid for v in r if v > 0}), 1)}
    return {(x, y): dense.get(v, 0) for y, r in enumerate(grid) for x, v in enumerate(r)}, settled


def test_merge_tiny_follows_chains(spark):
    rnd, want, cells = random.Random(17), {}, []
    for page, (top, blanks) in enumerate(((16, 0), (7, 3), (12, 1), (4, 0))):
        rows = [[0 if rnd.randrange(20) < blanks else rnd.randrange(1, top) for _ in range(7)] for _ in range(5)]
        if page == 3:  # ids in reading order: every fragment waits for the one before
            rows = [[y * 4 + x + 1 for x in range(4)] for y in range(2)]
        want[page] = rows
        cells += [(page, x, y, v) for y, r in enumerate(rows) for x, v in enumerate(r)]
    df = spark.createDataFrame(cells, "page_id int, x int, y int, region_id int").repartition(5)
    for rounds in (1, 3):
        got = {}
        for r in G.merge_tiny(df, 3, rounds).collect():
            got.setdefault(r.page_id, {})[(r.x, r.y)] = (r.region_id, r.settled)
        for page, rows in want.items():
            picture, settled = _merged_one_by_one(rows, 3, rounds)
            assert {k: v[0] for k, v in got[page].items()} == picture
            assert {v[1] for v in got[page].values()} == {settled}


def test_points_snap_like_a_full_search(spark):
    from chromaframe.operators import spatial as S
    rnd = random.Random(4)
    cells = [(p, x, y, rnd.choice([0] * 30 + [1, 2, 3]) if x % 50 < 35 else 0) for p in (1, 2) for y in range(40) for x in range(130)]
    points = [(rnd.choice((1, 2)), i, rnd.randrange(-3, 140), rnd.randrange(-2, 44)) for i in range(150)]
    got = {r.point_id: r.region_id for r in S.points_to_regions(spark.createDataFrame(points, "page_id int, point_id int, x int, y int"),
                                                                spark.createDataFrame(cells, "page_id int, x int, y int, region_id int")).collect()}
    for page, i, x, y in points:
        at = {(a, b): v for p, a, b, v in cells if p == page}
        want = at.get((x, y), -1)
        if want <= 0:
            dist = {}
            for (a, b), v in at.items():
                if v > 0 and abs(a - x) <= 24 and abs(b - y) <= 24:
                    dist[v] = min(dist.get(v, 10 ** 9), (a - x) ** 2 + (b - y) ** 2)
            near = [v for v, d in dist.items() if d <= min(dist.values()) + 4] if want == 0 else []
            want = min(near, key=lambda v: (sum(1 for q in at.values() if q == v), v)) if near else 0
        assert got[i] == want, (page, x, y)


def test_box_clusters_equal_pairwise_links(spark):
    rnd, rows = random.Random(31), []
    for page in (1, 2, 3):
        for i in range(140):
            scale = rnd.choice([2, 2, 7, 30, 120]) if page < 3 else 3
            x, y = (rnd.randrange(2600), rnd.randrange(2600)) if page == 1 else (rnd.choice([100, 130, 900, 1500]) + rnd.randrange(60), rnd.choice([50, 400, 900]) + rnd.randrange(60))
            rows.append((page, i, x, y, 1 + rnd.randrange(scale), 1 + rnd.randrange(scale), rnd.choice([None, None, 1, 2])))
    rows += [(2, 500 + i, 105, 55, 3, 3, None) for i in range(60)]  # equal boxes
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id int, box_id int, x int, y int, w int, h int, parent int").repartition(4)
    got = {(r.page_id, r.box_id): r.cluster_id for r in G.box_clusters(df).collect()}

    def near(p, q):
        pad = max(q[4], q[5]) * (1.05 if p[6] is not None and p[6] == q[6] else 0.72)
        if not (p[2] + p[4] < q[2] - pad or p[2] > q[2] + q[4] + pad or p[3] + p[5] < q[3] - pad or p[3] > q[3] + q[5] + pad):
            return True
        big = max(p[4], p[5], q[4], q[5])
        dx, dy = abs(p[2] + p[4] * 0.5 - q[2] - q[4] * 0.5), abs(p[3] + p[5] * 0.5 - q[3] - q[5] * 0.5)
        return not (p[6] is not None and p[6] == q[6]) and dx <= big * 1.08 and dy <= big * 0.96
    want = {}
    for page in (1, 2, 3):
        own = sorted(r for r in rows if r[0] == page)
        root = {r[1]: r[1] for r in own}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a
        for i, p in enumerate(own):
            for q in own[i + 1:]:
                if near(p, q):
                    a, b = sorted((find(p[1]), find(q[1])))
                    root[b] = a
        want |= {(page, r[1]): find(r[1]) for r in own}
    assert got == want


def test_merge_tiny_invariants(spark):
    rnd = random.Random(5)
    rows = [[rnd.randrange(1, 40) for _ in range(14)] for _ in range(14)]
    df = _grid(spark, rows)
    got = G.merge_tiny(df, max_area=6)
    sizes = {r.region_id: r["count"] for r in got.groupBy("region_id").count().collect()}
    assert sum(sizes.values()) == 196 and sorted(sizes) == list(range(1, len(sizes) + 1))
    owner = {}
    new = _picture(got)
    for y, line in enumerate(rows):
        for x, v in enumerate(line):
            assert owner.setdefault(v, new[(x, y)]) == new[(x, y)]  # old regions never split


def test_label_regions_is_a_partition_of_the_fill(spark):
    rnd = random.Random(8)
    cells = [(p, x, y, int(rnd.random() < 0.6)) for p in (1, 2) for y in range(12) for x in range(12)]
    df = spark.createDataFrame(cells, "page_id int, x int, y int, fillable int")
    got = {(r.page_id, r.x, r.y): (r.root_y, r.root_x) for r in G.label_regions(df.repartition(6)).collect()}
    fill = {c[:3] for c in cells if c[3]}
    assert set(got) == fill
    for p, x, y in fill:
        for q in ((p, x + 1, y), (p, x, y + 1)):
            if q in fill:
                assert got[(p, x, y)] == got[q]
    assert all((k[0], v[1], v[0]) in fill and got[(k[0], v[1], v[0])] == v for k, v in got.items())


def test_empty_inputs(spark):
    none = _grid(spark, [[0, 0], [0, 0]])
    assert _picture(G.merge_tiny(none)) == {(x, y): 0 for x in (0, 1) for y in (0, 1)}
    assert G.region_adjacency(none).count() == 0
    blank = none.withColumn("fillable", F.lit(0))
    assert G.label_regions(blank).count() == 0
    boxes = spark.createDataFrame([], "page_id int, box_id int, x int, y int, w int, h int, score double")
    assert W.nms(boxes).count() == 0


def test_palettes(spark):
    rnd = random.Random(3)
    base = [(200, 30, 30), (30, 200, 40), (40, 40, 210)]
    rows = [(1, i, 0, *[max(0, min(255, c + rnd.randrange(-4, 5))) for c in base[0 if i < 500 else 1 if i < 800 else 2]]) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id int, x int, y int, r int, g int, b int")
    corpus = A.corpus_palette(df, 3).orderBy("rank").collect()
    assert sum(r.pixels for r in corpus) == 900 and [r["rank"] for r in corpus] == list(range(1, len(corpus) + 1))
    assert [r.pixels for r in corpus] == sorted((r.pixels for r in corpus), reverse=True)
    page = A.page_palettes(df, max_colors=3).orderBy("rank").collect()
    assert [r.pixels for r in page] == [500, 300, 100]
    near = lambda h, c: all(abs(int(h[1 + 2 * i:3 + 2 * i], 16) - c[i]) <= 6 for i in range(3))
    assert all(near(r.color, c) for r, c in zip(page, base))
    best = A.score_clusters(spark.createDataFrame(page).withColumn("page_id", F.lit(1)), ["page_id"], prefer_dark=False).first()
    assert near(best.color, base[0])


def test_clusters_equal_sequential_steps(spark):
    """Weighted steps over colour counts against plain steps over every pixel."""
    rnd = random.Random(11)
    rows = []
    for page, n, spread in ((1, 700, 256), (2, 300, 6), (3, 64, 256), (4, 16, 40), (5, 15, 256), (6, 400, 1)):
        rows += [(page, *[rnd.randrange(spread) for _ in range(3)]) for _ in range(n)]
    want = {}
    for page in sorted({r[0] for r in rows}):
        pts = sorted(r[1:] for r in rows if r[0] == page)
        if len(pts) < 16:
            continue
        gap = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
        centers = [tuple(sum(p[i] for p in pts) / len(pts) for i in range(3))]
        k = max(1, min(4, len(pts) // 64))
        for _ in range(k):
            centers.append(max(pts, key=lambda p: (min(gap(p, c) for c in centers), [-v for v in p])))
        centers = centers[1:]
        for _ in range(25):
            owner = [min(range(k), key=lambda i: (gap(p, centers[i]), i)) for p in pts]
            fresh = []
            for i in range(k):
                own = [p for p, o in zip(pts, owner) if o == i]
                fresh.append(tuple(sum(p[j] for p in own) / len(own) for j in range(3)) if own else centers[i])
            moved = max(abs(a - b) for f, c in zip(fresh, centers) for a, b in zip(f, c))
            centers = fresh
            if moved < 0.5:
                break
        want |= {(page, i): ("#%02x%02x%02x" % tuple(int(v) for v in centers[i]), owner.count(i)) for i in range(k) if i in owner}
    df = spark.createDataFrame(rows, "page_id int, r int, g int, b int")
    for parts in (1, 7):
        rows = A.color_clusters(df.repartition(parts), "page_id", 4).collect()
        assert {(r.page_id, r.cluster): (r.color, r.pixels) for r in rows} == want
    cut = A.color_clusters(df.where("page_id = 1"), "page_id", 4, rounds=1).collect()
    assert {r.settled for r in cut} == {False} and {r.settled for r in A.color_clusters(df.where("page_id = 6"), "page_id", 4).collect()} == {True}
