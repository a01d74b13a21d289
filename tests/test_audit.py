"""Planted findings in awkward places, and the verdict of the gate."""

from chromaframe.operators import audit as X
from chromaframe.operators.stats import closest_pair
from chromaframe.operators.windows import crop_boxes, nms
from chromaframe.sources.files import unique_names

TOKEN = "ghp_" + "a" * 30


def test_whole_texts_are_scanned(spark):
    rows = [(1, "x" * (11 << 20) + " " + TOKEN), (2, "\u0000bin " + TOKEN), (3, None), (4, "clean"), (5, "line\n/home/artist/x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.category) for r in X.secret_scan(df, "doc_id", "text").collect()} == {(1, "GitHub token"), (2, "GitHub token")}
    assert {(r.doc_id, r.line) for r in X.home_path_scan(df, "doc_id", "text").collect()} == {(5, 2)}
    cover = X.scan_coverage(df, "text").first()
    assert (cover.documents, cover.without_text, cover.scanned) == (5, 1, 4)


def test_gate_with_defaults(spark):
    df = spark.createDataFrame([(1, "-----BEGIN PRIVATE KEY-----"), (2, TOKEN), (3, "/home/artist/x")], "doc_id long, text string")
    found = X.audit_findings(("doc_id", X.secret_scan(df, "doc_id", "text"), "category"), ("doc_id", X.home_path_scan(df, "doc_id", "text"), "category"))
    got = {r.category: (r.findings, r.severity, r.passed) for r in X.audit_gate(found).collect()}
    assert got == {"private-key": (1, "fatal", False), "github-token": (1, "fatal", False), "possible-local-home": (1, "fatal", False), "(all)": (3, "fatal", False)}
    assert [tuple(r) for r in X.audit_gate(found.limit(0)).collect()] == [("(all)", 0, "none", True)]
    odd = spark.createDataFrame([("a", "new kind", "d"), ("b", "oversized-uninspected", "d")], "place string, category string, detail string")
    assert {r.category: r.severity for r in X.audit_gate(odd).collect()} == {"new kind": "fatal", "oversized-uninspected": "warning", "(all)": "fatal"}


def test_history_paths(spark):
    paths = ["a/credentials.json", "a/Secret", "models/x.PTH", "models/a/x.pth", "generator.zip", "x.ccstyle", "secretary.md", "a/.environment", "weights/x.bin"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {(r.path, r.rule) for r in X.history_path_policy(df, "path").collect()}
    assert got == {("a/credentials.json", "sensitive-history-path"), ("a/Secret", "sensitive-history-path"), ("x.ccstyle", "sensitive-history-path"),
                   ("models/x.PTH", "checkpoint-in-history"), ("generator.zip", "checkpoint-in-history")}


def test_error_payload_after_blanks_and_far_words(spark):
    blank = " " * 5000
    rows = [(1, blank + "<html>"), (2, "{" + "x" * 1100 + "error"), (3, ""), (4, None), (5, blank)]
    df = spark.createDataFrame(rows, "id int, body string")
    got = {r.id: r.why for r in df.select("id", X.error_payload("body").alias("why")).collect()}
    assert got == {1: "web page", 2: None, 3: "empty", 4: "empty", 5: None}
    assert df.where("id = 2").select(X.error_payload("body", None).alias("why")).first().why == "json error"


def test_unique_names_with_overlapping_stems(spark):
    taken = spark.createDataFrame([("f", "a.png"), ("f", "b_2.png"), ("f", "b.png"), ("f", "c_2_2.png")], "folder string, name string")
    rows = [("f", "a.png", ".png", 1), ("f", "b", ".png", 2), ("f", "b", ".png", 3), ("f", "c_2", ".png", 4), ("f", "c_2", ".png", 5), ("f", "c", ".png", 6), ("f", "c", ".png", 7)]
    got = {r.seq: r.name for r in unique_names(spark.createDataFrame(rows, "folder string, stem string, ext string, seq long"), taken).collect()}
    assert got == {1: "a.png.png", 2: "b_3.png", 3: "b_4.png", 4: "c_2.png", 5: "c_2_3.png", 6: "c.png", 7: "c_3.png"}


def test_closest_pair_beyond_the_last_reach(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 2000.0, 0.0), (1, 9000.0, 0.0), (2, 5.0, 5.0)], "k int, x double, y double")
    assert {r.k: r.min_distance for r in closest_pair(df, ["k"], ["x", "y"]).collect()} == {1: 2000.0, 2: None}


def test_many_boxes_on_one_page(spark):
    side = [(1, i, (i % 80) * 10, (i // 80) * 10, 9, 9, float(i % 7)) for i in range(5000)]
    df = spark.createDataFrame(side, "page_id int, box_id long, x int, y int, w int, h int, score double")
    assert nms(df, cap=None).count() == 5000 and nms(df).count() == 32
    pages = spark.createDataFrame([(1, 300, 300)], "page_id int, page_w int, page_h int")
    assert crop_boxes(df.withColumnRenamed("score", "ord"), pages).count() == 5000


def test_suppression_equals_greedy(spark):
    import random

    rng = random.Random(8)
    rows = [(p, i, rng.randrange(300), rng.randrange(300), rng.randrange(5, 90), rng.randrange(5, 90), rng.randrange(9) / 8) for p in range(3) for i in range(150)]
    df = spark.createDataFrame(rows, "page_id int, box_id long, x int, y int, w int, h int, score double")

    def iou(a, b):
        w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        both = max(0, w) * max(0, h)
        return both / (a[4] * a[5] + b[4] * b[5] - both)
    for limit, cap in ((0.28, 32), (0.0, None), (0.72, None)):
        want = set()
        for p in range(3):
            kept = []
            for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], -r[4] * r[5], r[1])):
                if (cap is None or len(kept) < cap) and all(iou(r, k) <= limit for k in kept):
                    kept.append(r)
            want |= {(p, r[1]) for r in kept}
        assert {(r.page_id, r.box_id) for r in nms(df, max_iou=limit, cap=cap).collect()} == want
