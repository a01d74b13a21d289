"""The same rules as batch and as stream, late rows, and the status upsert."""

import os
import random

import pytest
from pyspark.sql import functions as F

from chromaframe.streaming import runner as R
from chromaframe.streaming import state as T
from chromaframe.streaming.log import append_latest, commits, manifest

LOG = "page_id int, seq long, kind string, payload int"


def _stream(spark, tmp_path, df, parts, schema):
    src = str(tmp_path / "in")
    for p in parts:
        df.where(p).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)


def _run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def _log(spark, n=300):
    rnd = random.Random(3)
    rows = [(rnd.randrange(5), i, rnd.choice(["edit", "edit", "undo", "redo"]), rnd.randrange(6)) for i in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_undo_stream_equals_batch(spark, tmp_path):
    df = _log(spark)
    st = _stream(spark, tmp_path, df, ["seq < 100", "seq >= 100 AND seq < 220", "seq >= 220"], LOG)
    rule = T.undo_redo_rule()
    got = _run(spark, R.stream_rule(rule, st), "undo_stream", tmp_path)
    assert got.where("late").count() == 0
    want = T.run_batch(rule, df.repartition(3))
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, want.collect()))


def test_tone_memory_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(b, lab, s, i, float(rnd.randrange(256))) for b in (1, 2) for lab in ("hair", "sky") for s in range(9) for i in range(3)]
    schema = "book_id int, label string, seq long, region_id int, mean_gray double"
    df = spark.createDataFrame(rows, schema)
    st = _stream(spark, tmp_path, df, ["seq < 4", "seq >= 4"], schema)
    rule = T.tone_memory_rule(seeds={"hair": [(200.0, "#ffffff"), (20.0, "#000000")]})
    got = _run(spark, R.stream_rule(rule, st), "tone_stream", tmp_path).drop("late")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T.run_batch(rule, df).collect()))


def test_late_rows_change_nothing(spark, tmp_path):
    df = _log(spark, 60)
    st = _stream(spark, tmp_path, df, ["seq >= 30", "seq < 30"], LOG)
    got = _run(spark, R.stream_rule(T.undo_redo_rule(), st), "late_stream", tmp_path)
    assert {r.seq for r in got.where("late").collect()} == set(range(30))
    want = T.run_batch(T.undo_redo_rule(), df.where("seq >= 30"))
    assert sorted(map(tuple, got.where("NOT late").drop("late").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_batch_result_does_not_depend_on_partitions(spark, parts):
    df = _log(spark)
    a = T.run_batch(T.undo_redo_rule(), df.repartition(parts)).collect()
    b = T.run_batch(T.undo_redo_rule(), df.orderBy(F.desc("seq"))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_a_page_may_be_cut_by_a_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = sorted((1, "hair", s, i, float(rnd.randrange(256))) for s in range(4) for i in range(5))
    schema = "book_id int, label string, seq long, region_id int, mean_gray double"
    rule = T.tone_memory_rule()
    order = sorted(range(len(rows)), key=lambda k: [dict(zip(("book_id", "label", "seq", "region_id", "mean_gray"), rows[k]))[c] for c in rule.order])
    df = spark.createDataFrame([(*rows[k], n) for n, k in enumerate(order)], schema + ", nth int")
    st = _stream(spark, tmp_path, df, ["nth < 7", "nth >= 7 AND nth < 13", "nth >= 13"], schema + ", nth int")
    got = _run(spark, R.stream_rule(rule, st), "cut_stream", tmp_path)
    assert got.where("late").count() == 0
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, T.run_batch(rule, df).collect()))


def test_status_upsert(spark, tmp_path):
    rows = [(p, s, ["done", "skipped", "error"][(p + s) % 3], f"m{s}") for s in range(30) for p in [s % 6]]
    schema = "page_id int, seq long, status string, message string"
    df = spark.createDataFrame(rows, schema)
    st = _stream(spark, tmp_path, df, ["seq < 12", "seq >= 12"], schema)
    out = str(tmp_path / "status")
    q = R.upsert_status(st, out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    last = R.read_status(spark, out)
    assert sorted(map(tuple, last.select("page_id", "status", "message", "seq").collect())) == sorted(
        map(tuple, T.page_status(df).collect()))


def test_status_log_writes_what_changed(spark, tmp_path):
    out, schema = str(tmp_path / "log"), "page_id int, seq long, status string, message string"
    first = [(p, 0, "done", "first") for p in range(500)]
    later = [[(7, s, "error", f"m{s}"), (1000 + s, s, "done", None), (7, s - 1, "done", "older")] for s in range(1, 8)]
    put = lambda rows, n: append_latest(spark.createDataFrame(rows, schema), out, n, T.page_status, buckets=2, fan=3)
    want = {}
    for n, rows in enumerate([first, *later]):
        put(rows, n)
        if n in (3, 5):
            put(rows, n)  # a batch that is run again
        for p, s, status, message in rows:
            if p not in want or want[p][1] <= s:
                want[p] = (p, s, status, message)
        got = R.read_status(spark, out).select("page_id", "seq", "status", "message").collect()
        assert sorted(map(tuple, got)) == sorted(want.values())
        sizes = {r["name"]: r["rows"] for r in manifest(spark, out, n)}
        assert sizes.get(f"delta-{n}", 2) == (500 if n == 0 else 2) and len(sizes) <= 3
        kept = {d for d in os.listdir(out) if not d.startswith(".")} - {"manifest"}
        before = {r["name"] for r in manifest(spark, out, n - 1)} if n else set()
        assert kept == set(sizes) | before and commits(spark, out) == ([n - 1, n] if n else [0])
    append_latest(spark.createDataFrame([], schema), out, 8, T.page_status, buckets=2, fan=3)
    assert R.read_status(spark, out).count() == len(want)
