"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chromaframe.plans import load_all  # noqa: E402
from chromaframe.plans.registry import QUERIES  # noqa: E402
from chromaframe.session import build  # noqa: E402

HEADLINE = ("quality_report", "tone_tier_stats", "global_color_stats", "region_stats", "lock_to_target", "ring_contrast",
            "identity_match", "assign_to_owner", "points_to_regions", "compose_hints", "limit_density", "fuse_votes",
            "systematic_sample", "reading_order", "nms", "label_regions", "cluster_boxes", "unique_names", "secret_scan",
            "load_project_pages", "tone_memory", "undo_redo")
#: Timed too, but not part of the value, which stays comparable from round to round.
MORE = ("merge_tiny", "percentile_normalize", "chunk_pieces", "load_project_pieces", "status_log")


def shuffled_mb(spark, after: int) -> tuple[float, int]:
    """Megabytes written to shuffles by the stages behind one, and the last stage."""
    gateway = spark.sparkContext._gateway
    nothing = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
    done = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]
    return sum(b for i, b in done if i > after) / 1e6, max([after, *(i for i, _ in done)])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
                                                "spark.ui.retainedStages": "100000"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE[:3]:  # warm-up: the first queries would carry the compilers' start
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    moved: dict[str, float] = {}
    _, stage = shuffled_mb(spark, -1)
    for name in (*HEADLINE, *MORE):
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        mb, stage = shuffled_mb(spark, stage)
        moved[name] = round(mb, 2)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec",
                      "queries": times, "shuffle_mb": moved, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    load_all()
    main()
