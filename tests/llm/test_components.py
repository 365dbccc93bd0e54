"""Connected components against a plain walk, and what small tables cost."""
import random

import pytest

from tapeworks.llm.components import components


@pytest.mark.parametrize("max_broadcast", [0, 1000])
def test_components_reach_the_smallest_node(spark, max_broadcast):
    rng = random.Random(3)
    links = [(rng.randint(-50, 300), rng.randint(-50, 300)) for _ in range(120)] + [(k, k + 1) for k in range(400, 470)] + [(-k, 500) for k in range(100, 160)] + [(600, 600)]
    near: dict[int, set[int]] = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        new = [x] if x not in want else []
        while new:
            y = new.pop()
            want[y] = x
            new += [z for z in near[y] if z not in want]
    got = components(spark.createDataFrame(links, "a long, b long"), max_broadcast)
    assert {r.node: r.component for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), max_broadcast).count() == 0


def test_small_tables_take_few_tasks(spark):
    sc, parts, packs = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set(packs, "false")
    sc.setJobGroup("few-tasks", "")
    try:
        assert components(spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")).where("component = 0").count() == 65
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few-tasks")]
        stages = {s: sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds}
        done = sum(s.numCompletedTasks for s in stages.values() if s)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset(packs)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < done < 1000
