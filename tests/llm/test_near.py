"""What the near-copies stage costs, and its one row of each node."""

import random

from pyspark.sql import functions as F

from stopwise.llm import common, near

MANY = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_small_tables_make_few_tasks(spark):
    """Each task leaves files: small tables of many partitions once filled the disk by their number, not by their rows."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(60)) for _ in range(12)]
    texts += [f"{t} end" for t in texts[:6]] + texts[6:]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    before = {k: spark.conf.get(k) for k in MANY}
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    try:
        for k, v in MANY.items():
            spark.conf.set(k, v)
        sc.setJobGroup("near", "near copies")
        kept = sorted(r.doc_id for r in near.keep_one(frame).collect())
        stages = {s for j in tracker.getJobIdsForGroup("near") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == list(range(12))
    assert 0 < tasks < 1800


def test_one_row_of_each_node_however_many_nodes_repeat(spark, monkeypatch):
    """Beyond the bound of broadcasts the same rows are kept by shuffled joins."""
    texts = [f"alpha beta gamma delta epsilon {k % 7} zeta" for k in range(40)] + [None, "", " "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [*range(7), 40]
    assert sorted(r.doc_id for r in near.keep_one(frame).collect()) == want
    for module in (near, common):
        monkeypatch.setattr(module, "SMALL_ROWS", 3)
    assert sorted(r.doc_id for r in near.keep_one(frame).collect()) == want


def test_cut_counted_counts_and_packs(spark):
    rows, n = common.cut_counted(spark.range(100).repartition(16))
    assert n == 100 and rows.rdd.getNumPartitions() == 1
    assert sorted(r.id for r in rows.collect()) == list(range(100))
    none, n = common.cut_counted(spark.range(100).where(F.col("id") < 0))
    assert n == 0 and none.count() == 0
