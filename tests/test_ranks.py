"""Ranks over all rows by a distributed prefix sum; chunks of nested frames."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, rollups, training


@pytest.mark.parametrize("n", [0, 1, 1000])
@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_equal_sorted_places(spark, n, parts):
    r = random.Random(n)
    rows = [(r.randint(0, 50), k) for k in range(n)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for bound in (0, 10_000):
            got, count = ranks.numbered(df, "a", "b", in_one=bound)
            assert count == n and got.columns == ["a", "b", "_rank"]
            assert [(x.a, x.b) for x in sorted(got.collect(), key=lambda x: x._rank)] == sorted(rows)
            assert sorted(x._rank for x in got.collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_task_ranks_all_rows(spark, monkeypatch):
    laid, real = [], ranks.written
    monkeypatch.setattr(ranks, "written", lambda df, name: laid.append(real(df, name)) or laid[0])
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ranks.numbered(spark.range(4000).select(F.hash("id").alias("k"), "id"), "k", "id", in_one=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[0] for r in laid[0].groupBy(F.shiftright("_id", 33)).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_splits_don_t_depend_on_the_way(spark, monkeypatch):
    samples = spark.createDataFrame([(f"v{k % 57}", k) for k in range(500)], "video string, k int")
    shown = lambda: [sorted(map(tuple, f(samples, "video").collect())) for f in (training.group_split, training.kfold)]
    one = shown()
    monkeypatch.setattr(ranks, "IN_ONE", 0)
    assert shown() == one
    assert {s for *_, s in one[0]} == {"test", "val", "train"} and {f for *_, f in one[1]} == set(range(5))


def test_nested_frames_come_in_chunks(spark):
    rows = [(1, "stomach" if k % 3 else "esophagus", k, k / 2, k % 4, 0.5) for k in range(100)]
    df = spark.createDataFrame(rows, "analysis_id int, region string, frame_index long, timestamp double, score int, confidence double").repartition(5)
    got = {(r.region, r.chunk): [x.frame_index for x in r.frame_scores] for r in rollups.region_frames(df, 20).collect()}
    for region in ("stomach", "esophagus"):
        own = [k for _, s, k, *_ in rows if s == region]
        chunks = [got[region, c] for c in range(-(-len(own) // 20))]
        assert sum(chunks, []) == own and all(len(c) == 20 for c in chunks[:-1])
    assert sum(map(len, got.values())) == 100
