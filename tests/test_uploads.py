"""Uploads become files, each once."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import uploads


def files(path):
    return {x: (path / x).read_bytes() for x in os.listdir(path) if x != "_pending"}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, content binary").withColumn("more", F.lit(1)).repartition(3)


def test_each_upload_is_a_file_and_repeats_write_nothing(spark, tmp_path):
    rows = [("a", "x.MP4", b"123"), ("b", "y", b""), ("c", None, None), ("d", "z.mov", b"\0" * 100_000)]
    uploads.store_files(frame(spark, rows), str(tmp_path / "up"), "batch-1")
    first = files(tmp_path / "up")
    assert first == {uploads.file_name("batch-1", i, n): c or b"" for i, n, c in rows}
    assert sorted(x.rpartition(".")[2] for x in first) == ["mov", "mp4", "mp4", "mp4"]
    times = {x: (tmp_path / "up" / x).stat().st_mtime_ns for x in first}
    uploads.store_files(frame(spark, [*rows, ("e", "w.avi", b"9")]), str(tmp_path / "up"), "batch-1")
    again = files(tmp_path / "up")
    assert len(again) == 5 and all((tmp_path / "up" / x).stat().st_mtime_ns == t for x, t in times.items())
    uploads.store_files(frame(spark, rows[:1]), f"file://{tmp_path}/up", "batch-2")
    assert len(files(tmp_path / "up")) == 6 and not os.listdir(tmp_path / "up" / "_pending")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    broken = frame(spark, [("a", "x.mp4", b"1"), ("b", "y.mp4", b"2")]).withColumn(
        "content", F.when(F.col("id") == "b", F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("content"))
    )
    with pytest.raises(Exception, match="no more"):
        uploads.store_files(broken, str(tmp_path / "up"), "batch")
    # a task that was still running then may leave its own folder; no file is in place
    assert not (tmp_path / "up").exists() or files(tmp_path / "up") == {}
    uploads.store_files(frame(spark, [("a", "x.mp4", b"1")]), str(tmp_path / "up"), "batch")
    assert list(files(tmp_path / "up").values()) == [b"1"] and not os.listdir(tmp_path / "up" / "_pending")


def test_task_output_counts_only_after_the_commit(tmp_path):
    writer = uploads._Writer(str(tmp_path), "b")
    rows = [{"id": "a", "name": "x.mp4", "content": b"1"}]
    one, two = writer.write(iter(rows)), writer.write(iter(rows))  # the same task, tried twice
    assert files(tmp_path) == {} and one.folder != two.folder
    writer.commit([two, None])
    assert list(files(tmp_path).values()) == [b"1"]
    assert writer.write(iter(rows)).names == []
