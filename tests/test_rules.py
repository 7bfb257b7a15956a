"""Scalar rules and ordered logic against fixed values and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import plugins
from tidemark.functions import scalars as S
from tidemark.operators import frames, jobs, rollups, series, sessions, training, validation


def values(spark, expr, data, ddl="x double"):
    df = spark.createDataFrame([(x,) for x in data], ddl)
    return [r[0] for r in df.select(expr).collect()]


def test_display(spark):
    """At the edges of the rules: a minute, an hour, a unit of size, half a percent."""
    x = F.col("x")
    assert values(spark, S.duration_text(x), [59.999, 60.0, 3599.0, 3600.0]) == ["0:59", "1:00", "59:59", "60:00"]
    assert values(spark, S.percent_text(x), [0.0, 0.004, 0.005, 0.333]) == ["0%", "0%", "1%", "33%"]
    assert values(spark, S.timestamp_text(x), [9.04, 60.0, 119.5]) == ["0:09.0", "1:00.0", "1:59.5"]
    sizes = [0, 1023, 1024, 1024**2 - 1, 1024**2, 3 * 1024**3]
    assert values(spark, S.size_text(x), sizes, "x bigint") == ["0 B", "1023 B", "1.0 KB", "1024.0 KB", "1.0 MB", "3.0 GB"]
    assert values(spark, S.label(x), [-1, *S.LABELS, 7], "x int") == [None, *S.LABELS.values(), None]


def test_regions_and_sampling(spark):
    ratios = [0.0, 0.1999, 0.2, 0.6999, 0.7, 1.0, 1.5]
    df = spark.createDataFrame([(200.0 * r, 200.0) for r in ratios] + [(7.0, None), (7.0, -1.0)], "t double, d double")
    got = [r[0] for r in df.select(S.region_by_progress(F.col("t"), F.col("d"))).collect()]
    want = [S.REGIONS[0 if r < 0.2 else 1 if r < 0.7 else 2] for r in ratios]
    assert got == [*want, "stomach", "stomach"]
    assert values(spark, S.sampling_interval(F.col("x")), [60.0, 25.0, 4.1, 3.9, 1.0]) == [30, 12, 2, 1, 1]


def test_video_heads(spark):
    """A signature counts where it stands at its own place, whatever follows."""
    r = random.Random(4)
    pad = lambda n: r.randbytes(n).hex()
    good = [pad(4) + validation.FTYP + pad(k) for k in (0, 9)] + [m + pad(k) for m in (validation.RIFF, validation.EBML) for k in (0, 4)]
    bad = [validation.FTYP + "00" * 8, "00" * 3 + validation.FTYP, "00" + validation.RIFF, validation.EBML[:6], "00" * 4 + validation.FTYP[:6], "ab" * 12]
    assert values(spark, validation.is_video_file(F.unhex("x")), good + bad, "x string") == [True] * len(good) + [False] * len(bad)


def test_paths_are_resolved(spark):
    import posixpath

    r = random.Random(5)
    paths = ["/" + "/".join(r.choice(["data", "uploads", "..", ".", "", "x", "..x"]) for _ in range(r.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for p, own, inside in df.select("p", validation.resolved(F.col("p")), validation.confined(F.col("p"), "/data/uploads")).collect():
        want = "/" + posixpath.normpath(p).lstrip("/")
        assert own == want and inside == want.startswith("/data/uploads/")


def test_job_transitions(spark, tmp_path):
    from tidemark.sources import files

    path = str(tmp_path / "log")
    log = lambda: files.job_events(spark, path)
    add = lambda events: files.append_events(events, path)
    state = lambda: {r.job_id: (r.status, r.retry_count, r.progress, r.error) for r in jobs.current(log()).collect()}
    uploads = spark.createDataFrame([("b", 2), ("a", 1)], "id string, k int").withColumn("at", F.timestamp_seconds(F.col("k")))
    add(jobs.enqueued(uploads, "id", "at"))
    assert state() == dict.fromkeys("ab", ("queued", 0, 0.0, None))
    add(jobs.claimed(log()))
    add(jobs.advanced(log(), spark.createDataFrame([("a", 0.25), ("a", 7.0)], "job_id string, progress double")))
    assert state()["a"] == ("processing", 0, 0.25, None)
    lost = spark.createDataFrame([("a", "disk"), ("b", "not running")], "job_id string, error string")
    add(jobs.failed(log(), lost))
    assert state()["a"] == ("queued", 1, 0.25, "disk") and state()["b"][0] == "queued"
    add(jobs.claimed(log(), slots=2))
    add(jobs.completed(log(), spark.createDataFrame([("b", "{}", "{}")], "job_id string, results string, metadata string")))
    assert state() == {"a": ("processing", 1, 0.25, "disk"), "b": ("completed", 0, 1.0, None)}
    assert jobs.claimed(log()).isEmpty() and jobs.failed(log().limit(0), lost).isEmpty()


def test_flow_motion(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.1), (2.0, 1.5), (2.0, -1.5)], "m double, v double")
    got = [r[0].direction for r in df.select(S.flow_motion(F.col("m"), F.col("v"))).collect()]
    assert got == ["stationary", "stationary", "insertion", "withdrawal"]


def test_usage(spark):
    df = spark.createDataFrame([(8, -1), (8, 0), (8, 10), (20, 10)], "n int, m int")
    assert [r[0] for r in df.select(S.usage_percent(F.col("n"), F.col("m"))).collect()] == [0.0, 100.0, 80.0, 100.0]


def plain_segments(rows):
    """rows: (t, direction or None, percent), in order."""
    directions = [d or "stationary" for _, d, _ in rows]
    out, begin = [], 0
    for i in range(1, len(rows)):
        if directions[i] != directions[i - 1]:
            total = sum(p or 0 for _, _, p in rows[max(0, i - 5) : i])
            out.append((rows[begin][0], rows[i][0], directions[i - 1], int(total / max(1, min(5, i)) + 0.5)))
            begin = i
    return [*out, (rows[begin][0], rows[-1][0], directions[begin], 85)]


def segments_of(spark, series_rows):
    data = [(v, k, t, d, p) for v, rows in enumerate(series_rows) for k, (t, d, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "analysis_id int, frame_index bigint, timestamp double, direction string, conf_pct bigint")
    out = [[] for _ in series_rows]
    for r in sorted(series.motion_segments(df).collect(), key=lambda r: (r.analysis_id, r.segment)):
        out[r.analysis_id].append((r.start_time, r.end_time, r.direction, r.confidence))
    return out


def test_segments(spark):
    known = [(float(t), d, p) for t, (d, p) in enumerate(zip("AABBBBBBA", [50, 60, 70, 80, 90, 70, 60, 80, 50], strict=True))]
    one = [(0.0, "insertion", 90)]
    r = random.Random(2)
    drawn = [[(float(t), r.choice(["a", "b", None]), r.randint(50, 99)) for t in range(r.randint(1, 40))] for _ in range(20)]
    drawn = [[(t, d, p if d else None) for t, d, p in rows] for rows in drawn]
    got = segments_of(spark, [known, one, *drawn])
    assert got[0] == [(0.0, 2.0, "A", 55), (2.0, 8.0, "B", 76), (8.0, 8.0, "A", 85)]
    assert got[1] == [(0.0, 0.0, "insertion", 85)]
    assert got[2:] == [plain_segments(rows) for rows in drawn]


def test_consensus(spark):
    rows = [(1, k, d, p) for k, (d, p) in enumerate([("i", 60), ("i", 60), ("i", 60), ("i", 59), ("stationary", 90)])]
    df = spark.createDataFrame(rows, "analysis_id int, frame_index bigint, direction string, conf_pct int")
    got = [r.consensus for r in series.consensus(df).orderBy("frame_index").collect()]
    assert got == ["stationary", "stationary", "i", "stationary", "stationary"]


def test_smoothing_equals_the_recurrence(spark):
    r = random.Random(1)
    data = [(v, k, [r.random() for _ in range(3)]) for v in range(2) for k in range(400)]
    df = spark.createDataFrame([(9, 0, [1.0, 0.0]), (9, 1, [0.0, 1.0])], "analysis_id int, frame_index bigint, p array<double>")
    assert series.smoothed(df, "p").orderBy("frame_index").collect()[1].smoothed == pytest.approx([0.7, 0.3])
    got = {(x.analysis_id, x.frame_index): x.smoothed for x in series.smoothed(spark.createDataFrame(data, df.schema), "p").collect()}
    for v in range(2):
        s = None
        for w, k, p in data:
            if w == v:
                s = p if s is None else [0.3 * a + 0.7 * b for a, b in zip(p, s, strict=True)]
                assert got[v, k] == pytest.approx(s, abs=1e-13)


def test_nearest(spark):
    entries = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, 2, 3), (1, 3, 9)], "analysis_id int, frame_index bigint, t_us bigint")
    cursors = spark.createDataFrame([(1, k, t) for k, t in enumerate([2, 0, 3, 7, 50, 6])], "analysis_id int, cursor bigint, t_us bigint")
    got = [r.frame_index for r in series.nearest(entries, cursors).orderBy("cursor").collect()]
    assert got == [0, 0, 1, 3, 3, 1]


def test_empty_scores(spark):
    none = spark.createDataFrame([(1, None)], "analysis_id int, score int")
    assert tuple(rollups.score_stats(none).first())[1:] == (None, None, None)


def test_job_folds(spark):
    log = {
        "a": ["created"], "b": ["created", "claimed"], "c": ["created", "claimed", "failed"], "d": ["created", *["claimed", "failed"] * 3],
        "e": ["created", "claimed", "completed"], "f": ["created", *["claimed", "failed"] * 2, "claimed"],
    }
    rows = [(j, k, kind, None, f"e{k}") for j, kinds in log.items() for k, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "job_id string, seq bigint, kind string, progress double, error string")
    now = jobs.current(df)
    state = {r.job_id: (r.status, r.retry_count, r.progress) for r in now.collect()}
    assert state == {"a": ("queued", 0, 0.0), "b": ("processing", 0, 0.0), "c": ("queued", 1, 0.0), "d": ("failed", 3, 0.0), "e": ("completed", 0, 1.0), "f": ("processing", 2, 0.0)}
    again = {r.job_id: (r.status, r.retry_count) for r in jobs.recovered(now).collect()}
    assert again["b"] == ("queued", 1) and again["f"] == ("queued", 3) and again["d"] == ("failed", 3)
    stuck = jobs.recovered(now.withColumn("retry_count", F.lit(3))).where("job_id = 'b'").first()
    assert stuck.status == "processing"
    assert jobs.head(now, "created_seq").first().job_id == "a"


def test_splits(spark):
    three = spark.createDataFrame([(v, k) for v in "abc" for k in range(4)], "video string, k int")
    split = training.group_split(three, "video").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"test": 4, "val": 4, "train": 4}
    leaks = training.group_split(three, "video").groupBy("video").agg(F.countDistinct("split").alias("n")).where("n > 1")
    assert leaks.isEmpty()


def test_early_stopping(spark):
    df = spark.createDataFrame([("r", k + 1, x) for k, x in enumerate([3.0, 2.0, 2.0, 2.0, 1.0])], "run string, epoch int, loss double")
    r = training.early_stopping(df, "run", "epoch", "loss", 2).first()
    assert (r.best_epoch, r.last_epoch, r.best_loss, r.stopped) == (2, 4, 2.0, True)


def test_pages_are_clamped(spark):
    df = spark.range(250).select("id", F.lit(1).alias("user_id"), F.lit("x").alias("filename"), F.lit(None).cast("int").alias("overall_score"), F.current_timestamp().alias("created_at"))
    assert sessions.page(sessions.ordered(df), -3, 1000).count() == 100
    assert [r.id for r in sessions.page(sessions.ordered(df), 2, 3).collect()] == [3, 4, 5]


def test_first_frame_stands_still(spark):
    df = spark.createDataFrame([(1, 0, [1.0] * 8), (1, 1, [1.0] * 8), (1, 2, [100.0] * 4 + [180.0] * 4)], "analysis_id int, frame_index bigint, pixels array<double>")
    got = [(r.direction, r.motion_confidence, r.magnitude) for r in frames.with_motion(frames.pixel_statistics(df)).orderBy("frame_index").collect()]
    assert got == [("stationary", 0.5, 0.0), ("stationary", 0.5, 0.0), ("insertion", 0.95, 139.0)]


def test_plugins(spark):
    import pandas as pd

    model = plugins.batch_model(lambda: lambda x: pd.DataFrame({"score": (x > 2).astype("int32"), "label": x.astype(str)}), "score int, label string")
    plugins.register("classifier", "own", model)
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r.m.score for r in df.select(plugins.plugin("classifier", "own")(F.col("x")).alias("m")).collect()] == [0, 1]
    with pytest.raises(KeyError):
        plugins.plugin("motion", "none")


def test_analysis_of_pixels(spark):
    from tidemark import api

    rows = [(1, k, k * 1_000_000, 4_000_000, [float(40 * k + j % 7) for j in range(8)]) for k in range(5)]
    df = spark.createDataFrame(rows, "analysis_id int, frame_index bigint, t_us bigint, dur_us bigint, pixels array<double>")
    scored = api.score_frames(frames.pixel_statistics(df)).withColumn("conf_pct", F.lit(80))
    videos = spark.createDataFrame([(1,), (2,)], "analysis_id int")
    parts = api.analyze_videos(scored, videos)
    assert {r.analysis_id: (r.score, r.label, r.confidence) for r in parts["overall"].collect()} == {1: (0, "Poor", 80), 2: (0, "Poor", 0)}
    assert [r.direction for r in parts["segments"].orderBy("segment").collect()] == ["stationary", "withdrawal", "insertion", "withdrawal", "insertion"]
    assert {r.region for r in parts["regions"].collect()} == {"esophagus", "stomach", "duodenum"}
    assert parts["timeline"].count() == 5
