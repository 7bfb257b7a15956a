"""The live operator as a stream equals the same over stored frames, also after a restart."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import plugins
from tidemark.operators import answers
from tidemark.streaming import connection, live

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
DDL = "session_id string, frame_index bigint, event_time timestamp, pixels array<double>"


def landed(spark, path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def frames(r, sessions, numbers, start=START):
    return [(s, k, start + dt.timedelta(seconds=k / 2), [float(r.randint(0, 255)) for _ in range(24)]) for s in sessions for k in numbers]


def run(spark, tmp_path, **named):
    source = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.replayed(connection.answered(source, **named), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.parquet(str(tmp_path / "out"))


def shown(df):
    return sorted((r.session_id, r.frame_index, r.peace_score, r.motion, r.region, r.timestamp) for r in df.collect())


@pytest.fixture(scope="module")
def partial_model():
    """Gives nothing for frames that begin dark: those go by what the session had."""

    def model(pixels):
        return F.when(F.get(pixels, F.lit(0)) >= 80, plugins.plugin("model", "bands")(pixels))

    plugins.register("model", "partial", model)
    return "partial"


@pytest.mark.parametrize("model", [None, "bands", "partial"])
def test_stream_with_restart_equals_batch(spark, tmp_path, partial_model, model):
    r, where, kept = random.Random(4), str(tmp_path / "in"), []
    for numbers in (range(0, 5), range(5, 9)):
        kept += (rows := frames(r, "abc", numbers))
        landed(spark, where, rows)
    run(spark, tmp_path, model=model)
    # a new query over the same checkpoint goes on, and late frames don't count
    kept += (rows := frames(r, "abd", range(9, 14)))
    landed(spark, where, [*rows, *frames(r, "a", [2, 3]), rows[0]])
    got = run(spark, tmp_path, model=model)
    want = answers.answered(spark.createDataFrame(kept, DDL), model=model)
    assert shown(got) == shown(want)
    assert got.count() == 5 * 3 + 4 * 3 + 5 * 3
    scores = {x.peace_score.confidence is None for x in got.collect()}
    assert scores == {model is None} or model == "partial"


def test_other_plugins_answer(spark, tmp_path):
    @F.pandas_udf("region_probs array<double>, score_probs array<double>")
    def net(pixels: pd.Series) -> pd.DataFrame:
        top = pixels.map(lambda x: int(x[0]) % 4)
        return pd.DataFrame({"region_probs": [[0.1, 0.2, 0.7]] * len(top), "score_probs": top.map(lambda k: [0.7 if i == k else 0.1 for i in range(4)])})

    plugins.register("model", "net", net)
    plugins.register("pairwise", "none", lambda pixels, previous, number: F.struct(F.lit("insertion").alias("direction"), F.lit(0.9).alias("confidence"), F.lit(3.0).alias("optical_flow_magnitude")))
    landed(spark, str(tmp_path / "in"), frames(random.Random(1), "ab", range(6)))
    rows = run(spark, tmp_path, model="net", pairwise="none").collect()
    assert {x.region for x in rows} == {"duodenum"}
    assert {(x.motion.direction, x.frame_index == 0) for x in rows} == {("stationary", True), ("insertion", False)}
    assert shown(answers.answered(spark.read.schema(DDL).parquet(str(tmp_path / "in")), model="net", pairwise="none")) == shown(spark.read.parquet(str(tmp_path / "out")))


def test_idle_sessions_are_forgotten(spark, tmp_path):
    r, where = random.Random(2), str(tmp_path / "in")
    landed(spark, where, frames(r, "a", range(3)))
    run(spark, tmp_path, model="bands")
    # hours later another session moves the watermark; then "a" begins anew, with its numbers from 0
    landed(spark, where, frames(r, "b", range(1), START + dt.timedelta(hours=3)))
    run(spark, tmp_path, model="bands")
    again = frames(r, "a", [0, 1], START + dt.timedelta(hours=4))
    landed(spark, where, again)
    got = [x for x in run(spark, tmp_path, model="bands").collect() if x.session_id == "a" and x.timestamp >= dt.datetime(2026, 1, 1, 4)]
    assert sorted(x.frame_index for x in got) == [0, 1]
    want = answers.answered(spark.createDataFrame(again, DDL), model="bands")
    assert shown(spark.createDataFrame(got, want.schema)) == shown(want)
