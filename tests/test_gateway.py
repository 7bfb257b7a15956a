"""Frames over sockets: each is answered once, over restarts and failed commits, and few are open."""

import datetime as dt
import time

import numpy as np
import pytest

from tidemark.operators import answers
from tidemark.sources import gateway
from tidemark.streaming import connection

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def gateways(spark):
    gateway.register(spark)
    made = [gateway.Gateway(), gateway.Gateway()]
    yield made
    for g in made:
        g.close()


def image(session, k):
    return np.random.default_rng([ord(session[0]), k]).integers(0, 255, 24)


def put(g, session, k, **more):
    return gateway.ask(g.address, do="put", frame=gateway.packed(session, k, START + dt.timedelta(seconds=k / 2), image(session, k)), **more)


def started(spark, gateways, state):
    options = {"hosts": ",".join(g.address for g in gateways), "in_flight": "2", "query": "live"}
    frames = spark.readStream.format("gateway").options(**options).load()
    out = connection.answered(frames, model="bands").writeStream.format("gateway").options(**options)
    return out.option("checkpointLocation", state).outputMode("append").trigger(processingTime="0 seconds").start()


def until(done, query, seconds=150):
    end = time.time() + seconds
    while not done():
        assert time.time() < end and (query.exception() is None), query.exception()
        time.sleep(0.1)


def got(g, session):
    return gateway.ask(g.address, do="answers", session_id=session, seen=0)["answers"]


def test_each_frame_is_answered_once(spark, gateways, tmp_path):
    one, two = gateways
    for k in range(5):
        put(one, "a", k)
        put(two, "b", k)
    query = started(spark, gateways, str(tmp_path / "state"))
    try:
        until(lambda: len(got(one, "a")) >= 3, query)
    finally:
        query.stop()
    # the next commit is taken, but its reply is lost: the batch is run again and taken once
    real, lost = one._deliver, []

    def deliver(m):
        out = real(m)
        if not lost:
            lost.append(m["batch"])
            raise ConnectionError("reply lost")
        return out

    one._deliver = deliver
    for k in range(5, 8):
        put(one, "a", k)
    put(one, "a", 2)  # late: no answer, and it holds nothing up
    query = started(spark, gateways, str(tmp_path / "state"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        query.awaitTermination(100)
        raise AssertionError("the lost reply ends the query")
    assert lost
    query = started(spark, gateways, str(tmp_path / "state"))
    try:
        until(lambda: len(got(one, "a")) >= 8 and len(got(two, "b")) >= 5, query)
        put(one, "a", 8)
        until(lambda: len(got(one, "a")) >= 9, query)
        time.sleep(1)
    finally:
        query.stop()
    rows = [(s, k, START + dt.timedelta(seconds=k / 2), [float(x) for x in image(s, k)]) for s, n in (("a", 9), ("b", 5)) for k in range(n)]
    want = answers.answered(spark.createDataFrame(rows, gateway.FRAMES), model="bands").collect()
    for g, s in ((one, "a"), (two, "b")):
        mine = sorted((r.frame_index, r.region, r.peace_score.score, r.motion.direction, r.motion.confidence) for r in want if r.session_id == s)
        assert [(x["frame_index"], x["region"], x["peace_score"]["score"], x["motion"]["direction"], x["motion"]["confidence"]) for x in got(g, s)] == mine
        assert g.most_open == 2 and got(g, "b" if s == "a" else "a") == []
        assert len(g.frames) <= 2  # what is answered isn't kept


def test_clients_wait_and_admission_counts_unanswered_frames():
    g = gateway.Gateway()
    try:
        assert [put(g, "a", k, in_flight=2) for k in range(3)] == [{"number": 0}, {"number": 1}, {"wait": True}]
        assert put(g, "b", 0, in_flight=2) == {"number": 2} and put(g, "a", 2) == {"number": 3} and put(g, "b", 1) == {"number": 4}
        latest = lambda n=2: gateway.ask(g.address, do="latest", in_flight=n)["number"]
        assert latest() == 3 and latest(1) == 1 and latest(9) == 5
        assert len(gateway.ask(g.address, do="fetch", start=0, end=3)["frames"]) == 3
        assert latest() == 3  # nothing is answered yet
        for _ in range(2):
            gateway.ask(g.address, do="deliver", query="q", batch=0, answers=[{"session_id": "a"}, {"session_id": "other"}])
        assert latest() == 5 and len(got(g, "a")) == 1 and got(g, "other") == []
        gateway.ask(g.address, do="commit", end=3)
        assert gateway.ask(g.address, do="start") == {"number": 3} and sorted(g.frames) == [3, 4]
    finally:
        g.close()
