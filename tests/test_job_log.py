"""The job log with several workers: claims, recovery, failures, snapshots."""

import datetime as dt
import threading

import pytest

from tidemark.operators import jobs
from tidemark.sources.job_log import JobLog

START = dt.datetime(2026, 1, 1)


@pytest.fixture
def log(spark, tmp_path):
    made = JobLog(spark, str(tmp_path / "log"))
    # ids run against the order of their times
    made.enqueue(spark.createDataFrame([(f"j{9 - k}", START + dt.timedelta(seconds=k)) for k in range(10)], "id string, at timestamp"), "id", "at")
    return made


def state(log):
    return {r.job_id: (r.status, r.retry_count) for r in log.state().collect()}


def test_oldest_are_claimed_first_and_once(spark, log):
    assert log.claim("a", 2) == ["j8", "j9"]
    assert log.claim("b", 3) == ["j5", "j6", "j7"]
    assert state(log)["j9"] == ("processing", 0) and state(log)["j4"] == ("queued", 0)
    owners = {r.job_id: r.owner for r in log.state().collect()}
    assert owners["j9"].startswith("a:") and owners["j5"].startswith("b:") and owners["j0"] is None
    log.enqueue(spark.createDataFrame([("j9", START)], "id string, at timestamp"), "id", "at")
    assert log.events().where("job_id = 'j9' AND kind = 'created'").count() == 1


def test_second_commit_of_a_version_is_refused(spark, log):
    at = log.version()
    mine, other = (jobs.claimed(log.events(), "created_at", 2, w) for w in "ab")
    assert log.commit(mine, at) and not log.commit(other, at)
    assert log.version() == at + 1
    assert [r.token for r in log.events(at).collect()] == ["a", "a"]
    assert len(list(log._fs.listStatus(log._at("data")))) == at + 1


def test_two_workers_never_own_one_job(spark, log, monkeypatch):
    """Both decide from the same version, again and again: whoever comes second decides anew."""
    gate, refused, commit = threading.Barrier(2), [], JobLog.commit

    def together(self, events, after):
        try:
            gate.wait(timeout=20)
        except threading.BrokenBarrierError:
            pass
        done = commit(self, events, after)
        refused.append(not done)
        return done

    monkeypatch.setattr(JobLog, "commit", together)
    taken = {"a": [], "b": []}

    def work(worker):
        own = JobLog(spark, log.path)
        while ids := own.claim(worker, 2):
            taken[worker] += ids
        gate.abort()

    threads = [threading.Thread(target=work, args=(w,)) for w in taken]
    for t in threads:
        t.start()
    for t in threads:
        t.join(timeout=240)
    assert sorted(taken["a"] + taken["b"]) == sorted(f"j{k}" for k in range(10))
    assert any(refused)
    owners = {r.job_id: r.owner.split(":")[0] for r in log.state().collect()}
    assert owners == {j: w for w, ids in taken.items() for j in ids}


def test_recovery_appends_events_and_failures_count_once(spark, log):
    log.claim("a", 3)
    before = log.version()
    assert log.recover() == ["j7", "j8", "j9"]
    assert [(r.kind, r.seq) for r in log.events(before).collect()] == [("recovered", 2)] * 3
    assert state(log)["j9"] == ("queued", 1)
    assert log.recover() == []
    for k in (2, 3):
        assert log.claim("a", 1) == ["j9"]
        lost = spark.createDataFrame([("j9", f"lost {k}"), ("j9", "lost"), ("j0", "not running")], "job_id string, error string")
        assert log.fail(lost) == ["j9"]
        assert log.fail(lost) == []
        assert state(log)["j9"] == ("queued" if k < 3 else "failed", k)
    assert log.claim("a", 1) == ["j8"]
    log.advance(spark.createDataFrame([("j8", 0.1), ("j8", 0.3), ("j8", 3.0)], "job_id string, progress double"))
    assert log.state().where("job_id = 'j8'").first().progress == 0.3
    assert log.complete(spark.createDataFrame([("j8", "{}", "{}"), ("j0", "{}", "{}")], "job_id string, results string, metadata string")) == ["j8"]
    assert log.state().where("job_id = 'j8'").first().progress == 1.0


def test_snapshot_and_tail_equal_the_whole(spark, log):
    log.claim("a", 4)
    log.fail(spark.createDataFrame([("j9", "x")], "job_id string, error string"))
    first = log.snapshot()
    assert first == log.version() == log.snapshot()
    log.claim("b", 2)
    log.recover()
    assert log.events(first).count() < log.events().count()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(log.state()) == rows(jobs.current(log.events()))
    assert rows(log.state(first)) == rows(jobs.current(log.events(0, first)))
    log.snapshot()
    log.claim("c", 5)
    assert rows(log.state()) == rows(jobs.current(log.events()))
    # what a snapshot covers is not read again
    tail, snapshot = log._from(log.version())
    assert tail.select("version").distinct().count() == 1 and snapshot.count() == 10


def test_empty_log(spark, tmp_path):
    empty = JobLog(spark, f"file://{tmp_path}/none")
    assert empty.version() == 0 and empty.state().isEmpty() and empty.claim("a") == [] and empty.snapshot() == 0
