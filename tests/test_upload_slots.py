"""The upload queue against a plain run, event by event."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import sessions, upload_slots


def plain(events, slots):
    waiting, running, out = [], [], {}
    for seq, kind, item in events:
        if kind == "add" and item not in waiting + running:
            waiting.append(item)
            out[item, seq] = [None, None, None]
            key = {i: k for k in out for i in [k[0]]}
        elif kind == "reset":
            for i in waiting + running:
                out[key[i]][1:] = [seq, "reset"]
            waiting, running = [], []
        elif kind in ("finish", "fail", "remove") and (item in running or item in waiting and kind == "remove"):
            out[key[item]][1:] = [seq, {"finish": "finished", "fail": "failed", "remove": "removed"}[kind]]
            (running if item in running else waiting).remove(item)
        while waiting and len(running) < slots:
            running.append(waiting.pop(0))
            out[key[running[-1]]][0] = seq
    for i in waiting + running:
        out[key[i]][2] = "pending" if i in waiting else "uploading"
    return sorted((item, added, *rest) for (item, added), rest in out.items())


EVENTS = st.lists(st.tuples(st.sampled_from(["add", "add", "add", "finish", "fail", "remove", "reset"]), st.integers(0, 6)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(EVENTS, st.integers(1, 3))
def test_slots_equal_a_plain_run(events, slots):
    events = [(k, *e) for k, e in enumerate(events)]
    queue = upload_slots.Slots(slots)
    got = [x for e in events for x in queue.event(*e)] + list(queue.rest())
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(plain(events, slots), key=key)
    assert len(queue.active) <= slots


def test_clients_are_apart(spark):
    rows = [(c, k, "add" if k % 3 else "finish", k if k % 3 else k // 2 + 1) for c in "ab" for k in range(1, 30)] + [(None, 1, "add", 1)]
    got = upload_slots.scheduled(spark.createDataFrame(rows, "client string, seq long, kind string, item int").repartition(5)).collect()
    for c in "ab":
        mine = sorted(((r["item"], r.added_seq, r.started_seq, r.ended_seq, r.outcome) for r in got if r.client == c), key=str)
        assert mine == sorted(plain([x[1:] for x in rows if x[0] == c], 3), key=str)
    assert {r.client for r in got} == {"a", "b"}


def test_live_details_and_failed_attempts(spark):
    rows = [(1, "live_1", "completed", 2, 7, '[{"frame_index": 0, "timestamp": 0.5, "motion": "insertion"}]', 3.5), (2, "live_2", "completed", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, analysis_id string, status string, overall_score int, frames_analyzed int, timeline_data string, duration double")
    df = df.selectExpr("*", "timestamp'2026-01-01 00:00:01' AS created_at", "CAST(NULL AS TIMESTAMP) AS completed_at")
    one, two = sessions.live_detail(df).orderBy("id").collect()
    assert (one.results.peace_scores.overall.label, one.results.peace_scores.overall.confidence, one.progress) == ("Adequate", 1.0, 100)
    assert [t.motion for t in one.results.timeline] == ["insertion"] and one.results.segments == [] and one.video_metadata.analyzed_frames == 7
    assert two.results is None and two.video_metadata.total_frames == 0 and two.video_metadata.duration_seconds == 0.0
    refused = df.selectExpr("id", "'f.mp4' AS filename", "created_at", "CASE WHEN id = 2 THEN 'quota' END AS reason")
    [r] = sessions.failed_attempts(refused, "created_at").collect()
    assert (r.analysis_id, r.status, r.completed_at) == ("fail_1767225601000_2", "failed", r.created_at)
