"""Results meet their capture times; halves that stay alone, late ones and broken messages."""

import datetime as dt
import json

from tidemark.streaming import live, pairing

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
MESSAGE = "message string, event_time timestamp"
CAPTURE = "session_id string, frame_index bigint, event_time timestamp, capture_time double"


def message(s, k, at=None, **more):
    return json.dumps({"session_id": s, "frame_index": k, "score": 2, "direction": "insertion", **more}), START + dt.timedelta(seconds=k if at is None else at)


def capture(s, k, at=None):
    return s, k, START + dt.timedelta(seconds=k if at is None else at), k * 0.4


BROKEN = ["", "{", "[1]", "null", '{"session_id": "a"}', '{"session_id": "a", "frame_index": "x"}', '{"session_id": "a", "frame_index": -1}', '{"frame_index": 3}', None]


def test_broken_messages_go_aside(spark):
    rows = [message("a", 0), *((x, START) for x in BROKEN), message("b", 3, region="stomach")]
    good, bad = pairing.read_messages(spark.createDataFrame(rows, MESSAGE))
    assert sorted((r.session_id, r.frame_index, r.score, r.region) for r in good.collect()) == [("a", 0, 2, None), ("b", 3, 2, "stomach")]
    assert sorted(map(str, (r.message for r in bad.collect()))) == sorted(map(str, BROKEN))
    assert bad.columns == ["message", "event_time"]


def test_stream_of_halves_equals_batch(spark, tmp_path):
    first = [message("a", k) for k in range(8) if k != 3] + [message("b", 1), ("{", START)], [capture("a", k) for k in range(8) if k != 5] + [capture("c", 2)]
    # the other half of a:2 again, within reach, and one of b:1 that is too far away
    second = [message("a", 9)], [capture("a", 9, 60), capture("b", 1, 400)]
    end = [message("z", 9000)], [capture("z", 9000)]
    past = [message("a", 3)], [capture("a", 5)]  # come after the watermark: nobody waits for them

    def stream():
        ins = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for s, n in ((MESSAGE, "m"), (CAPTURE, "c"))]
        return pairing.paired(pairing.read_messages(ins[0])[0], ins[1])

    for part in (first, second, end, end, past):
        for rows, schema, name in zip(part, (MESSAGE, CAPTURE), "mc", strict=True):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        live.replayed(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    shown = lambda df: sorted((r.session_id, r.frame_index, r.timestamp, r.half, r.score) for r in df.collect() if r.session_id != "z")
    got = shown(spark.read.parquet(str(tmp_path / "out")))
    tables = [spark.createDataFrame([*a, *b], s) for a, b, s in zip(first, second, (MESSAGE, CAPTURE), strict=True)]
    assert got == shown(pairing.paired(pairing.read_messages(tables[0])[0], tables[1]))
    halves = {(s, k): (h, t) for s, k, t, h, _ in got if s != "b"}
    assert halves["a", 3] == ("capture", 3 * 0.4) and halves["a", 5] == ("result", 2.5) and halves["c", 2] == ("capture", 0.8)
    assert halves["a", 9] == ("both", 9 * 0.4)
    assert [x[3] for x in got if x[0] == "b"] == ["result", "capture"] or [x[3] for x in got if x[0] == "b"] == ["capture", "result"]
