"""Live frames over sockets, as a streaming source and sink with offsets.

A *gateway* stands where clients connect. It numbers the frames that come in, keeps them until
their answers are in, and hands the answers back. The source reads ranges of numbers, so that a
batch that is run again gets the same frames; the sink delivers a batch's answers in one message
with the batch's number, which a gateway takes once. So a restarted query loses and repeats nothing.

Admission is by unanswered frames: the source lets through only so many frames of a session as keep
``in_flight`` of them without an answer. Clients are told to wait while theirs are that many.

Several gateways (``hosts``, comma-separated) are read side by side, each with its own numbers.
Messages are lines of JSON.
"""

from __future__ import annotations

import base64
import json
import socket
import socketserver
import threading
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

FRAMES = "session_id string, frame_index bigint, event_time timestamp, pixels array<double>"


class Gateway:
    """Holds frames and answers for clients; one lock, a thread for each connection."""

    def __init__(self, host: str = "127.0.0.1", port: int = 0):
        self.lock, self.frames, self.first, self.next = threading.Lock(), {}, 0, 0
        self.answers: dict[str, list[dict]] = {}
        self.fetched = self.settled = 0  # frames before these were read, and answered or left out
        self.most_open = 0  # the most frames of a session that were ever let through unanswered
        self.taken: dict[str, int] = {}  # the latest batch of each query
        self.sessions: set[str] = set()
        gateway = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self):
                for line in self.rfile:
                    out = gateway.asked(json.loads(line))
                    self.wfile.write(json.dumps(out).encode() + b"\n")

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads = True, True

        self.server = Server((host, port), Handler)
        self.address = f"{host}:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()

    def asked(self, message: dict) -> dict:
        with self.lock:
            return getattr(self, f"_{message['do']}")(message)

    def _open(self) -> Counter:
        return Counter(self.frames[k]["session_id"] for k in range(self.settled, self.next))

    def _put(self, m: dict) -> dict:
        """From a client: a frame. ``wait`` while ``in_flight`` of its session have no answer."""
        frame = m["frame"]
        if "in_flight" in m and self._open()[frame["session_id"]] >= m["in_flight"]:
            return {"wait": True}
        self.frames[self.next] = frame
        self.sessions.add(frame["session_id"])
        self.next += 1
        return {"number": self.next - 1}

    def _answers(self, m: dict) -> dict:
        """From a client: the answers of its session after the first ``seen``."""
        return {"answers": self.answers.get(m["session_id"], [])[m["seen"] :]}

    def _start(self, m: dict) -> dict:
        return {"number": self.first}

    def _latest(self, m: dict) -> dict:
        """Up to where the source may read: no session gets over ``in_flight`` open frames."""
        opened: Counter = Counter()
        for number in range(self.settled, self.next):
            session = self.frames[number]["session_id"]
            if opened[session] == m["in_flight"]:
                return {"number": number}
            opened[session] += 1
        return {"number": self.next}

    def _fetch(self, m: dict) -> dict:
        self.fetched = max(self.fetched, m["end"])
        opened = Counter(self.frames[k]["session_id"] for k in range(self.settled, self.fetched))
        self.most_open = max([self.most_open, *opened.values()])
        return {"frames": [self.frames[k] for k in range(m["start"], m["end"])]}

    def _deliver(self, m: dict) -> dict:
        """From the sink: a batch's answers, taken once. With them, all frames that were read are
        settled, late ones without an answer, too; they are kept until the source commits."""
        if m["batch"] > self.taken.get(m["query"], -1):
            self.taken[m["query"]] = m["batch"]
            self.settled = self.fetched
            for answer in m["answers"]:
                if answer["session_id"] in self.sessions:
                    self.answers.setdefault(answer["session_id"], []).append(answer)
        return {}

    def _commit(self, m: dict) -> dict:
        """From the source: frames before ``end`` won't be asked for again."""
        for number in range(self.first, m["end"]):
            self.frames.pop(number, None)
        self.first = max(self.first, m["end"])
        return {}


def ask(host: str, **message) -> dict:
    name, _, port = host.rpartition(":")
    with socket.create_connection((name, int(port)), timeout=60) as s, s.makefile("rwb") as f:
        f.write(json.dumps(message).encode() + b"\n")
        f.flush()
        return json.loads(f.readline())


def packed(session_id: str, frame_index: int, at: datetime, pixels: np.ndarray) -> dict:
    """A frame as a client sends it: grey values from 0 to 255."""
    return {"session_id": session_id, "frame_index": frame_index, "at": at.timestamp(), "pixels": base64.b64encode(np.asarray(pixels, np.uint8).tobytes()).decode()}


class _Numbers(InputPartition):
    def __init__(self, host: str, start: int, end: int):
        self.host, self.start, self.end = host, start, end


class _Source(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.hosts = options["hosts"].split(",")
        self.in_flight = int(options.get("in_flight", 2))

    def initialOffset(self) -> dict:
        return {h: ask(h, do="start")["number"] for h in self.hosts}

    def latestOffset(self) -> dict:
        return {h: ask(h, do="latest", in_flight=self.in_flight)["number"] for h in self.hosts}

    def partitions(self, start: dict, end: dict) -> list[_Numbers]:
        return [_Numbers(h, start.get(h, 0), end[h]) for h in end if end[h] > start.get(h, 0)]

    def read(self, partition: _Numbers) -> Iterator[tuple]:
        for f in ask(partition.host, do="fetch", start=partition.start, end=partition.end)["frames"]:
            pixels = np.frombuffer(base64.b64decode(f["pixels"]), np.uint8).astype(float).tolist()
            yield f["session_id"], f["frame_index"], datetime.fromtimestamp(f["at"], UTC), pixels

    def commit(self, end: dict) -> None:
        for h, n in end.items():
            ask(h, do="commit", end=n)


class _Message(WriterCommitMessage):
    def __init__(self, answers: dict[str, list[dict]]):
        self.answers = answers


class _Sink(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.hosts, self.query = options["hosts"].split(","), options["query"]

    def write(self, iterator: Iterator[Row]) -> _Message:
        rows = [json.loads(json.dumps(r.asDict(True), default=str)) for r in iterator]
        return _Message({"": rows})

    def commit(self, messages: list[_Message], batchId: int) -> None:
        """One message for each gateway: it takes all of a batch's answers, or none. They are
        as many as the frames that admission let through."""
        rows = [r for m in messages if m for r in m.answers[""]]
        for host in self.hosts:
            ask(host, do="deliver", query=self.query, batch=batchId, answers=rows)

    def abort(self, messages: list[_Message], batchId: int) -> None:
        """Nothing was delivered; the batch is run again."""


class GatewaySource(DataSource):
    """Options: hosts (host:port, comma-separated), in_flight (2), and for the sink query, a name
    that stays the same over restarts."""

    @classmethod
    def name(cls) -> str:
        return "gateway"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Source(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Sink(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GatewaySource)
