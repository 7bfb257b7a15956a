"""Uploads of a client in at most a few slots, as an ordered fold over events.

An added item waits until a slot is free; slots free when an upload finishes, fails or is
removed while it runs, and the longest waiting items take them. A reset ends all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SLOTS = 3
ITEMS = "client {client}, item {item}, added_seq bigint, started_seq bigint, ended_seq bigint, outcome string"


class Slots:
    """One client's queue. ``done`` gets each item that is over."""

    def __init__(self, slots: int):
        self.slots, self.active, self.pending = slots, {}, {}

    def event(self, seq: int, kind: str, item) -> Iterator[tuple]:
        """(item, added, started, ended, outcome) of the items that this event ends."""
        if kind == "add":
            if item not in self.active:
                self.pending.setdefault(item, seq)
        elif kind == "reset":
            yield from self.rest(seq, "reset")
            self.active, self.pending = {}, {}
        elif item in self.active and kind in ("finish", "fail", "remove"):
            yield item, *self.active.pop(item), seq, {"finish": "finished", "fail": "failed", "remove": "removed"}[kind]
        elif item in self.pending and kind == "remove":
            yield item, self.pending.pop(item), None, seq, "removed"
        while self.pending and len(self.active) < self.slots:
            first = next(iter(self.pending))
            self.active[first] = (self.pending.pop(first), seq)

    def rest(self, seq: int | None = None, outcome: str | None = None) -> Iterator[tuple]:
        for item, (added, started) in self.active.items():
            yield item, added, started, seq, outcome or "uploading"
        for item, added in self.pending.items():
            yield item, added, None, seq, outcome or "pending"


def scheduled(events: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Each added item of a log (client, seq, kind, item) with the places in the log where it
    was added, started and ended (null if not yet), and its outcome. Clients are dealt whole and read
    in order: a task holds the items that are waiting or running, not a client's log."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("client", "item")}
    schema = ITEMS.format(**kinds)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, queue = None, None

        def framed(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("added_seq", "started_seq", "ended_seq")})

        for batch in batches:
            out = []
            for client, seq, kind, item in zip(batch["client"], batch["seq"], batch["kind"], batch["item"], strict=True):
                if queue is None or client != now:
                    out += [(now, *x) for x in (queue.rest() if queue else ())]
                    now, queue = client, Slots(slots)
                out += [(client, *x) for x in queue.event(int(seq), kind, item)]
            yield framed(out)
        if queue:
            yield framed([(now, *x) for x in queue.rest()])

    own = events.where("client IS NOT NULL").select("client", "seq", "kind", "item")
    return own.repartition("client").sortWithinPartitions("client", "seq").mapInPandas(run, schema)
