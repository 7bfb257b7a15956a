"""The job log in a folder that several workers share: versions, claims, snapshots.

    data/<id>/         the events of one commit, as Parquet
    versions/<number>  names the commit that became this version of the log
    snapshots/<number> the fold of all versions up to this one

A commit says which version it was worked out from, and becomes the next one, if no other has:
the version's file is made whole and put in place only where none is. A worker that comes
second reads what the first one added, and decides anew; so a job is never claimed twice,
and no lock is held. Events carry their claim's token and, when read, their version. A reader folds
the latest snapshot and the versions after it, so that a claim costs what is new, not the whole log.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..schemas import LOG_EVENT


class Conflict(RuntimeError):
    """Other workers' commits came first, each time."""


class JobLog:
    def __init__(self, spark: SparkSession, path: str, tries: int = 20):
        self.spark, self.path, self.tries = spark, path.rstrip("/"), tries
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("versions", "snapshots", "pending"):
            self._fs.mkdirs(self._at(name))

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n) for x in self._fs.listStatus(self._at(folder)) if (n := x.getPath().getName()).isdigit())

    def version(self) -> int:
        """The latest version; 0 for an empty log."""
        return max(self._numbers("versions"), default=0)

    def _commit_of(self, version: int) -> str:
        stream = self._fs.open(self._at("versions", f"{version:020d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, version: int, name: str) -> bool:
        """Name a commit as the version, unless there is one. A hard link, or elsewhere than in a
        local folder the file system's own rename, is refused where the target exists."""
        target = f"{version:020d}"
        pending = self._at("pending", name)
        stream = self._fs.create(pending, True)
        stream.write(name.encode())
        stream.close()
        try:
            where = urlparse(self.path)
            if where.scheme in ("", "file"):
                try:
                    os.link(f"{where.path}/pending/{name}", f"{where.path}/versions/{target}")
                except FileExistsError:
                    return False
                return True
            return bool(self._fs.rename(pending, self._at("versions", target)))
        finally:
            self._fs.delete(pending, False)

    def commit(self, events: DataFrame, after: int) -> bool:
        """Append events that were worked out from version ``after``; False if the log has moved on."""
        name = uuid.uuid4().hex
        columns = [x.split()[0] for x in LOG_EVENT.split(", ")]
        kinds = dict(x.split() for x in LOG_EVENT.split(", "))
        own = events.select(*(F.col(c) if c in events.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))
        own.write.parquet(f"{self.path}/data/{name}")
        if self._put(after + 1, name):
            return True
        self._fs.delete(self._at("data", name), True)
        return False

    def events(self, after: int = 0, to: int | None = None) -> DataFrame:
        """The events of the versions after ``after``, up to ``to``."""
        numbers = [n for n in self._numbers("versions") if after < n and (to is None or n <= to)]
        schema = f"{LOG_EVENT}, version bigint"
        if not numbers:
            return self.spark.createDataFrame([], schema)
        names = {self._commit_of(n): n for n in numbers}
        read = self.spark.read.schema(LOG_EVENT).parquet(*(f"{self.path}/data/{x}" for x in names))
        known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        return read.withColumn("version", known[F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/", 1)].cast("bigint"))

    def _from(self, to: int) -> tuple[DataFrame, DataFrame | None]:
        """The versions after the latest snapshot, and that snapshot."""
        done = [n for n in self._numbers("snapshots") if n <= to and self._fs.exists(self._at("snapshots", f"{n:020d}", "_SUCCESS"))]
        if not done:
            return self.events(0, to), None
        return self.events(done[-1], to), self.spark.read.parquet(f"{self.path}/snapshots/{done[-1]:020d}")

    def state(self, to: int | None = None) -> DataFrame:
        """The jobs as of a version, the latest by default."""
        tail, snapshot = self._from(self.version() if to is None else to)
        return J.current(tail, snapshot=snapshot)

    def snapshot(self) -> int:
        """Fold the log so far for later readers; the number of its version. One that was broken
        off is written again."""
        to = self.version()
        tail, before = self._from(to)
        if to and not self._fs.exists(self._at("snapshots", f"{to:020d}", "_SUCCESS")):
            J.folded(tail, before).write.mode("overwrite").parquet(f"{self.path}/snapshots/{to:020d}")
        return to

    def append(self, made: Callable[[DataFrame, DataFrame | None], DataFrame]) -> list[str]:
        """Commit what ``made(tail, snapshot)`` gives as events, anew after each conflict; the jobs
        of these events. Meant for a worker's own events: their ids come to the driver."""
        for _ in range(self.tries):
            to = self.version()
            events = made(*self._from(to)).persist()
            try:
                ids = [r[0] for r in events.select("job_id").distinct().collect()]
                if not ids or self.commit(events, to):
                    return sorted(ids)
            finally:
                events.unpersist()
        raise Conflict(f"{self.tries} commits came first")

    def enqueue(self, uploads: DataFrame, job_id: str, at: str) -> None:
        """New jobs, however many; those that are known are left out."""
        for _ in range(self.tries):
            to = self.version()
            known = self.state(to).select("job_id")
            if self.commit(J.enqueued(uploads, job_id, at).join(known, "job_id", "left_anti"), to):
                return
        raise Conflict(f"{self.tries} commits came first")

    def claim(self, worker: str, slots: int = 1) -> list[str]:
        """Take the oldest queued jobs for a worker: their ids."""
        token = f"{worker}:{uuid.uuid4().hex}"
        return self.append(lambda tail, snapshot: J.claimed(tail, "created_at", slots, token, snapshot))

    def recover(self) -> list[str]:
        return self.append(lambda tail, snapshot: J.recoveries(tail, snapshot=snapshot))

    def fail(self, attempts: DataFrame) -> list[str]:
        return self.append(lambda tail, snapshot: J.failed(tail, attempts, snapshot))

    def advance(self, marks: DataFrame) -> list[str]:
        return self.append(lambda tail, snapshot: J.advanced(tail, marks, snapshot))

    def complete(self, results: DataFrame) -> list[str]:
        return self.append(lambda tail, snapshot: J.completed(tail, results, snapshot))
