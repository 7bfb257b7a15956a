"""Operator 7 over time: the logarithmic family as stored levels, to which batches of documents are added.

A batch's windows of SPAN bytes are named by anchors, as in ``suffixes``; the windows in a row with one
anchor are a segment, and a level is a table of distinct segments in order of (anchor, bytes), each with
the least doc_id that has it. A batch is merge-scanned against each level: both sides are sorted by
anchor and merged, and the windows of segments that meet are compared whole. Then the batch becomes
a level, and while the level before is of at most twice its size, the two are merged; so there are
logarithmically many, and every segment is merged that often. A level takes about five times its texts, before compression.

Batches come in ascending doc_id. Their results together are those of one run over all documents. What
became of a batch is decided when its manifest, the list of levels, is written: a batch that was broken
off leaves unlisted tables and can be added again.

Cases: as in ``suffixes``; a batch without documents changes nothing; one with a doc_id that isn't
greater than all before is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, arrow_schema, returned, sliced, written
from .suffixes import ROW, SPAN, WIDTH, Part, _rows

SEGMENTS = "rk long, doc_id long, at long, anchor long, text binary"
DIGESTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def segment_rows(docs: DataFrame) -> DataFrame:
    """A row for each segment of (doc_id, rk, text), with its place in the document."""
    target = arrow_schema(docs.sparkSession, SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            part = Part(pa.Table.from_batches([batch]))
            data, bounds, doc, start, count, anchor = part.segments()
            if not len(doc):
                continue
            ids, keys = (np.array([x or 0 for x in values], np.int64) for values in (part.ids, part.keys))
            for lo in range(0, len(doc), 1 << 16):
                own = slice(lo, lo + (1 << 16))
                text = _rows(data, start[own], count[own])
                columns = [keys[doc[own]], ids[doc[own]], start[own] - bounds[doc[own]], anchor[own].view(np.int64)]
                texts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ROW), len(text), [None, pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), texts.cast(pa.binary())], schema=target)
        returned()

    return docs.select("doc_id", "rk", "text").mapInArrow(run, SEGMENTS)


def windows(rows: DataFrame, *columns: str) -> DataFrame:
    """Each window of the segments, with its number in the segment."""
    count = F.conv(F.hex(F.substring("text", WIDTH + 1, 1)), 16, 10).cast("int")
    each = rows.select(*columns, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    return each.select(*columns, "k", F.expr(f"substring(text, k + 1, {SPAN})").alias("w"))


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The latest manifest and its number."""
        place = self._hadoop.Path(f"{self.path}/manifests")
        numbers = [int(x.getPath().getName()) for x in self._fs.listStatus(place)] if self._fs.exists(place) else []
        if not numbers:
            return 0, {"last": None, "levels": []}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/manifests/{max(numbers)}"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def levels(self) -> list[int]:
        """The segments of each level, the oldest first."""
        return [n for _, n in self._manifest()[1]["levels"]]

    def _level(self, name: str) -> DataFrame:
        return self.spark.read.schema("anchor long, text binary, least long").parquet(f"{self.path}/levels/{name}")

    def _put(self, rows: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        rows.repartition("anchor").sortWithinPartitions("anchor", "text").write.option("compression", "zstd").parquet(f"{self.path}/levels/{name}")
        return name, self._level(name).count()

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Add a batch; (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of its documents."""
        number, manifest = self._manifest()
        own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
        least, last = own.agg(F.min("doc_id"), F.max("doc_id")).first()
        if least is not None and manifest["last"] is not None and least <= manifest["last"]:
            raise ValueError(f"doc_id {least} is not greater than {manifest['last']}")
        batch = written(segment_rows(own), "segments")
        once = batch.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        names = once.select("anchor")
        # each level's segments with an anchor of the batch, by merging the two in order
        met = [self._level(name).join(names.hint("merge"), "anchor", "left_semi") for name, _ in manifest["levels"]]
        known = written(met[0] if len(met) == 1 else _union(met), "met") if met else None
        shared = once.where("lo < hi").select("anchor")
        if known is not None:
            shared = shared.unionByName(known.select("anchor")).distinct()
        mine = written(windows(batch.join(shared, "anchor", "left_semi"), "rk", "doc_id", "at"), "windows")
        all_windows = mine.select("w", F.col("doc_id").alias("least"))
        if known is not None:
            all_windows = all_windows.unionByName(windows(known, "least").select("w", "least"))
        first = all_windows.groupBy("w").agg(F.min("least").alias("least"))
        hits = mine.join(first, "w").where("least < doc_id").select("rk", (F.col("at") + F.col("k")).alias("lo")).distinct()
        order = Window.partitionBy("rk").orderBy("lo")
        begins = F.coalesce(F.col("lo") - F.lag("lo").over(order) > SPAN, F.lit(True)).cast("int")
        runs = hits.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(order)).groupBy("rk", "_run").agg(F.min("lo").alias("lo"), (F.max("lo") + SPAN).alias("hi"))
        spans = runs.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))

        def cut(rows):
            out = []
            for data, found in rows:
                kept, at = [], 0
                for s in found or []:
                    kept.append((data or b"")[at : s["lo"]])
                    at = s["hi"]
                kept = b"".join([*kept, (data or b"")[at:]])
                n = len(data or b"")
                out.append((n, n - len(kept), len(found or []), sha256(kept).hexdigest()))
            return out

        result = written(add_columns(own.join(spans, "rk", "left").select("doc_id", "text", "spans"), DIGESTS, cut, ["text", "spans"]).drop("text", "spans"), "digests")
        self._commit(number, manifest, batch, last)
        return result

    def _commit(self, number: int, manifest: dict, batch: DataFrame, last: int | None) -> None:
        levels = list(manifest["levels"])
        new = self._put(batch.groupBy("anchor", "text").agg(F.min("doc_id").alias("least")))
        if not new[1]:
            return
        while levels and levels[-1][1] <= 2 * new[1]:
            both = _union([self._level(levels.pop()[0]), self._level(new[0])])
            new = self._put(both.groupBy("anchor", "text").agg(F.min("least").alias("least")))
        levels.append(new)
        known = [x for x in (last, manifest["last"]) if x is not None]
        stream = self._fs.create(self._hadoop.Path(f"{self.path}/manifests/{number + 1}"), False)
        stream.write(json.dumps({"last": max(known, default=None), "levels": levels}).encode())
        stream.close()


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
