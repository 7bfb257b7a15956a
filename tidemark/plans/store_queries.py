"""Queries that go by way of files: what a table becomes when it is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import plugins
from ..functions import scalars as S
from ..operators import frames as O
from ..operators import jobs as J
from ..operators import sessions
from ..sources import files
from ..storage import shared_dir
from . import domain as D
from .frame_queries import _STATS

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "metric_files",
    """SELECT l_suppkey AS run, count(*) AS epochs, min(l_extendedprice)::DOUBLE AS best, max(l_extendedprice)::DOUBLE AS worst FROM lineitem GROUP BY 1""",
)
def metric_files(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of runs, written as JSON and read back."""
    price = F.col("l_extendedprice").cast("double")
    metrics = D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.count(F.lit(1)).alias("epochs"), F.min(price).alias("best"), F.max(price).alias("worst"))
    files.write_metrics(metrics, path := _place(spark, "metrics"))
    return spark.read.schema(metrics.schema).json(path)


@query(
    "job_log_files",
    f"""WITH {D.JOB_EVENTS} SELECT job_id::VARCHAR AS job_id, retry_count, status, progress, error FROM job_now""",
)
def job_log_files(spark: SparkSession, d: str) -> DataFrame:
    """The job log, appended to files in two parts, and its state from them."""
    log = D.job_events(spark, d).withColumns({
        "job_id": F.col("job_id").cast("string"), "at": F.timestamp_micros("seq.us"), "seq": F.col("seq.us"),
        "results": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string"),
    })
    path, early = _place(spark, "jobs"), F.col("seq") % 2 == 0
    for part in (~early, early):
        files.append_events(log.where(part), path)
    return J.current(files.job_events(spark, path)).select("job_id", "retry_count", "status", "progress", "error")


@query(
    "json_texts",
    """SELECT event_id, '{"duration_seconds":' || (event_id % 50) || '.5,"fps":' || (24 + event_id % 3) || '.0}' AS metadata FROM events""",
)
def json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Nested values as JSON texts."""
    metadata = F.struct((F.col("event_id") % 50 + 0.5).cast("double").alias("duration_seconds"), (24 + F.col("event_id") % 3).cast("double").alias("fps"))
    return files.as_json(D.table(spark, d, "events").select("event_id", metadata.alias("metadata")), "metadata")


@query(
    "scored_frames",
    f"""WITH {D.PIXELS}, {_STATS}, n AS (SELECT *, count(*) OVER (PARTITION BY analysis_id) AS n FROM s)
SELECT analysis_id, frame_index, CASE WHEN mean * 40 < 50 OR dev * 4 < 20 THEN 0 WHEN mean * 40 < 100 OR dev * 4 < 40 THEN 1 WHEN mean * 40 < 170 THEN 2 ELSE 3 END AS score,
  CASE WHEN frame_index = 0 OR change * 3 < 30 THEN 'stationary' WHEN low_shift * 3 > top_shift * 3 + 2 THEN 'insertion'
    WHEN top_shift * 3 > low_shift * 3 + 2 THEN 'withdrawal' WHEN frame_index % 2 = 0 THEN 'insertion' ELSE 'withdrawal' END AS direction,
  CASE WHEN frame_index * 10 < n * 2 THEN 'esophagus' WHEN frame_index * 10 < n * 7 THEN 'stomach' ELSE 'duodenum' END AS region FROM n""",
)
def scored_frames(spark: SparkSession, d: str) -> DataFrame:
    """Score, direction and region of frames by the named plug-ins."""
    stats = O.pixel_statistics(D.pixel_frames(spark, d))
    scaled = stats.withColumns({**{c: F.col(c) * 3 for c in ("change", "top_shift", "lower_shift")}, "brightness": F.col("brightness") * 40, "contrast": F.col("contrast") * 4})
    counts = D.pixel_frames(spark, d).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("dur_us"))
    timed = scaled.join(counts, "analysis_id").withColumn("t_us", F.col("frame_index"))
    return api.score_frames(timed).select("analysis_id", "frame_index", "score", "direction", "region")


@query(
    "session_inserts",
    f"""WITH {D.SESSIONS} SELECT CASE WHEN id % 7 = 0 THEN 'live_' || id ELSE 'a_' || id END AS analysis_id, user_id, filename,
  CASE WHEN id % 7 = 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN id % 7 = 0 THEN overall_score END AS overall_score,
  CASE WHEN id % 7 = 0 THEN created_at END AS completed_at FROM sessions""",
)
def session_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Admitted uploads begin as processing, stored live sessions as completed."""
    rows = D.sessions(spark, d)
    uploads = rows.where("id % 7 <> 0").select("id", "user_id", "filename", "created_at")
    live = rows.where("id % 7 = 0").select("id", "user_id", "filename", "created_at", "overall_score")
    return sessions.inserted(uploads, live).select("analysis_id", "user_id", "filename", "status", "overall_score", "completed_at")


@query(
    "elapsed",
    """SELECT event_id, floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) / 1000.0 * 10 + 0.5) / 10 AS ms FROM events""",
)
def elapsed(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds since a user's event before."""
    from pyspark.sql import Window

    at = F.col("ts").cast("timestamp")
    before = F.lag(at).over(Window.partitionBy("user_id").orderBy(at, "event_id"))
    return D.table(spark, d, "events").select("event_id", S.elapsed_ms(before, at).alias("ms"))


@query(
    "model_files",
    """WITH m AS (SELECT c_mktsegment AS label, floor(avg(c_acctbal))::DOUBLE AS centre FROM customer GROUP BY 1)
SELECT c_custkey, arg_min(label, row(abs(c_acctbal::DOUBLE - centre), label)) AS label FROM customer, m GROUP BY c_custkey""",
)
def model_files(spark: SparkSession, d: str) -> DataFrame:
    """A model of segment centres, saved to a file and loaded by each worker: the nearest centre."""
    customers = D.table(spark, d, "customer")
    centres = customers.groupBy(F.col("c_mktsegment").alias("label")).agg(F.floor(F.avg("c_acctbal")).cast("double").alias("centre"))
    path = plugins.save_model(spark, {r["label"]: r["centre"] for r in centres.collect()}, _place(spark, "model"))  # a row for each segment
    nearest = plugins.file_model(spark, path, _nearest, "string")
    return customers.select("c_custkey", nearest(F.col("c_acctbal").cast("double")).alias("label"))


def _nearest(centres: dict):
    """The loaded model: a function of a batch."""
    ordered = sorted(centres.items())
    return lambda batch: batch.map(lambda x: min(ordered, key=lambda c: (abs(x - c[1]), c[0]))[0])
