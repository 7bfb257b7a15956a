"""The job queue as a log of events, and the folds that give its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RETRIES = 3
#: Where a claim is, backwards, and whose it is.
CLAIM = "struct<back:bigint,version:bigint,token:string>"


def folded(events: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """What the log says of each job, in a form that can be folded on: counts, and values with
    the places (seq) that they have in it. ``snapshot`` is such a table, of the log before
    ``events``. An aggregation with partial sums: no job's log is gathered.

    Where claims carry a ``token`` and the ``version`` of the log that they came in with, of
    several at one place the one with the least (version, token) owns the job."""
    seq, tokens = F.col("seq"), "token" in events.columns
    version = F.col("version") if "version" in events.columns else F.lit(0)

    def latest(value: str, when: Column) -> Column:
        return F.max(F.when(when, F.struct(seq.alias("seq"), F.col(value).alias("value"))))

    claim = F.struct((-seq).alias("back"), version.cast("bigint").alias("version"), F.col("token").alias("token")) if tokens else F.lit(None).cast(CLAIM)
    at = F.col("at") if "at" in events.columns else F.lit(None).cast("timestamp")
    parts = events.groupBy("job_id").agg(
        F.count_if(F.col("kind").isin("failed", "recovered")).alias("retry_count"),
        latest("kind", F.col("kind") != "progress").alias("last"),
        latest("progress", F.col("progress").isNotNull()).alias("mark"),
        latest("error", F.col("kind") == "failed").alias("lost"),
        F.min(F.when(F.col("kind") == "created", seq)).alias("created_seq"),
        F.min(F.when(F.col("kind") == "created", at)).alias("created_at"),
        F.max(seq).alias("last_seq"),
        F.min(F.when(F.col("kind") == "claimed", claim)).alias("claim"),
    )
    if snapshot is None:
        return parts
    both = parts.unionByName(snapshot).groupBy("job_id")
    return both.agg(
        F.sum("retry_count").alias("retry_count"), *(F.max(c).alias(c) for c in ("last", "mark", "lost")),
        F.min("created_seq").alias("created_seq"), F.min("created_at").alias("created_at"), F.max("last_seq").alias("last_seq"), F.min("claim").alias("claim"),
    )


def current(events: DataFrame, most: int = MAX_RETRIES, snapshot: DataFrame | None = None) -> DataFrame:
    """The state of each job from its events (job_id, seq, kind, progress, error), on from a snapshot."""
    return states(folded(events, snapshot), most)


def states(parts: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """The states that a fold tells. created, retried and recovered leave a job queued, claimed makes
    it processing, completed completes it; a failure adds a retry, and queues it again below ``most``.
    ``owner`` is the token of the claim that holds a running job."""
    last = F.col("last.value")
    status = (
        F.when(last == "claimed", "processing")
        .when(last == "completed", "completed")
        .when((last == "failed") & (F.col("retry_count") >= most), "failed")
        .otherwise("queued")
    )
    return parts.select(
        "job_id", "retry_count",
        F.when(status == "completed", 1.0).otherwise(F.coalesce("mark.value", F.lit(0.0))).alias("progress"),
        F.col("lost.value").alias("error"), "created_seq", "created_at", "last_seq",
        F.when(status == "processing", F.col("claim.token")).alias("owner"), status.alias("status"),
    )


def recovered(jobs: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """After a crash, running jobs are queued again with a retry more; those that
    have none left stay as they are."""
    again = (F.col("status") == "processing") & (F.col("retry_count") < most)
    return jobs.withColumns({
        "status": F.when(again, "queued").otherwise(F.col("status")),
        "retry_count": F.col("retry_count") + again.cast("int"),
    })


def head(jobs: DataFrame, order: str, slots: int = 1) -> DataFrame:
    """The oldest queued jobs."""
    return jobs.where("status = 'queued'").orderBy(order, "job_id").limit(slots)


def enqueued(uploads: DataFrame, job_id: str, at: str) -> DataFrame:
    """The events that create jobs; all else about a new job follows from the fold."""
    return uploads.select(
        F.col(job_id).alias("job_id"), F.lit(0).cast("bigint").alias("seq"), F.col(at).alias("at"), F.lit("created").alias("kind"),
        F.lit(None).cast("double").alias("progress"), *(F.lit(None).cast("string").alias(c) for c in ("error", "results", "metadata")),
    )


def _events(like: DataFrame, chosen: DataFrame, kind: str, *names: str) -> DataFrame:
    """One event more for each chosen job (with its state's ``last_seq``), in the columns of
    the log; ``names`` are taken from ``chosen``, other columns are null."""
    given = {"job_id": F.col("job_id"), "seq": F.col("last_seq") + 1, "kind": F.lit(kind), **{c: F.col(c) for c in names}}
    return chosen.select(*(given.get(x.name, F.lit(None)).cast(x.dataType).alias(x.name) for x in like.schema.fields))


def claimed(events: DataFrame, order: str = "created_seq", slots: int = 1, token: str | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """The events by which a worker takes the oldest queued jobs. Workers who claim from the same
    log choose the same jobs; ``token`` tells their claims apart, and the fold settles them."""
    chosen = head(current(events, snapshot=snapshot), order, slots).withColumn("token", F.lit(token))
    return _events(events, chosen, "claimed", *(["token"] if "token" in events.columns else []))


def failed(events: DataFrame, attempts: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The events of failed attempts (job_id, error) of running jobs; others are left out. A job
    fails once until it is claimed again: of several attempts the one with the least error counts."""
    running = current(events, snapshot=snapshot).where("status = 'processing'").drop("error", "progress")
    once = attempts.groupBy("job_id").agg(F.min("error").alias("error"))
    return _events(events, once.join(running, "job_id"), "failed", "error")


def recoveries(events: DataFrame, most: int = MAX_RETRIES, snapshot: DataFrame | None = None) -> DataFrame:
    """The events by which a restarted service queues running jobs again, with a retry more; those
    that have none left stay as they are."""
    running = current(events, most, snapshot).where((F.col("status") == "processing") & (F.col("retry_count") < most))
    return _events(events, running, "recovered")


def advanced(events: DataFrame, marks: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The events of progress (job_id, progress between 0 and 1); of several marks of a job the furthest."""
    once = marks.where(F.col("progress").between(0, 1)).groupBy("job_id").agg(F.max("progress").alias("progress"))
    known = current(events, snapshot=snapshot).select("job_id", "last_seq")
    return _events(events, once.join(known, "job_id"), "progress", "progress")


def completed(events: DataFrame, results: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """The events that complete running jobs (job_id, results, metadata as JSON texts)."""
    running = current(events, snapshot=snapshot).where("status = 'processing'").select("job_id", "last_seq")
    once = results.groupBy("job_id").agg(F.min(F.struct("results", "metadata")).alias("_r")).select("job_id", "_r.*")
    return _events(events, once.join(running, "job_id"), "completed", "results", "metadata")


def free_slots(items: DataFrame, order: str, most: int = 3) -> DataFrame:
    """The first pending items for the slots that active ones leave."""
    from pyspark.sql import Window

    active = items.agg(F.count_if(F.col("status").isin("uploading", "processing")).alias("_active"))
    # ``most`` rows are enough, as no more can start
    first = items.where("status = 'pending'").orderBy(order).limit(most)
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(order)))
    return ranked.crossJoin(F.broadcast(active)).where(F.col("_rank") <= most - F.col("_active")).drop("_rank", "_active")
