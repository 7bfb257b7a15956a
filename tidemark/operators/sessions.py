"""Sessions and users: search, pages, counts, quotas, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

STATUSES = {"processing": ["processing", "queued"], "completed": ["completed"], "failed": ["failed"]}
PERIODS = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 30 DAYS"}
PAGE, LARGEST_PAGE = 24, 100


def filtered(
    sessions: DataFrame,
    user=None,
    status: str | None = None,
    search: str | None = None,
    scores: list[int] | None = None,
    since: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """A user's sessions. An unknown status or period filters nothing; sessions
    without a score match no score."""
    out = sessions
    if user is not None:
        out = out.where(F.col("user_id") == user)
    if status in STATUSES:
        out = out.where(F.col("status").isin(STATUSES[status]))
    if search:
        out = out.where(F.col("filename").contains(search))
    if scores:
        out = out.where(F.col("overall_score").isin(scores))
    if since == "today":
        out = out.where(F.col("created_at") >= F.date_trunc("day", now))
    elif since in PERIODS:
        out = out.where(F.col("created_at") >= now - F.expr(PERIODS[since]))
    return out


def ordered(sessions: DataFrame, sort: str = "date-desc") -> DataFrame:
    """Five orders; unknown ones mean the newest first. Missing scores come last
    upwards and first downwards; ids break ties, so that pages are stable."""
    date, score = F.col("created_at"), F.col("overall_score")
    key = {
        "date-asc": date.asc_nulls_last(),
        "score-asc": score.asc_nulls_last(),
        "score-desc": score.desc_nulls_first(),
        "name": F.col("filename").asc_nulls_last(),
    }.get(sort, date.desc_nulls_first())
    return sessions.orderBy(key, F.col("id").asc())


def page(sessions: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    number, size = max(1, number), min(LARGEST_PAGE, max(1, size))
    return sessions.offset((number - 1) * size).limit(size)


def page_count(total: Column, size: int = PAGE) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


def list_sessions(sessions: DataFrame, sort: str = "date-desc", number: int = 1, size: int = PAGE, **filters) -> DataFrame:
    return page(ordered(filtered(sessions, **filters), sort), number, size)


def status_counts(sessions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status in one pass."""
    s = F.col("status")
    return sessions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("all"),
        F.count_if(s.isin(STATUSES["processing"])).alias("processing"),
        F.count_if(s == "completed").alias("completed"),
        F.count_if(s == "failed").alias("failed"),
    )


def search_users(users: DataFrame, text: str | None) -> DataFrame:
    """Users whose mail or name contains the text, newest first."""
    if text:
        users = users.where(F.col("email").contains(text) | F.col("name").contains(text))
    return users.orderBy(F.col("created_at").desc_nulls_first(), "id")


def users_with_counts(users: DataFrame, sessions: DataFrame) -> DataFrame:
    counts = sessions.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n_sessions"))
    return users.join(counts, "id", "left").withColumn("n_sessions", F.coalesce("n_sessions", F.lit(0)))


def with_usage(users: DataFrame, count: str, limit: str) -> DataFrame:
    percent = S.usage_percent(F.col(count), F.col(limit))
    return users.withColumn("usage", percent).withColumn("band", S.usage_band(F.col("usage")))


def refreshed(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sessions take over what finished jobs know; others stay as they are."""
    joined = sessions.alias("s").join(jobs.alias("j"), F.col("s.analysis_id") == F.col("j.job_id"), "left")
    done = F.col("j.status").isin("completed", "failed")
    taken = {
        "status": F.when(done, F.col("j.status")).otherwise(F.col("s.status")),
        "overall_score": F.when(done, F.coalesce("j.score", "s.overall_score")).otherwise(F.col("s.overall_score")),
        "frames_analyzed": F.when(done, F.coalesce("j.frames", "s.frames_analyzed")).otherwise(F.col("s.frames_analyzed")),
    }
    return joined.select(*(taken[c].alias(c) if c in taken else F.col(f"s.{c}") for c in sessions.columns))


def not_listed(uploads: DataFrame, sessions: DataFrame) -> DataFrame:
    """A client's uploads that are not over and that the server doesn't list yet;
    those without an analysis_id stay."""
    open_ones = uploads.where(~F.col("status").isin("completed", "failed"))
    return open_ones.join(sessions.select("analysis_id"), "analysis_id", "left_anti")


def admitted(attempts: DataFrame, limit: str = "upload_limit") -> DataFrame:
    """Attempts in order against each user's limit; -1 is none."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    ordinal = F.row_number().over(w)
    return attempts.withColumn("ordinal", ordinal.cast("bigint")).withColumn(
        "accepted", (F.col(limit) == -1) | (F.col("ordinal") <= F.col(limit))
    )


def released(users: DataFrame, failures: DataFrame) -> DataFrame:
    """Give back a slot for each failed upload, down to none."""
    n = failures.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        users.join(n, "id", "left")
        .withColumn("upload_count", F.greatest(F.col("upload_count") - F.coalesce("_n", F.lit(0)), F.lit(0)))
        .drop("_n")
    )


def without_users(sessions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sessions of deleted users go with them."""
    return sessions.join(deleted.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def deleted(sessions: DataFrame, user, ids: DataFrame | None = None, failed: bool = False) -> DataFrame:
    """What is left after a user deleted own sessions: those in ``ids``, or the failed."""
    own = F.col("user_id") == user
    if failed:
        return sessions.where(~(own & (F.col("status") == "failed")))
    target = ids.select(F.col("id"), F.lit(user).alias("user_id"))
    return sessions.join(target, ["id", "user_id"], "left_anti")


def patched(users: DataFrame, patches: DataFrame, actor=None) -> DataFrame:
    """Sparse patches: given columns replace old ones, a name may be set to null;
    nobody takes away their own role of administrator."""
    p = patches.select("id", *(F.col(c).alias(f"_{c}") for c in patches.columns if c != "id"))
    out = users.join(p, "id", "left")
    role = F.coalesce("_role", "role")
    if actor is not None:
        role = F.when((F.col("id") == actor) & (F.col("role") == "ADMIN"), F.col("role")).otherwise(role)
    return out.select(
        "id",
        F.coalesce("_email", "email").alias("email"),
        F.when(F.coalesce("_set_name", F.lit(False)), F.col("_name")).otherwise(F.col("name")).alias("name"),
        role.alias("role"),
        F.coalesce("_upload_limit", "upload_limit").alias("upload_limit"),
    )


def deleted_users(users: DataFrame, ids: DataFrame, actor) -> DataFrame:
    """Users that are left after an administrator deleted those in ``ids``; nobody deletes
    the own account."""
    return users.join(ids.where(F.col("id") != actor).select("id"), "id", "left_anti")


def seeded(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert what is not there yet."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def failed_attempts(uploads: DataFrame, at: str) -> DataFrame:
    """Refused uploads (those with a ``reason``) as session records: failed at once, with an id of
    their own that no analysis has. The id follows from the time and the upload, so that it is
    the same when the batch is run again."""
    attempt = F.concat_ws("_", F.lit("fail"), F.unix_millis(at).cast("string"), F.col("id").cast("string"))
    return uploads.where("reason IS NOT NULL").withColumns({"analysis_id": attempt, "status": F.lit("failed"), "completed_at": F.col(at)})


TIMELINE_JSON = "array<struct<frame_index:bigint,timestamp:double,motion:string,region:string,peace_score:int,confidence:double>>"


def live_detail(sessions: DataFrame) -> DataFrame:
    """Stored live sessions in the shape of an analysis: progress is 100, the confidence 1, regions
    and segments are empty, and there are results only where there is a score."""
    score = F.col("overall_score")
    overall = F.struct(score.alias("score"), S.label(score).alias("label"), F.lit(1.0).alias("confidence"))
    results = F.struct(
        F.struct(overall.alias("overall"), F.create_map().cast("map<string,string>").alias("by_region")).alias("peace_scores"),
        F.array().cast("array<struct<start_time:double,end_time:double,direction:string,confidence:double>>").alias("segments"),
        F.coalesce(F.from_json("timeline_data", TIMELINE_JSON), F.array().cast(TIMELINE_JSON)).alias("timeline"),
    )
    n = F.coalesce(F.col("frames_analyzed").cast("bigint"), F.lit(0))
    metadata = F.struct(
        F.coalesce("duration", F.lit(0.0)).alias("duration_seconds"), F.lit(0.0).alias("fps"), F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")).alias("resolution"),
        n.alias("total_frames"), n.alias("analyzed_frames"),
    )
    return sessions.select(
        "id", "analysis_id", "status", F.lit(100).alias("progress"), F.when(score.isNotNull(), results).alias("results"), metadata.alias("video_metadata"), "created_at", "completed_at"
    )


def counters(**tables: DataFrame) -> DataFrame:
    """One row: the rows of each table, by its name."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar().alias(name) for name, df in tables.items()]
    return next(iter(tables.values())).sparkSession.range(1).select(*counts)


def inserted(uploads: DataFrame, live: DataFrame) -> DataFrame:
    """New session records: of admitted uploads (id, user_id, filename, created_at), which begin as
    processing and without numbers, and of live sessions that are stored when they end."""
    begun = uploads.withColumns({"analysis_id": F.concat(F.lit("a_"), F.col("id").cast("string")), "status": F.lit("processing")})
    ended = live.withColumns({
        "analysis_id": F.concat(F.lit("live_"), F.col("id").cast("string")), "status": F.lit("completed"), "completed_at": F.col("created_at"),
    })
    return begun.unionByName(ended, allowMissingColumns=True)
