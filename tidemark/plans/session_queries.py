"""Queries over sessions, users, jobs and uploads: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import series, upload_slots
from ..operators import rollups as R
from ..operators import sessions as O
from ..operators import sets as T
from . import domain as D

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


NOW = "2000-03-15 10:30:00"
_COLUMNS = ["id", "filename", "status", "overall_score"]
_PAGE = "id, filename, status, overall_score"


def _listing(name: str, where: str, order: str, limit: int, offset: int, /, **arguments):
    """Register a page of the listing."""
    sql = f"WITH {D.SESSIONS} SELECT {_PAGE} FROM sessions WHERE {where} ORDER BY {order}, id LIMIT {limit} OFFSET {offset}"

    @query(name, sql)
    def listing(spark: SparkSession, d: str) -> DataFrame:
        given = dict(arguments)
        if "since" in given:
            given["now"] = F.lit(NOW).cast("timestamp")
        return O.list_sessions(D.sessions(spark, d), **given).select(*_COLUMNS)


_listing("list_sessions_by_date", "true", "created_at DESC NULLS FIRST", 24, 0)
_listing("list_sessions_oldest", "status = 'failed'", "created_at ASC NULLS LAST", 100, 100, status="failed", sort="date-asc", number=2, size=500)
_listing(
    "list_sessions_processing", "status IN ('processing', 'queued')", "overall_score DESC NULLS FIRST", 50, 50,
    status="processing", sort="score-desc", number=2, size=50,
)
_listing("list_sessions_by_score", "overall_score IN (1, 3)", "overall_score ASC NULLS LAST", 24, 24, scores=[1, 3], sort="score-asc", number=2)
_listing("list_sessions_search", "contains(filename, 'high_1')", "filename ASC NULLS LAST", 30, 0, search="high_1", sort="name", size=30)
_listing("list_sessions_today", f"created_at >= date_trunc('day', TIMESTAMP '{NOW}')", "created_at ASC", 24, 0, since="today", sort="date-asc")
_listing("list_sessions_week", f"created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS", "created_at ASC", 24, 0, since="week", sort="date-asc", number=0)
_listing("list_sessions_month", f"created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS", "created_at ASC", 1, 0, since="month", sort="date-asc", size=0)
_listing("list_sessions_of_user", "user_id = 7", "created_at DESC", 24, 0, user=7, status="unknown", sort="unknown")


@query(
    "status_counts",
    f"""WITH {D.SESSIONS}
SELECT user_id, count(*) AS "all", count(*) FILTER (status IN ('processing', 'queued')) AS processing,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed
FROM sessions GROUP BY user_id""",
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.status_counts(D.sessions(spark, d), ["user_id"])


@query(
    "page_counts",
    f"""WITH {D.SESSIONS}
SELECT user_id, greatest(1, ceil(count(*) / 3))::BIGINT AS pages FROM sessions GROUP BY user_id""",
)
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = O.status_counts(D.sessions(spark, d), ["user_id"])
    return counts.select("user_id", O.page_count(F.col("all"), 3).cast("bigint").alias("pages"))


@query(
    "tab_totals",
    f"""WITH {D.SESSIONS}
SELECT s.n + u.n AS "all", s.p + u.n AS processing, s.c AS completed
FROM (SELECT count(*) AS n, count(*) FILTER (status = 'processing') AS p, count(*) FILTER (status = 'completed') AS c FROM sessions) s,
 (SELECT count(*) AS n FROM events WHERE event_type = 'signup') u""",
)
def tab_totals(spark: SparkSession, d: str) -> DataFrame:
    pending = D.table(spark, d, "events").where("event_type = 'signup'").agg(F.count(F.lit(1)).alias("pending"))
    server = O.status_counts(D.sessions(spark, d))
    return server.crossJoin(F.broadcast(pending)).select(  # a row on either side
        (F.col("all") + F.col("pending")).alias("all"), (F.col("processing") + F.col("pending")).alias("processing"), "completed"
    )


@query(
    "user_search",
    f"""WITH {D.USERS}
SELECT id, email, name FROM users WHERE contains(email, '00012') OR contains(name, '99')""",
)
def user_search(spark: SparkSession, d: str) -> DataFrame:
    by_mail = O.search_users(D.users(spark, d), "00012").select("id", "email", "name")
    by_name = O.search_users(D.users(spark, d), "99").select("id", "email", "name")
    return T.appended(by_mail, by_name).distinct()


@query(
    "users_with_counts",
    f"""WITH {D.USERS}, {D.SESSIONS}
SELECT users.id, email, count(sessions.id) AS n_sessions FROM users LEFT JOIN sessions ON user_id = users.id GROUP BY ALL""",
)
def users_with_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.users_with_counts(D.users(spark, d).select("id", "email"), D.sessions(spark, d))


@query(
    "usage_percent",
    f"""WITH {D.USERS}, {D.SESSIONS}, c AS (
  SELECT users.id, upload_limit, count(sessions.id) AS n FROM users LEFT JOIN sessions ON user_id = users.id GROUP BY ALL
), u AS (
  SELECT id, CASE WHEN upload_limit = -1 THEN 0.0 WHEN upload_limit = 0 THEN 100.0 ELSE least(100.0::DOUBLE, 100.0::DOUBLE * n / upload_limit) END::DOUBLE AS usage FROM c
)
SELECT id, usage, CASE WHEN usage >= 100 THEN 'full' WHEN usage >= 80 THEN 'high' ELSE 'ok' END AS band FROM u""",
)
def usage_percent(spark: SparkSession, d: str) -> DataFrame:
    counted = O.users_with_counts(D.users(spark, d), D.sessions(spark, d))
    return O.with_usage(counted, "n_sessions", "upload_limit").select("id", "usage", "band")


@query(
    "session_refresh",
    f"""WITH {D.SESSIONS}, {D.JOBS}
SELECT s.id, CASE WHEN j.status IN ('completed', 'failed') THEN j.status ELSE s.status END AS status,
  CASE WHEN j.status IN ('completed', 'failed') THEN coalesce(j.score, s.overall_score) ELSE s.overall_score END AS overall_score,
  CASE WHEN j.status IN ('completed', 'failed') THEN j.frames END AS frames_analyzed
FROM sessions s LEFT JOIN jobs j ON s.analysis_id = j.job_id""",
)
def session_refresh(spark: SparkSession, d: str) -> DataFrame:
    return O.refreshed(D.sessions(spark, d), D.jobs(spark, d)).select("id", "status", "overall_score", "frames_analyzed")


@query(
    "session_detail",
    f"""WITH {D.SESSIONS}
SELECT id, analysis_id, CASE WHEN starts_with(analysis_id, 'live_') THEN 'live' ELSE 'batch' END AS kind,
  CASE WHEN status = 'completed' AND overall_score IS NOT NULL THEN {D.LABEL.format("overall_score")} END AS label,
  CASE WHEN starts_with(analysis_id, 'live_') THEN 100 WHEN status = 'completed' THEN 1 ELSE 0 END AS progress
FROM sessions""",
)
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import scalars as S

    live = S.is_live(F.col("analysis_id"))
    done = (F.col("status") == "completed") & F.col("overall_score").isNotNull()
    return D.sessions(spark, d).select(
        "id",
        "analysis_id",
        F.when(live, "live").otherwise("batch").alias("kind"),
        F.when(done, S.label(F.col("overall_score"))).alias("label"),
        F.when(live, 100).when(F.col("status") == "completed", 1).otherwise(0).alias("progress"),
    )


@query(
    "uploads_not_listed",
    f"""WITH {D.SESSIONS}, {D.JOBS}, u AS (
  SELECT nullif(job_id, 'a_1') AS analysis_id, status, frames FROM jobs
)
SELECT analysis_id, status, frames FROM u WHERE status NOT IN ('completed', 'failed') AND (analysis_id IS NULL OR analysis_id NOT IN
  (SELECT analysis_id FROM sessions WHERE status = 'completed'))""",
)
def uploads_not_listed(spark: SparkSession, d: str) -> DataFrame:
    uploads = D.jobs(spark, d).select(F.nullif("job_id", F.lit("a_1")).alias("analysis_id"), "status", "frames")
    return O.not_listed(uploads, D.sessions(spark, d).where("status = 'completed'"))


@query("ids_semi", f"WITH {D.SESSIONS} SELECT id, status FROM sessions WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def ids_semi(spark: SparkSession, d: str) -> DataFrame:
    ids = D.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return T.members(D.sessions(spark, d), ids, "id").select("id", "status")


@query(
    "email_exists",
    f"""WITH {D.USERS} SELECT id, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey * 3 = users.id AND s_nationkey <> created_at) AS taken FROM users""",
)
def email_exists(spark: SparkSession, d: str) -> DataFrame:
    users = D.users(spark, d)
    others = D.table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_nationkey").alias("other"))
    taken = users.join(others, "id").where("created_at <> other").select("id").distinct().withColumn("_taken", F.lit(True))
    return users.join(taken, "id", "left").select("id", F.coalesce("_taken", F.lit(False)).alias("taken"))


@query(
    "point_lookup",
    f"WITH {D.SESSIONS} SELECT id, analysis_id, filename, status FROM sessions WHERE analysis_id = 'live_700'",
)
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return D.sessions(spark, d).where("analysis_id = 'live_700'").select("id", "analysis_id", "filename", "status").limit(1)


@query(
    "batch_rollup",
    f"""WITH {D.SESSIONS}
SELECT user_id, bool_or(status IN ('pending', 'uploading', 'queued', 'processing')) AS any_active,
  bool_and(status IN ('completed', 'failed')) AS all_terminal, count(*) FILTER (status = 'completed') AS completed, count(*) AS total
FROM sessions GROUP BY user_id""",
)
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.batch_rollup(D.sessions(spark, d), "user_id")


@query(
    "quota_admission",
    f"""WITH {D.SESSIONS}, {D.USERS}, o AS (
  SELECT s.id, s.user_id, u.upload_limit, row_number() OVER (PARTITION BY s.user_id ORDER BY s.created_at, s.id) AS ordinal
  FROM sessions s JOIN users u ON u.id = s.user_id
)
SELECT id, user_id, ordinal, upload_limit = -1 OR ordinal <= upload_limit AS accepted FROM o""",
)
def quota_admission(spark: SparkSession, d: str) -> DataFrame:
    limits = D.users(spark, d).select(F.col("id").alias("user_id"), "upload_limit")
    attempts = D.sessions(spark, d).select("id", "user_id", "created_at").join(limits, "user_id")
    return O.admitted(attempts).select("id", "user_id", "ordinal", "accepted")


@query(
    "quota_release",
    f"""WITH {D.SESSIONS}, {D.USERS}
SELECT users.id, greatest(3 - count(sessions.id), 0) AS upload_count FROM users LEFT JOIN sessions ON user_id = users.id AND status = 'failed' GROUP BY users.id""",
)
def quota_release(spark: SparkSession, d: str) -> DataFrame:
    users = D.users(spark, d).select("id", F.lit(3).cast("bigint").alias("upload_count"))
    return O.released(users, D.sessions(spark, d).where("status = 'failed'"))


@query(
    "job_retry_fold",
    f"""WITH {D.JOB_EVENTS} SELECT job_id, retry_count, status, progress, error FROM job_now""",
)
def job_retry_fold(spark: SparkSession, d: str) -> DataFrame:
    return J.current(D.job_events(spark, d)).select("job_id", "retry_count", "status", "progress", "error")


@query(
    "job_recovery",
    f"""WITH {D.JOB_EVENTS}
SELECT job_id, CASE WHEN status = 'processing' AND retry_count < 12 THEN 'queued' ELSE status END AS status,
  retry_count + (status = 'processing' AND retry_count < 12)::INT AS retry_count
FROM job_now""",
)
def job_recovery(spark: SparkSession, d: str) -> DataFrame:
    log = _numbered(spark, d)
    return J.current(log.unionByName(J.recoveries(log, most=12)), most=3).select("job_id", "status", "retry_count")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """The log with whole numbers for its order."""
    return D.job_events(spark, d).withColumn("seq", F.col("seq.us"))


@query(
    "job_claim",
    f"""WITH {D.JOB_EVENTS}, h AS (SELECT job_id FROM job_now WHERE status = 'queued' ORDER BY retry_count, job_id LIMIT 3)
SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM h) THEN 'processing' ELSE status END AS status, retry_count FROM job_now""",
)
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    log = _numbered(spark, d)
    return J.current(log.unionByName(J.claimed(log, "retry_count", slots=3))).select("job_id", "status", "retry_count")


@query(
    "job_claims_settled",
    f"""WITH {D.JOB_EVENTS}, h AS (SELECT job_id, row_number() OVER (ORDER BY retry_count, job_id) AS r FROM job_now WHERE status = 'queued')
SELECT job_id, CASE WHEN r <= 7 THEN 'processing' ELSE job_now.status END AS status, CASE WHEN r <= 3 THEN 'w1' WHEN r <= 7 THEN 'w0' END AS owner
FROM job_now LEFT JOIN h USING (job_id)""",
)
def job_claims_settled(spark: SparkSession, d: str) -> DataFrame:
    """Two workers claim from the same log, 3 and 7 jobs; the first one's commit has the lower version."""
    log = _numbered(spark, d).withColumns({"token": F.lit(None).cast("string"), "version": F.lit(0)})
    claims = [J.claimed(log, "retry_count", n, f"w{2 - v}").withColumn("version", F.lit(v)) for v, n in ((1, 3), (2, 7))]
    return J.current(log.unionByName(claims[0]).unionByName(claims[1])).select("job_id", "status", "owner")


@query(
    "job_snapshot_fold",
    f"""WITH {D.JOB_EVENTS} SELECT job_id, retry_count, status, progress, error FROM job_now""",
)
def job_snapshot_fold(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of the earlier part of the log, folded on with the rest."""
    log = D.job_events(spark, d)
    early = F.col("seq.event_id") % 3 > 0  # any part will do: places tell the order
    return J.current(log.where(~early), snapshot=J.folded(log.where(early))).select("job_id", "retry_count", "status", "progress", "error")


@query(
    "job_failure",
    f"""WITH {D.JOB_EVENTS}
SELECT job_id, CASE WHEN status <> 'processing' THEN status WHEN retry_count + 1 >= 3 THEN 'failed' ELSE 'queued' END AS status,
  retry_count + (status = 'processing')::INT AS retry_count, CASE WHEN status = 'processing' THEN 'lost ' || job_id ELSE error END AS error FROM job_now""",
)
def job_failure(spark: SparkSession, d: str) -> DataFrame:
    log = _numbered(spark, d)
    attempts = log.select("job_id", F.concat(F.lit("lost "), F.col("job_id").cast("string")).alias("error")).distinct()
    return J.current(log.unionByName(J.failed(log, attempts))).select("job_id", "status", "retry_count", "error")


@query(
    "job_completion",
    f"""WITH {D.JOB_EVENTS}
SELECT job_id, CASE WHEN status = 'processing' THEN 'completed' ELSE status END AS status,
  CASE WHEN status = 'processing' THEN 1.0 ELSE progress END::DOUBLE AS progress FROM job_now""",
)
def job_completion(spark: SparkSession, d: str) -> DataFrame:
    log = _numbered(spark, d)
    results = log.select("job_id", F.lit("{}").alias("results"), F.lit("{}").alias("metadata")).distinct()
    return J.current(log.unionByName(J.completed(log, results))).select("job_id", "status", "progress")


@query(
    "job_enqueue",
    """SELECT 'job-' || o_orderkey AS job_id, 'queued' AS status, 0::BIGINT AS retry_count, 0.0::DOUBLE AS progress FROM orders""",
)
def job_enqueue(spark: SparkSession, d: str) -> DataFrame:
    uploads = D.table(spark, d, "orders").select(F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("job_id"), F.col("o_orderdate").alias("at"))
    return J.current(J.enqueued(uploads, "job_id", "at")).select("job_id", "status", "retry_count", "progress")


@query(
    "claim_head",
    f"""WITH {D.JOB_EVENTS} SELECT job_id, retry_count FROM job_now WHERE status = 'queued' ORDER BY retry_count, job_id LIMIT 1""",
)
def claim_head(spark: SparkSession, d: str) -> DataFrame:
    return J.head(J.current(D.job_events(spark, d)), "retry_count").select("job_id", "retry_count")


@query(
    "free_slots",
    f"""WITH {D.SESSIONS}, i AS (SELECT id, CASE WHEN id < 4 THEN 'uploading' WHEN status = 'failed' THEN 'pending' ELSE 'completed' END AS status FROM sessions)
SELECT id, status FROM i WHERE status = 'pending' ORDER BY id LIMIT greatest(0, 5 - (SELECT count(*) FROM i WHERE status = 'uploading'))""",
)
def free_slots(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("id") < 4, "uploading").when(F.col("status") == "failed", "pending").otherwise("completed")
    return J.free_slots(D.sessions(spark, d).select("id", state.alias("status")), "id", most=5)


_QUEUE = """
u AS (
  SELECT user_id AS client, event_id AS seq, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'finish' WHEN 'purchase' THEN 'finish' WHEN 'signup' THEN 'remove'
    ELSE CASE WHEN event_id % 11 = 0 THEN 'reset' ELSE 'add' END END AS kind FROM events
), a AS (
  SELECT *, count(*) FILTER (kind = 'add') OVER (PARTITION BY client ORDER BY seq) AS n, row_number() OVER (PARTITION BY client ORDER BY seq) AS i FROM u
), q AS MATERIALIZED (
  SELECT a.client, a.i, a.seq, a.kind, CASE WHEN a.kind = 'add' THEN a.seq ELSE b.seq END AS item
  FROM a LEFT JOIN a b ON b.client = a.client AND b.kind = 'add' AND b.n = (a.n + 1) // 2
), r AS (
  SELECT client, 0::BIGINT AS i, 0::BIGINT AS seq, []::BIGINT[] AS active, []::BIGINT[] AS pending, []::BIGINT[] AS started FROM (SELECT DISTINCT client FROM q)
  UNION ALL
  SELECT client, i, seq, a || p[1:3 - len(a)], p[4 - len(a):], p[1:3 - len(a)] FROM (
    SELECT r.client, q.i, q.seq,
      CASE q.kind WHEN 'reset' THEN [] WHEN 'add' THEN active ELSE list_filter(active, lambda x: x IS DISTINCT FROM q.item) END AS a,
      CASE q.kind WHEN 'reset' THEN [] WHEN 'add' THEN list_append(pending, q.item) WHEN 'remove' THEN list_filter(pending, lambda x: x IS DISTINCT FROM q.item) ELSE pending END AS p
    FROM r JOIN q ON q.client = r.client AND q.i = r.i + 1)
)"""


@query(
    "upload_queue",
    f"""WITH RECURSIVE {_QUEUE}, s AS (SELECT client, seq, unnest(started) AS item FROM r)
SELECT q.client, q.item, s.seq AS started_seq FROM q LEFT JOIN s ON s.client = q.client AND s.item = q.item WHERE kind = 'add'""",
)
def upload_queue(spark: SparkSession, d: str) -> DataFrame:
    """Each user's uploads: when one gets one of three slots, if ever."""
    kind = (
        F.when(F.col("event_type") == "view", "add").when(F.col("event_type").isin("click", "purchase"), "finish").when(F.col("event_type") == "signup", "remove")
        .otherwise(F.when(F.col("event_id") % 11 == 0, "reset").otherwise("add"))
    )
    events = D.table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), kind.alias("kind"))
    # what isn't an addition names the addition half-way back
    w = Window.partitionBy("client").orderBy("seq")
    numbered = events.withColumn("n", F.count_if(F.col("kind") == "add").over(w))
    added = numbered.where("kind = 'add'").select("client", F.col("n").alias("_n"), F.col("seq").alias("_item"))
    named = numbered.join(added.withColumnRenamed("client", "_c"), (F.col("client") == F.col("_c")) & (F.expr("(n + 1) DIV 2") == F.col("_n")), "left")
    log = named.select("client", "seq", "kind", F.when(F.col("kind") == "add", F.col("seq")).otherwise(F.col("_item")).alias("item"))
    return upload_slots.scheduled(log).select("client", "item", "started_seq")


@query(
    "latest_progress",
    f"""WITH {D.JOB_EVENTS}
SELECT job_id, arg_max(progress, row(us, event_id)) AS progress FROM job_events WHERE progress IS NOT NULL GROUP BY job_id""",
)
def latest_progress(spark: SparkSession, d: str) -> DataFrame:
    return D.job_events(spark, d).where("progress IS NOT NULL").groupBy("job_id").agg(F.max_by("progress", "seq").alias("progress"))


@query(
    "cascade_delete",
    f"""WITH {D.SESSIONS} SELECT id, user_id FROM sessions WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = D.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return O.without_users(D.sessions(spark, d), gone).select("id", "user_id")


@query(
    "delete_failed",
    f"""WITH {D.SESSIONS} SELECT id, status FROM sessions WHERE NOT (user_id = 11 AND status = 'failed')""",
)
def delete_failed(spark: SparkSession, d: str) -> DataFrame:
    return O.deleted(D.sessions(spark, d), 11, failed=True).select("id", "status")


@query(
    "delete_many",
    f"""WITH {D.SESSIONS} SELECT id FROM sessions WHERE NOT (user_id = 11 AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10))""",
)
def delete_many(spark: SparkSession, d: str) -> DataFrame:
    ids = D.table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("id")).distinct()
    return O.deleted(D.sessions(spark, d), 11, ids).select("id")


@query(
    "user_patch",
    f"""WITH {D.USERS}, p AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' || s_suppkey END AS email, s_suppkey % 3 = 0 AS set_name,
    CASE WHEN s_suppkey % 6 = 0 THEN s_name END AS name, 'USER' AS role, s_nationkey AS upload_limit FROM supplier
)
SELECT users.id, coalesce(p.email, users.email) AS email, CASE WHEN coalesce(set_name, false) THEN p.name ELSE users.name END AS name,
  CASE WHEN users.id = 50 AND users.role = 'ADMIN' THEN users.role ELSE coalesce(p.role, users.role) END AS role,
  coalesce(p.upload_limit, users.upload_limit) AS upload_limit
FROM users LEFT JOIN p ON p.id = users.id""",
)
def user_patch(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    patches = D.table(spark, d, "supplier").select(
        key.alias("id"),
        F.when(key % 2 == 0, F.concat(F.lit("new"), key.cast("string"))).alias("email"),
        (key % 3 == 0).alias("set_name"),
        F.when(key % 6 == 0, F.col("s_name")).alias("name"),
        F.lit("USER").alias("role"),
        F.col("s_nationkey").alias("upload_limit"),
    )
    return O.patched(D.users(spark, d), patches, actor=50)


@query(
    "user_deletion",
    f"""WITH {D.USERS} SELECT id, role FROM users WHERE id = 50 OR id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def user_deletion(spark: SparkSession, d: str) -> DataFrame:
    ids = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return O.deleted_users(D.users(spark, d), ids, actor=50).select("id", "role")


@query(
    "seed_users",
    """SELECT c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT 2 * s_suppkey, s_name FROM supplier WHERE 2 * s_suppkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT DISTINCT -o_custkey, 'c' || o_custkey FROM orders WHERE -o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def seed_users(spark: SparkSession, d: str) -> DataFrame:
    there = D.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    some = D.table(spark, d, "supplier").select((2 * F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    others = D.table(spark, d, "orders").select((-F.col("o_custkey")).alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name")).distinct()
    return O.seeded(there, some.unionByName(others), "id")


@query(
    "failed_attempts",
    f"""WITH {D.SESSIONS} SELECT id, user_id, 'fail_' || epoch_ms(created_at) || '_' || id AS analysis_id, filename, 'failed' AS status, created_at AS completed_at
FROM sessions WHERE id % 3 = 0""",
)
def failed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Uploads refused for their size, as the records that are kept of them."""
    uploads = D.sessions(spark, d).withColumn("reason", F.when(F.col("id") % 3 == 0, "size"))
    return O.failed_attempts(uploads, "created_at").select("id", "user_id", "analysis_id", "filename", "status", "completed_at")


@query(
    "live_details",
    f"""WITH {D.SESSIONS} SELECT id, status, 100 AS progress, overall_score AS score,
  {D.LABEL.format("overall_score")} AS label, CASE WHEN overall_score IS NOT NULL THEN 1.0 END::DOUBLE AS confidence, overall_score IS NOT NULL AS has_results,
  coalesce(frames_analyzed, 0) AS analyzed_frames, 0.0::DOUBLE AS duration_seconds FROM sessions""",
)
def live_details(spark: SparkSession, d: str) -> DataFrame:
    """What a stored live session answers: a fixed progress and confidence, results only with a score."""
    rows = D.sessions(spark, d).withColumns({"timeline_data": F.lit("[]"), "duration": F.lit(None).cast("double"), "completed_at": F.lit(None).cast("timestamp")})
    shaped = O.live_detail(rows)
    overall = "results.peace_scores.overall"
    return shaped.select(
        "id", "status", "progress", f"{overall}.score", f"{overall}.label", f"{overall}.confidence", F.col("results").isNotNull().alias("has_results"),
        "video_metadata.analyzed_frames", "video_metadata.duration_seconds",
    )


@query(
    "counters",
    f"""WITH {D.FRAMES}, {D.SESSIONS}, {D.USERS}, g AS (
  SELECT analysis_id, direction, coalesce(lag(direction) OVER (PARTITION BY analysis_id ORDER BY frame_index) <> direction, true) AS starts FROM frames
)
SELECT (SELECT count(*) FROM frames) AS frames, (SELECT count(*) FROM g WHERE starts) AS segments, (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM sessions) AS sessions""",
)
def counters(spark: SparkSession, d: str) -> DataFrame:
    """Frames, motion segments, users and sessions in all."""
    frames = D.frames(spark, d)
    return O.counters(frames=frames, segments=series.motion_segments(frames, at="t_us"), users=D.users(spark, d), sessions=D.sessions(spark, d))


@query(
    "append_union",
    """SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier""",
)
def append_union(spark: SparkSession, d: str) -> DataFrame:
    a = D.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind"))
    return T.appended(a, D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query(
    "toggle_set",
    """(SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def toggle_set(spark: SparkSession, d: str) -> DataFrame:
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return T.toggled(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), "id")


@query("remove_by_id", f"WITH {D.SESSIONS} SELECT id FROM sessions WHERE id <> 17")
def remove_by_id(spark: SparkSession, d: str) -> DataFrame:
    return T.removed(D.sessions(spark, d), "id", 17).select("id")


@query("distinct_buckets", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_buckets(spark: SparkSession, d: str) -> DataFrame:
    return T.distinct_keys(D.table(spark, d, "events"), "user_id", "event_type")


@query(
    "positional_zip",
    """SELECT c_custkey AS i, c_name AS a, s_name AS b FROM customer JOIN supplier ON s_suppkey = c_custkey""",
)
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    a = D.table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("a"))
    return T.zipped(a, D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_name").alias("b")), "i")


@query(
    "session_close",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS frames, max(value) AS max_value FROM n GROUP BY user_id, s""",
)
def session_close(spark: SparkSession, d: str) -> DataFrame:
    events = D.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("frames"), F.max("value").alias("max_value"))
        .select("user_id", F.unix_micros("a").alias("start_us"), F.unix_micros("b").alias("last_us"), "frames", "max_value")
    )


@query(
    "active_on_page",
    f"""WITH {D.SESSIONS}, p AS (SELECT * FROM sessions ORDER BY created_at DESC NULLS FIRST, id LIMIT 60)
SELECT id, analysis_id FROM p WHERE status IN ('processing', 'queued')""",
)
def active_on_page(spark: SparkSession, d: str) -> DataFrame:
    page = O.page(O.ordered(D.sessions(spark, d)), size=60)
    return page.where(F.col("status").isin(O.STATUSES["processing"])).select("id", "analysis_id")


@query(
    "date_rules",
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(o_orderdate, '%b %-d, %Y') AS shown,
  epoch_us(date_trunc('day', o_orderdate + INTERVAL 90 MINUTES)) AS midnight_us FROM orders""",
)
def date_rules(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return D.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"),
        F.date_format(at, "MMM d, yyyy").alias("shown"),
        F.unix_micros(F.date_trunc("day", at + F.expr("INTERVAL 90 MINUTES"))).alias("midnight_us"),
    )


@query(
    "upload_admission",
    f"""WITH {D.USERS}, u AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, upload_limit, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 13 = 0 THEN 'type' WHEN o_orderkey % 11 = 0 THEN 'size' WHEN o_orderkey % 7 = 0 THEN 'content' END AS reason
  FROM orders JOIN users ON users.id = o_custkey
), q AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, reason IS NULL ORDER BY created_at, id) AS n FROM u
)
SELECT id, coalesce(reason, CASE WHEN upload_limit <> -1 AND n > upload_limit THEN 'quota' END) AS reason FROM q""",
)
def upload_admission(spark: SparkSession, d: str) -> DataFrame:
    from .. import api

    k = F.col("o_orderkey")
    limits = D.users(spark, d).select(F.col("id").alias("user_id"), "upload_limit")
    uploads = D.table(spark, d, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 13 == 0, "a.txt").otherwise("a.mp4").alias("name"),
        F.lit(None).cast("string").alias("media_type"),
        F.when(k % 11 == 0, 600_000_000).otherwise(5).alias("size"),
        F.when(k % 7 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("52494646"))).alias("head"),
    )
    return api.admit_uploads(uploads.join(limits, "user_id")).select("id", "reason")
