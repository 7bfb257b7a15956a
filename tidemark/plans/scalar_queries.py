"""Queries of scalar rules and checks: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import validation as V
from . import domain as D

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query(
    "format_scalars",
    """SELECT o_orderkey AS id, (floor(p / 60)::BIGINT)::VARCHAR || ':' || lpad((floor(p)::BIGINT % 60)::VARCHAR, 2, '0') AS duration,
  floor(p / 60)::BIGINT || ':' || lpad((t // 10)::VARCHAR, 2, '0') || '.' || (t % 10) AS timestamp,
  floor(f * 100 + 0.5)::BIGINT || '%' AS confidence,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (floor(n * 10 / 1024 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1024 + 0.5)::BIGINT % 10) || ' KB'
    WHEN n < 1073741824 THEN (floor(n * 10 / 1048576 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1048576 + 0.5)::BIGINT % 10) || ' MB'
    ELSE (floor(n * 10 / 1073741824 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1073741824 + 0.5)::BIGINT % 10) || ' GB' END AS size
FROM (SELECT *, floor((p - floor(p / 60) * 60) * 10 + 0.5)::BIGINT AS t FROM (
  SELECT o_orderkey, o_totalprice / 97 AS p, (o_orderkey % 1001) / 1000 AS f, o_orderkey * o_orderkey * (1 + o_orderkey % 19) AS n FROM orders))""",
)
def format_scalars(spark: SparkSession, d: str) -> DataFrame:
    key, p = F.col("o_orderkey"), F.col("o_totalprice") / 97
    return D.table(spark, d, "orders").select(
        key.alias("id"),
        S.duration_text(p).alias("duration"),
        S.timestamp_text(p).alias("timestamp"),
        S.percent_text(key % 1001 / 1000).alias("confidence"),
        S.size_text(key * key * (1 + key % 19)).alias("size"),
    )


@query(
    "parse_names",
    """WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'stomach_' || (p_partkey % 6) WHEN 1 THEN 'small_bowel_2' WHEN 2 THEN 'duodenum_x'
    WHEN 3 THEN 'esophagus_3' ELSE 'noscore' END AS dir,
  CASE p_partkey % 4 WHEN 0 THEN 'ab_' || p_partkey || '_v' || (p_partkey % 13) || '_frame' || p_partkey || '.jpg' WHEN 1 THEN 'Frame' || p_partkey || '.png'
    WHEN 2 THEN 'x_1_a_b_frame07.jpg' ELSE 'clip' || p_partkey || '.MOV' END AS file FROM part)
SELECT id, CASE WHEN regexp_extract(dir, '^(.*)_([^_]*)$', 1) IN ('esophagus', 'stomach', 'duodenum') AND try_cast(regexp_extract(dir, '^(.*)_([^_]*)$', 2) AS INT) BETWEEN 0 AND 3
    THEN regexp_extract(dir, '^(.*)_([^_]*)$', 1) END AS region,
  CASE WHEN regexp_extract(dir, '^(.*)_([^_]*)$', 1) IN ('esophagus', 'stomach', 'duodenum') AND try_cast(regexp_extract(dir, '^(.*)_([^_]*)$', 2) AS INT) BETWEEN 0 AND 3
    THEN try_cast(regexp_extract(dir, '^(.*)_([^_]*)$', 2) AS INT) END AS score,
  coalesce(nullif(regexp_extract(file, '^[a-z]+_[0-9]+_(.+)_frame[0-9]+\\.jpg', 1), ''), file) AS video,
  coalesce(try_cast(regexp_extract(file, 'frame([0-9]+)', 1) AS BIGINT), 0) AS frame,
  regexp_extract(file, '\\.\\w+$', 0) AS extension,
  CASE lower(regexp_extract(file, '\\.\\w+$', 0)) WHEN '.mov' THEN 'video/quicktime' ELSE 'video/mp4' END AS media_type
FROM n""",
)
def parse_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = k.cast("string")
    folder = (
        F.when(k % 5 == 0, F.concat(F.lit("stomach_"), (k % 6).cast("string")))
        .when(k % 5 == 1, "small_bowel_2")
        .when(k % 5 == 2, "duodenum_x")
        .when(k % 5 == 3, "esophagus_3")
        .otherwise("noscore")
    )
    file = (
        F.when(k % 4 == 0, F.concat(F.lit("ab_"), t, F.lit("_v"), (k % 13).cast("string"), F.lit("_frame"), t, F.lit(".jpg")))
        .when(k % 4 == 1, F.concat(F.lit("Frame"), t, F.lit(".png")))
        .when(k % 4 == 2, "x_1_a_b_frame07.jpg")
        .otherwise(F.concat(F.lit("clip"), t, F.lit(".MOV")))
    )
    rows = D.table(spark, d, "part").select(k.alias("id"), S.class_dir(folder).alias("c"), file.alias("file"))
    f = F.col("file")
    return rows.select(
        "id", "c.region", "c.score", S.video_id(f).alias("video"), S.frame_number(f).alias("frame"), S.extension(f).alias("extension"), S.media_type(f).alias("media_type")
    )


@query(
    "url_rules",
    """SELECT page_id, regexp_matches(trim(u), '^(?i)https?://') AS ok,
  CASE WHEN starts_with(u, 'https:') THEN 'wss:' || substr(u, 7) WHEN starts_with(u, 'http:') THEN 'ws:' || substr(u, 6) ELSE u END AS socket
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ftp://example.org/' || page_id WHEN 2 THEN 'no address' ELSE url END AS u FROM pages)""",
)
def url_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    u = F.when(k % 4 == 1, F.concat(F.lit("ftp://example.org/"), k.cast("string"))).when(k % 4 == 2, "no address").otherwise(F.col("url"))
    return D.table(spark, d, "pages").select("page_id", V.is_web_address(u).alias("ok"), S.socket_url(u).alias("socket"))


@query(
    "magic_bytes",
    """WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '0000001c6674797069736f6d' WHEN 1 THEN '5249464600000000' WHEN 2 THEN '1a45dfa300000000'
  WHEN 3 THEN '89504e470d0a1a0a' WHEN 4 THEN '' ELSE '6674' END AS h, octet_length(encode(coalesce(html, ''))) AS n,
  CASE page_id % 3 WHEN 0 THEN 'a.TXT' WHEN 1 THEN 'b.MKV' ELSE 'c' END AS name, CASE WHEN page_id % 2 = 0 THEN 'video/mp4' END AS kind FROM pages)
SELECT page_id, substr(h, 9, 8) = '66747970' OR substr(h, 1, 8) IN ('52494646', '1a45dfa3') AS is_video, n <= 524288000 AS fits,
  coalesce(kind = 'video/mp4', false) OR name = 'b.MKV' AS accepted FROM u""",
)
def magic_bytes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    heads = ["0000001c6674797069736f6d", "5249464600000000", "1a45dfa300000000", "89504e470d0a1a0a", "", "6674"]
    head = F.unhex(F.get(F.array(*map(F.lit, heads)), (k % 6).cast("int")))
    name = F.when(k % 3 == 0, "a.TXT").when(k % 3 == 1, "b.MKV").otherwise("c")
    return D.table(spark, d, "pages").select(
        "page_id",
        V.is_video_file(head).alias("is_video"),
        V.fits(F.octet_length(F.coalesce("html", F.lit("")))).alias("fits"),
        V.is_video_type(F.when(k % 2 == 0, "video/mp4"), name).alias("accepted"),
    )


@query(
    "json_paths",
    """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN floor(value)::INT % 4 END AS score, json_extract_string(props, '$.k')::INT AS k FROM events""",
)
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    from ..schemas import RESULTS_JSON

    score = F.floor("value").cast("int") % 4
    overall = F.struct(F.struct(score.alias("score"), S.label(score).alias("label")).alias("overall"))
    text = F.when(F.col("event_id") % 3 > 0, F.to_json(F.struct(overall.alias("peace_scores"))))
    stored = D.table(spark, d, "events").select("event_id", "props", text.alias("results"))
    read = stored.withColumn("r", F.from_json("results", RESULTS_JSON))
    return read.select("event_id", F.col("r.peace_scores.overall.score").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    "domain_checks",
    """SELECT event_id FROM (SELECT event_id, (value / 40)::DOUBLE AS c, json_extract_string(props, '$.k')::INT // 20 AS s FROM events) WHERE NOT (s BETWEEN 0 AND 3 AND c BETWEEN 0 AND 1)""",
)
def domain_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = D.table(spark, d, "events").select("event_id", (F.col("value") / 40).alias("confidence"), F.floor(k / 20).alias("score"))
    return V.out_of_domain(rows).select("event_id")


@query(
    "poll_backoff",
    """SELECT k::BIGINT AS step, floor(least(1000 * pow(1.5, k), 30000.0) * 1000 + 0.5)::BIGINT AS delay_us, floor((0.5 - 0.1 * pow(0.92, k)) * 1e9 + 0.5)::BIGINT AS drift_ppb FROM range(30) r(k)""",
)
def poll_backoff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    delay = S.poll_delay(F.lit(1000), k, 30000)
    return spark.range(30).select(k.alias("step"), F.floor(delay * 1000 + 0.5).alias("delay_us"), F.floor(S.drift(k) * 1e9 + 0.5).alias("drift_ppb"))


@query(
    "progress_map",
    """SELECT event_id, floor(CASE event_type WHEN 'signup' THEN p * 0.4 WHEN 'view' THEN 0.4 + p * 0.1 WHEN 'click' THEN 0.5 + p * 0.5 WHEN 'purchase' THEN 1.0 ELSE 0.0 END * 1e6 + 0.5)::BIGINT AS ppm
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT / 100 AS p FROM events)""",
)
def progress_map(spark: SparkSession, d: str) -> DataFrame:
    names = {"signup": "uploading", "view": "queued", "click": "processing", "purchase": "completed", "error": "failed"}
    state = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")]
    part = F.get_json_object("props", "$.k").cast("int") / 100
    return D.table(spark, d, "events").select("event_id", F.floor(S.overall_progress(state, part) * 1e6 + 0.5).alias("ppm"))


@query(
    "number_rules",
    """SELECT event_id, greatest(least(value, 60.0), 2.0)::DOUBLE AS clamped, floor(value / 0.5)::BIGINT AS bucket,
  CASE WHEN k = 0 THEN 7 ELSE k END AS or_default, CASE WHEN q IS NULL THEN 'not visited' WHEN q >= 0.8 THEN 'good' WHEN q >= 0.6 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k, nullif(json_extract_string(props, '$.k')::INT, 50) / 100 AS q FROM events)""",
)
def number_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return D.table(spark, d, "events").select(
        "event_id",
        S.clamped(v, 2.0, 60.0).alias("clamped"),
        S.bucket(v).alias("bucket"),
        S.or_default(k, 7).alias("or_default"),
        S.quality_band(F.nullif(k, F.lit(50)) / 100).alias("band"),
    )


@query(
    "id_lists",
    """SELECT s_suppkey AS id, len(l)::INT AS n, coalesce(list_sum(l), 0)::BIGINT AS total FROM (SELECT s_suppkey,
  CASE s_suppkey % 3 WHEN 0 THEN [s_suppkey::BIGINT, 3] WHEN 1 THEN [1::BIGINT] ELSE []::BIGINT[] END AS l FROM supplier)""",
)
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(", 3"))).when(k % 3 == 1, " x,1,,").otherwise("NaN, -")
    ids = S.id_list(text)
    return D.table(spark, d, "supplier").select(
        k.alias("id"), F.size(ids).alias("n"), F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")
    )


@query(
    "route_table",
    """SELECT DISTINCT path, signed_in, role, CASE WHEN starts_with(path, '/api/auth') THEN 'pass'
  WHEN path = '/' THEN CASE WHEN signed_in THEN 'to /dashboard' ELSE 'to /login' END
  WHEN path = '/login' THEN CASE WHEN signed_in THEN 'to /dashboard' ELSE 'pass' END
  WHEN NOT signed_in THEN CASE WHEN starts_with(path, '/api/') THEN '401' ELSE 'to /login' END
  WHEN path = '/admin' AND role <> 'ADMIN' THEN 'to /dashboard' WHEN path = '/api/admin/users' AND role <> 'ADMIN' THEN '403' ELSE 'pass' END AS decision
FROM (SELECT unnest(['/', '/login', '/admin', '/api/admin/users', '/api/auth/x', '/api/analyses', '/dashboard']) AS path),
  (VALUES (true), (false)) a(signed_in), (VALUES ('ADMIN'), ('USER')) b(role)""",
)
def route_table(spark: SparkSession, d: str) -> DataFrame:
    paths = ["/", "/login", "/admin", "/api/admin/users", "/api/auth/x", "/api/analyses", "/dashboard"]
    rows = [(p, s, r) for p in paths for s in (True, False) for r in ("ADMIN", "USER")]
    grid = spark.createDataFrame(rows, "path string, signed_in boolean, role string")
    return grid.withColumn("decision", V.route_decision(F.col("path"), F.col("signed_in"), F.col("role")))


@query(
    "form_checks",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN length(c_mktsegment) < 9 THEN 'short password'
  WHEN c_custkey % 4 = 1 THEN 'unknown role' END AS problem, c_nationkey < 20 AND c_nationkey <> 3 AS inside,
  CASE c_nationkey % 3 WHEN 0 THEN true ELSE c_custkey % 7 < c_nationkey % 3 END AS quota
FROM customer""",
)
def form_checks(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    mail = F.when(k % 4 == 0, "").otherwise(F.col("c_name"))
    password = F.when(F.length("c_mktsegment") < 9, "short").otherwise(F.col("c_mktsegment"))
    role = F.when(k % 4 == 1, "ROOT").when(k % 4 == 2, "ADMIN")
    path = F.when(n == 3, "/data/uploads/../x").when(n < 20, "/data/uploads/x").otherwise("/etc/x")
    limit = F.when(n % 3 == 0, -1).otherwise(n % 3)
    return D.table(spark, d, "customer").select(
        k.alias("id"), V.credential_errors(mail, password, role).alias("problem"), V.confined(path, "/data/uploads").alias("inside"),
        V.quota_left(k % 7, limit).alias("quota"),
    )


# Fixed paths by customer: each with what resolving it against /data/uploads gives.
_PATHS = [
    ("/data/uploads/a", True), ("/data/uploads/../x", False), ("/data/uploads/..", False), ("/data/uploads/a/../b", True), ("/data/./uploads//c", True),
    ("/data/uploads/a/../../uploads/d", True), ("/data/uploads2/a", False), ("/../data/uploads/e", True), ("/etc/passwd", False), ("/data/uploads/..a", True), ("/data/uploads/", False),
]


@query(
    "path_confinement",
    "SELECT c_custkey AS id, CASE c_custkey % 11 " + " ".join(f"WHEN {k} THEN {str(x).lower()}" for k, (_, x) in enumerate(_PATHS)) + " END AS inside FROM customer",
)
def path_confinement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    path = F.get(F.array(*(F.lit(p) for p, _ in _PATHS)), (k % 11).cast("int"))
    return D.table(spark, d, "customer").select(k.alias("id"), V.confined(path, "/data/uploads").alias("inside"))


_SEGMENTS = ["uploads", "data", "..", ".", "", "v1", "..."]


@query(
    "path_resolution",
    f"""WITH p AS (SELECT o_orderkey AS id, '/data/uploads/' || array_to_string(list_transform([1, 7, 49, 343, 2401],
  lambda f: {_SEGMENTS!r}[(o_orderkey * 48271 // f) % 7 + 1]), '/') AS path FROM orders),
r AS (SELECT id, list_reduce(list_prepend('', string_split(path, '/')),
  lambda acc, s: CASE WHEN s IN ('', '.') THEN acc WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || s END) AS path FROM p)
SELECT id, CASE WHEN path = '' THEN '/' ELSE path END AS path, starts_with(path, '/data/uploads/') AS inside FROM r""",
)
def path_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Paths with segments that lead up, stay or go on: where they end, and whether in the folder."""
    key = F.col("o_orderkey").cast("bigint") * 48271
    names = F.array(*map(F.lit, _SEGMENTS))
    parts = [F.get(names, (F.floor(key / f) % 7).cast("int")) for f in (1, 7, 49, 343, 2401)]
    path = F.concat(F.lit("/data/uploads/"), F.concat_ws("/", *parts))
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.resolved(path).alias("path"), V.confined(path, "/data/uploads").alias("inside"))


@query(
    "live_saves",
    """SELECT filename, frames_analyzed, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 4 END::DOUBLE AS overall_score FROM (
  SELECT 'f' || o_orderkey AS filename, (o_orderkey % 100)::INT AS frames_analyzed, o_orderkey AS k FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 11 > 0)""",
)
def live_saves(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = D.table(spark, d, "orders").select(
        F.when(k % 5 > 0, F.concat(F.lit("f"), k.cast("string"))).otherwise("").alias("filename"),
        F.when(k % 11 > 0, (k % 100).cast("string")).otherwise("many").alias("frames_analyzed"),
        F.when(k % 3 > 0, (k % 4).cast("string")).otherwise("none").alias("overall_score"),
        *(F.lit(None).cast("string").alias(c) for c in ("min_score", "max_score", "avg_score", "duration")),
    )
    return V.live_save(rows).select("filename", "frames_analyzed", "overall_score")


@query(
    "score_labels",
    f"SELECT event_id, {D.LABEL.format('(event_id % 5)')} AS label, event_id % 5 > 3 AS unknown FROM events",
)
def score_labels(spark: SparkSession, d: str) -> DataFrame:
    label = S.label(F.col("event_id") % 5)
    return D.table(spark, d, "events").select("event_id", label.alias("label"), label.isNull().alias("unknown"))


@query(
    "score_descriptions",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Substantial fluid/content completely obscuring evaluation'
  WHEN 1 THEN 'Substantial opaque fluid/content, some parts not evaluable' WHEN 2 THEN 'Small amount of hazy fluid/foam, most mucosa visible'
  WHEN 3 THEN 'Clean mucosa or minor transparent fluid, no impediment' END AS description FROM events""",
)
def score_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "events").select("event_id", S.described(F.col("event_id") % 5).alias("description"))
