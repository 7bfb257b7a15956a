"""Checks of uploads, addresses, domains and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Media types, extensions, and the bytes that video files begin with.
VIDEO_TYPES = ["video/mp4", "video/quicktime", "video/x-msvideo", "video/x-matroska"]
VIDEO_EXTENSIONS = r"(?i)\.(mp4|mov|avi|mkv)$"
FTYP, RIFF, EBML = "66747970", "52494646", "1A45DFA3"


def is_video_type(media_type: Column, name: Column) -> Column:
    """Rejected only if neither the type nor the extension is one of a video."""
    return F.coalesce(media_type.isin(VIDEO_TYPES), F.lit(False)) | F.coalesce(name.rlike(VIDEO_EXTENSIONS), F.lit(False))


def is_video_file(content: Column) -> Column:
    """By the first bytes; too short ones are none."""
    at = lambda k: F.hex(F.substring(content, k, 4))
    return F.coalesce((at(5) == FTYP) | at(1).isin(RIFF, EBML), F.lit(False))


def fits(size: Column) -> Column:
    return size <= S.MAX_UPLOAD_BYTES


def is_web_address(url: Column) -> Column:
    scheme = F.try_parse_url(F.trim(url), F.lit("PROTOCOL"))
    return F.coalesce(F.lower(scheme).isin("http", "https"), F.lit(False))


def quota_left(count: Column, limit: Column) -> Column:
    return (limit == -1) | (count < limit)


def out_of_domain(frames: DataFrame) -> DataFrame:
    """Rows whose score or confidence is impossible."""
    ok = F.col("score").between(0, 3) & F.col("confidence").between(0, 1)
    return frames.where(~F.coalesce(ok, F.lit(False)))


def credential_errors(email: Column, password: Column, role: Column) -> Column:
    """The first thing wrong with a form, or null."""
    return (
        F.when(email.isNull() | (email == "") | password.isNull() | (password == ""), "missing")
        .when(F.length(password) < 6, "short password")
        .when(~F.coalesce(role, F.lit("USER")).isin("USER", "ADMIN"), "unknown role")
    )


def resolved(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments; ``..`` at the top stays there."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda out, part: F.when(part.isin("", "."), out)
        .when(part == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
        .otherwise(F.array_append(out, part)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def confined(path: Column, root: str) -> Column:
    """Does an absolute path, once resolved, lie in the folder?"""
    return F.startswith(resolved(path), F.lit(root.rstrip("/") + "/"))


def route_decision(path: Column, signed_in: Column, role: Column) -> Column:
    """What a request for a path leads to."""
    api, admin = path.startswith("/api/"), path.startswith("/api/admin")
    return (
        F.when(path.startswith("/api/auth"), "pass")
        .when(path == "/", F.when(signed_in, "to /dashboard").otherwise("to /login"))
        .when(path.startswith("/login"), F.when(signed_in, "to /dashboard").otherwise("pass"))
        .when(~signed_in, F.when(api, "401").otherwise("to /login"))
        .when((path.startswith("/admin") | admin) & ~F.coalesce(role == "ADMIN", F.lit(False)), F.when(admin, "403").otherwise("to /dashboard"))
        .otherwise("pass")
    )


def live_save(rows: DataFrame) -> DataFrame:
    """Requests to store a live session: a name and a numeric frame count are
    needed; other metrics are kept if they are numbers."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    wanted = (F.coalesce("filename", F.lit("")) != "") & F.col("frames_analyzed").try_cast("double").isNotNull()
    return rows.where(wanted).select(
        "filename", F.col("frames_analyzed").try_cast("double").cast("int").alias("frames_analyzed"),
        *(number(c) for c in ("overall_score", "min_score", "max_score", "avg_score", "duration")),
    )
