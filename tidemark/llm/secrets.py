"""Operator 2: secret scans with multipart credential linking.

Base detectors report what is a secret by its form alone. Weak candidates
(user names, opaque tokens, endpoints) say little alone; they are kept only if
their complementary parts lie in the same scope: an interval join, by bisection
over the sorted starts and ends of a document's candidates, links an identifier
with a secret, and an endpoint with both; parts that begin inside an endpoint's own
span co-occur with it. A scope is a run of ``SCOPE`` code
points between two spans with no empty line inside.

Cases: a null or empty text has no spans; a very long text is scanned whole and
needs memory for itself and its spans; rows that repeat give equal results each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from hashlib import sha256
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import per_row, table

# The base detectors and the least length of each.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "login", "opaque", "endpoint"]

# Weak candidates.
LOGIN = re.compile(
    r"(?ai:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+|(?<![\w.@-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|internal|local)(?::[0-9]{1,5})?(?![\w-])"
    r"|(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![\w.])"
)
WORDS = ("password", "passwd", "secret", "token", "api")
LOGINS = ("user", "login", "client", "access", "account")
DIGIT = re.compile("[0-9]")
SCOPE = 200


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base detectors' matches."""
    found = []
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a run of 24 or more is found where a run of any length would be
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Near:
    """Spans by start and by end, to ask whether one lies within the scope."""

    def __init__(self, spans, breaks):
        self.spans = sorted((s, e) for s, _, e in spans)
        self.starts = [s for s, _ in self.spans]
        self.ends = sorted((e, s) for s, e in self.spans)
        self.breaks = breaks

    def has(self, start: int, end: int) -> bool:
        """Is there another span from start - SCOPE to end + SCOPE, with no
        empty line between? Candidates that overlap the span itself don't count."""
        i = bisect_left(self.starts, end)
        if i < len(self.starts) and self.starts[i] - end <= SCOPE and not self._cut(end, self.starts[i]):
            return True
        i = bisect_right(self.ends, (start, start)) - 1
        return i >= 0 and start - self.ends[i][0] <= SCOPE and not self._cut(self.ends[i][0], start)

    def within(self, start: int, end: int) -> bool:
        """Does a span begin inside start to end?"""
        return bisect_left(self.starts, start) < bisect_left(self.starts, end)

    def _cut(self, a: int, b: int) -> bool:
        i = bisect_left(self.breaks, a)
        return i < len(self.breaks) and self.breaks[i] < b


def linked_spans(text: str, lower: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak candidates whose complementary parts co-occur."""
    weak_ids = (
        [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)] if any(w in lower for w in LOGINS) else []
    )
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    weak_secrets = (
        [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if not _overlaps(starts, reach, m.start(), m.end())]
        if DIGIT.search(text)
        else []
    )
    ids = [x for x in base if x[1] == 1] + weak_ids
    secrets = [x for x in base if x[1] != 1] + weak_secrets
    if not ids or not secrets:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    near_ids, near_secrets = _Near(ids, breaks), _Near(secrets, breaks)
    out = [x for x in weak_ids if near_secrets.has(x[0], x[2])]
    out += [x for x in weak_secrets if near_ids.has(x[0], x[2])]
    out += [
        (m.start(), 5, m.end())
        for m in ENDPOINT.finditer(text)
        if all(near.within(*m.span()) or near.has(*m.span()) for near in (near_ids, near_secrets))
    ]
    return out


def _overlaps(starts: list[int], reach: list[int], start: int, end: int) -> bool:
    """starts: of the spans in order; reach: the furthest end up to each of them."""
    i = bisect_left(starts, end)
    return i > 0 and reach[i - 1] > start


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (start, kind, end) in order."""
    text = text or ""
    lower = text.lower()
    base = base_spans(text, lower)
    return base, sorted([*base, *linked_spans(text, lower, base)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the counts and a digest of the base spans, and all spans."""

    def rows(batch):
        out = []
        for i, t in batch:
            base, spans = find(t)
            n = [0, 0, 0]
            for _, k, _ in base:
                n[k] += 1
            out.append((i, *n, sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return per_row(docs, schema, rows, [doc_id, text])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
