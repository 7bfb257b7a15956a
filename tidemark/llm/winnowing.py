"""Operator 6: benchmark decontamination by winnowing.

Of the hashes of all K-word grams, the least in each window of W neighbouring
grams is kept. Two texts that share K + W - 1 = SPAN words agree on the grams of
that stretch, and so on a kept one: every shared span of ten words is found.
Kept hashes of test items are joined with those of documents, and each hit is
extended word by word, left and right, to the longest equal run; runs of at least
SPAN words are the union of all windows that occur. Items of fewer words are
fingerprinted whole (K of their own length, W of one).

The test fingerprints are broadcast if the items have BROADCAST_BYTES at most;
otherwise both sides' fingerprints are joined by a shuffle, and the texts of the
pairs that meet are joined back. Both ways share the same kernels.

Cases: null, empty or wordless texts have no words and no hits; wordless items
are never found; very long texts are hashed in pieces; repeated rows get equal
results each; items that repeat an item_id count once; an empty table on either
side is fine; other columns are ignored by the operator, carried by the stage.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import add_columns, per_row, table, written

SPAN, K = 10, 4
W = SPAN - K + 1
#: Parts that a gram's documents are dealt to where both sides are large.
SALTS = 8
#: Bytes of item text up to which the test side is broadcast; its index takes
#: about 20 times as much memory in each worker.
BROADCAST_BYTES = 8 << 20
#: Bytes hashed at once; a longer word or text is cut between words.
PIECE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_P, -1, 1 << 64)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; bytes.lower changes ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    if len(known.get(base, ())) < n:
        powers = np.full(max(n, PIECE + 1), base, np.uint64)
        powers[0] = 1
        known[base] = np.multiply.accumulate(powers)
    return known[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of a piece's words: differences of a running polynomial."""
    edge = np.diff(_IS_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=running[1:])
    return start, _mixed((running[end] - running[start]) * _powers(_INVERSE, len(data) + 1)[start])


def batch_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in turn, and where each text's begin."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        cut = min(at + PIECE, len(data))
        if cut < len(data):
            space = np.flatnonzero(~_IS_WORD[data[at:cut]])
            if len(space):
                cut = at + int(space[-1]) + 1
            else:  # a word longer than a piece
                rest = WORD.match(joined, cut)
                cut = rest.end() if rest else cut
        s, h = _piece_hashes(data[at:cut])
        starts.append(s + at)
        hashes.append(h)
        at = cut
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(start, first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word grams."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(_P) + h[i : i + n]
    return _mixed(out)


def winnow(h: np.ndarray, bounds: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the grams kept: the least of each window of w grams
    inside one text; of equal ones the last. bounds: the texts' first words, and
    the number of words at the end."""
    g = grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = g[w - 1 : w - 1 + n].copy(), np.full(n, w - 1, np.int64)
    for i in range(w - 2, -1, -1):
        lower = g[i : i + n] < least
        np.copyto(least, g[i : i + n], where=lower)
        at[lower] = i
    at += np.arange(n)
    inside = np.zeros(n + 1, np.int64)  # windows that cross no text's end
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - (k + w - 2), bounds[:-1])
    np.add.at(inside, np.minimum(lo, n), 1)
    np.add.at(inside, np.minimum(hi, n), -1)
    ok = np.cumsum(inside[:n]) > 0
    fresh = ok.copy()
    fresh[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    return at[fresh], least[fresh]


@dataclass
class Items:
    """The test side: words of each item, and kept grams by value."""

    ids: list[str] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    #: By gram length: sorted values, and the items and positions that they come from.
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]]) -> Items:
        out = cls()
        kept = defaultdict(list)
        for item_id, text in rows:
            words = WORD.findall(lowered(text))
            if not words:
                continue
            h, bounds = batch_hashes([lowered(text)])
            k, w = (K, W) if len(words) >= SPAN else (len(words), 1)
            at, value = winnow(h, bounds, k, w)
            kept[k if w > 1 else -k].append((value, np.full(len(at), len(out.ids)), at))
            out.ids.append(item_id)
            out.words.append(words)
        for k, parts in kept.items():
            value, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(value, kind="stable")
            out.index[k] = value[order], item[order], at[order]
        return out


def run_of(doc: list[bytes], item: list[bytes], p: int, q: int) -> tuple[int, int]:
    """The longest equal run through doc[p], item[q], as positions in doc; empty
    if they differ."""
    lo, hi = p, p
    while hi < len(doc) and hi - p + q < len(item) and doc[hi] == item[hi - p + q]:
        hi += 1
    while lo > 0 and lo - p + q > 0 and doc[lo - 1] == item[lo - 1 - p + q]:
        lo -= 1
    return lo, hi


def extended(doc: list[bytes], hits: list[tuple[int, int, int]], items: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(item, start, end) of the runs long enough, from (item, p, q) hits."""
    done: dict[tuple[int, int], int] = {}
    out = []
    for item, p, q in sorted(hits, key=lambda x: (x[0], x[1] - x[2], x[1])):
        if p < done.get((item, p - q), -1):
            continue
        lo, hi = run_of(doc, items[item], p, q)
        done[item, p - q] = hi
        if hi - lo >= min(SPAN, len(items[item])):
            out.append((item, lo, hi))
    return out


def covered(runs: list[tuple[int, int, int]]) -> int:
    total, end = 0, -1
    for lo, hi in sorted((lo, hi) for _, lo, hi in runs):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def verdict(n_words: int, n_hit: int, ids: set[str]) -> tuple:
    names = sorted(ids)
    return n_words, n_hit, len(names), sha256(",".join(names).encode()).hexdigest(), n_hit > 0


def batch_runs(texts: list[str | None], items: Items) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Where each text's words begin in all of them, and its runs (item, start, end)."""
    raw = [lowered(t) for t in texts]
    h, bounds = batch_hashes(raw)
    hits: dict[int, list] = defaultdict(list)
    for k, (values, item, at) in items.index.items():
        p, value = winnow(h, bounds, k, W) if k > 0 else winnow(h, bounds, -k, 1)
        lo, hi = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
        for j in np.flatnonzero(hi > lo):
            doc = int(np.searchsorted(bounds, p[j], "right")) - 1
            # texts without words share a bound with the one that follows
            hits[doc] += [(int(item[x]), int(p[j] - bounds[doc]), int(at[x])) for x in range(lo[j], hi[j])]
    return bounds, [extended(WORD.findall(raw[d]), hits[d], items.words) if d in hits else [] for d in range(len(texts))]


def batch_verdicts(texts: list[str | None], items: Items) -> list[tuple]:
    """For each text (n_words, n_hit, n_items, items_sha256, contaminated)."""
    bounds, found = batch_runs(texts, items)
    return [verdict(int(bounds[d + 1] - bounds[d]), covered(runs), {items.ids[x] for x, _, _ in runs}) for d, runs in enumerate(found)]


ADDED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _groups(rows: list[tuple]):
    """Rows in groups of a piece of text, so that memory doesn't follow the batch."""
    group, size = [], 0
    for r in rows:
        group.append(r)
        size += len(r[0] or "")
        if size >= 2 * PIECE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _broadcast_items(bench: DataFrame, bound: int) -> Items | None:
    """The test side, if it is small enough."""
    own = bench.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > bound:
        return None
    return Items.of([(r["item_id"] or "", r["text"]) for r in own.collect()])


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", bound: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ADDED for each row."""
    items = _broadcast_items(bench, bound)
    if items is None:
        return _by_shuffle(docs, bench, text)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def rows(batch):
        return [x for g in _groups(batch) for x in batch_verdicts([t for (t,) in g], shared.value)]

    return add_columns(docs, ADDED, rows, [text])


def _kept(df: DataFrame, key: str, item_side: bool, lengths: list[int]) -> DataFrame:
    """(key, k, value): the kept grams of each row's text, each once. lengths: of short
    items, which documents are searched for."""

    def rows(batch):
        out = []
        for i, t in batch:
            h, bounds = batch_hashes([lowered(t)])
            n = len(h)
            if item_side:
                kinds = [(K, W)] if n >= SPAN else [(n, 1)] * (n > 0)
            else:
                kinds = [(K, W), *((k, 1) for k in lengths)]
            for k, w in kinds:
                _, value = winnow(h, bounds, k, w)
                out += [(i, k if w > 1 else -k, v) for v in np.unique(value).view(np.int64).tolist()]
        return out

    return per_row(df, f"{key} long, k int, value long", rows, [key, "text"])


def _by_shuffle(docs: DataFrame, bench: DataFrame, text: str) -> DataFrame:
    """Join the fingerprints of both sides, then the texts of pairs that meet.

    A document has a gram once, and a gram's documents are dealt to SALTS parts, each with a copy of the
    items that have it, so that a word which most documents use is no single key. Pairs are made
    distinct before texts go to them; their hits are found again in the two texts, where they are
    needed. A document's runs are added up in their order, by a window, and never held together."""
    row = f"_row{uuid.uuid4().hex}"
    own = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    whole = own.select(F.col(row).alias("_row"), F.col(text).alias("text"))
    items = written(
        bench.select(
            F.monotonically_increasing_id().alias("_item"),
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
            "text",
        ),
        "items",
    )
    test = written(_kept(items, "_item", True, []), "test_grams")
    lengths = [-r["k"] for r in test.where("k < 0").select("k").distinct().collect()]  # nine at most
    copies = test.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grams = _kept(whole, "_row", False, lengths).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    met = written(grams.join(copies, ["k", "value", "_salt"]).select("_row", "_item").distinct(), "met")

    def runs(batch):
        return [
            (row, item_id, lo, hi)
            for row, doc_text, item_text, item_id in batch
            for _, lo, hi in batch_runs([doc_text], Items.of([(item_id, item_text)]))[1][0]
        ]

    pairs = met.join(whole, "_row").join(items.select("_item", "item_id", F.col("text").alias("item_text")), "_item")
    found = written(per_row(pairs, "_row long, item_id string, lo long, hi long", runs, ["_row", "text", "item_text", "item_id"]), "runs")
    ordered = Window.partitionBy("_row").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(F.max("hi").over(ordered), F.lit(0))))
    hit = found.select("_row", fresh.alias("fresh")).groupBy("_row").agg(F.sum("fresh").alias("n_hit"))
    names = found.select("_row", "item_id").distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item_id")).alias("names"))

    counted = add_columns(own, "n_words long", lambda batch: [(len(WORD.findall(lowered(t))),) for (t,) in batch], [text])
    stats = hit.join(names, "_row").select(
        F.col("_row").alias(row), "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names").cast("binary"), 256).alias("items_sha256")
    )
    made = [x.split()[0] for x in ADDED.split(", ")]
    joined = counted.drop(*made[1:]).join(stats, row, "left")
    verdicts = {
        "n_words": F.col("n_words"), "n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)),
        "items_sha256": F.coalesce("items_sha256", F.lit(sha256(b"").hexdigest())), "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False)),
    }
    order = [*docs.columns, *(c for c in made if c not in docs.columns)]
    return joined.select(*(verdicts[c].alias(c) if c in verdicts else F.col(f"`{c}`") for c in order))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("text").alias("_text"))
    judged = decontaminate(own, table(spark, sf_dir, "benchmark"), "_text")
    return judged.where("NOT contaminated").select("_doc.*")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0)
), bw AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g FROM bi
), di AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)
), dw AS (
  SELECT r, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g FROM di
), hit AS (
  SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)
), cov AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN ids USING (r)
"""
