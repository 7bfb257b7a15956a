"""Operator 7: repeated passages by a logarithmic family of suffix arrays.

A byte goes if a SPAN-byte string that covers it also starts in a document with a
smaller doc_id. Four steps, each of which deals out its data evenly:

1. Every SPAN-byte window is named after its *anchor*, the GRAM-byte string in it
   with the least hash. Windows in a row with one anchor form a *segment*; equal
   windows have equal anchors, so they meet wherever anchors meet. Documents are
   dealt to parts; anchors, without their text, are dealt by hash with the number of
   a part's documents that have them, and those that
   occur in one document only are dropped: no window there can repeat.
2. Segments of the other anchors are dealt to shards by anchor; where an anchor
   occurs in over HOT documents, single windows are dealt by their own bytes, so
   that no anchor's documents need to fit one shard. Equal segments of a part
   travel once, with their places in the least of its documents; the other places
   are matches already. So an anchor or window that a third of all documents have
   is as many entries as there are parts.
3. A shard takes its segments in ascending doc_id. A batch of them gets a suffix
   array: all starts of windows, sorted by their bytes. It is merge-scanned
   against each level of the family, itself a suffix array of documents with
   smaller ids; what agrees in SPAN bytes is a match. Then the batch becomes a
   level, and levels of about equal size are merged: every suffix is merged a
   logarithmic number of times.
4. The matches go back to their part, are united, and cut out of the texts.

Parts and shards hold a bounded amount of text each, as their number follows the
input's size. A part sends each bucket or shard what it has for it in one row; the more of
these there are, the less is in a row, down to one anchor, which takes 19 bytes and the row's
frame: what travels is in proportion to the input. The shuffle of the texts is used by steps 1, 2 and 4.

Cases: null and empty texts have no bytes and stay; texts shorter than SPAN stay
whole; very long texts are searched in pieces; rows with equal doc_id never remove
each other's bytes; rows with a null doc_id have no place in the order, stay whole
and remove nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, returned, table

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
#: A segment's widest text: its first window and WINDOW - 1 more starts.
WIDTH = SPAN + WINDOW - 1
ROW = 88
#: Windows worked on at once; positions in a piece fit POSITION bits.
PIECE, POSITION = 1 << 18, 20
_LOW = np.uint64((1 << POSITION) - 1)
#: Bytes of text for each part; of these, for each bucket of anchors and each shard.
PART_BYTES, BUCKET_BYTES, SHARD_BYTES = 4 << 20, 24 << 20, 8 << 20
#: Documents of an anchor from which its windows are dealt singly.
HOT = 4096
#: Bytes of arrays that travel without a compressed frame.
SMALL = 1024
#: Suffixes in a batch at least; suffixes in a family, and windows looked up at once, about.
BATCH, FAMILY = 1 << 16, 1 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def packed(*arrays: np.ndarray) -> bytes:
    """Integers go by planes of their bytes: those that are all but constant shrink to nothing.
    What is small goes as it is, each integer in the bytes that the array's greatest needs: where
    a part sends a few anchors to a bucket, or one, a frame of its own would outweigh them."""
    arrays = tuple(map(np.ascontiguousarray, arrays))
    if sum(a.nbytes for a in arrays) <= SMALL and all(a.dtype.kind == "S" or not len(a) or int(a.min()) >= 0 for a in arrays):
        out = [bytes([0, len(arrays)])]
        for a in arrays:
            width = a.itemsize if a.dtype.kind == "S" else (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
            out.append(struct.pack("<cBBH", a.dtype.kind.encode(), a.itemsize, width, len(a)))
            out.append(a.tobytes() if a.dtype.kind == "S" else a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].tobytes())
        return b"".join(out)
    flat = [(a.dtype.str, a.tobytes() if a.dtype.kind == "S" else a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(flat, 5))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    out = []
    if data[0] == 0:  # no frame begins so
        at = 2
        for _ in range(data[1]):
            kind, size, width, n = struct.unpack_from("<cBBH", data, at)
            raw, at = np.frombuffer(data, np.uint8, n * width, at + 5), at + 5 + n * width
            whole = np.zeros((n, size), np.uint8)
            whole[:, :width] = raw.reshape(n, width)
            out.append(np.frombuffer(whole.tobytes(), f"{kind.decode()}{size}"))
        return tuple(out)
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        dtype = np.dtype(kind)
        if dtype.kind != "S":
            raw = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T.tobytes()
        out.append(np.frombuffer(raw, dtype))
    return tuple(out)


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position on."""
    n = len(data) - GRAM + 1
    raw = data.tobytes()
    words = np.empty(n + 8, np.uint64)
    for k in range(8):  # eight-byte words at every offset
        m = (n + 8 - k + 7) // 8
        m = min(m, (len(raw) - k) // 8)
        words[k : k + 8 * m : 8] = np.frombuffer(raw, "<u8", m, k)
    return _mixed(words[:n] * _A ^ _mixed(words[8 : n + 8] * _B))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of texts that stand in a row in ``data``, each from bounds[i] to
    bounds[i + 1]: arrays (text, start in data, windows, anchor's hash). Every
    window is in one segment."""
    last = len(data) - SPAN + 1
    windows_end = np.maximum(bounds[1:] - (SPAN - 1), bounds[:-1])
    for s in range(0, last, PIECE):
        e = min(s + PIECE, last)
        g = gram_hashes(data[s : e + SPAN - 1])
        order = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))  # of equal ones the last
        anchor = (_LOW - (sliding_least(order, WINDOW) & _LOW)).astype(np.int64)
        i, j = np.searchsorted(bounds, s, "right") - 1, np.searchsorted(bounds, e, "left")
        step = np.zeros(e - s + 1, np.int64)
        np.add.at(step, np.clip(bounds[i:j], s, e) - s, 1)
        np.add.at(step, np.clip(windows_end[i:j], s, e) - s, -1)
        valid = np.cumsum(step[:-1]) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        end = valid.copy()
        end[:-1] &= ~valid[1:] | new[1:]
        start = np.flatnonzero(new)
        if len(start):
            count = np.flatnonzero(end) - start + 1
            yield np.searchsorted(bounds, start + s, "right") - 1, start + s, count, g[anchor[start]]


class Part:
    """The documents of a part in an order that all steps share."""

    def __init__(self, rows: pa.Table):
        ids, keys, texts = (rows.column(c).to_pylist() for c in ("doc_id", "rk", "text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, keys[i]))
        self.ids, self.keys = [ids[i] for i in order], [keys[i] for i in order]
        self.texts = [texts[i] or b"" for i in order]

    def segments(self):
        first = sum(i is None for i in self.ids)
        sizes = [0] * first + [len(t) for t in self.texts[first:]]
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        data = np.frombuffer(b"".join(self.texts[first:]), np.uint8)
        parts = list(segments(data, bounds)) if len(data) >= SPAN else []
        if not parts:
            return data, bounds, *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
        return data, bounds, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _dealt(where: np.ndarray, n: int, *arrays: np.ndarray):
    """(k, arrays' rows with where == k) for each k that has any."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        yield k, *(a[own] for a in arrays)


def part_anchors(rows: pa.Table, buckets: int) -> list[tuple[int, bytes]]:
    """Step 1, by part: (bucket, anchors in order, and how many documents have each)."""
    _, _, doc, _, _, anchor = Part(rows).segments()
    short = anchor >> np.uint64(16)
    order = np.lexsort((doc, short))
    short, doc = short[order], doc[order]
    fresh = np.ones(len(short), bool)
    fresh[1:] = (short[1:] != short[:-1]) | (doc[1:] != doc[:-1])
    short, n = np.unique(short[fresh], return_counts=True)
    where = (short % np.uint64(buckets)).astype(np.int64)
    return [(k, packed(_steps(s), c)) for k, s, c in _dealt(where, buckets, short, n.astype(np.uint32))]


def shared_anchors(parts: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """Step 1, by bucket: for each part its anchors that two documents have, and
    of these the hot ones."""
    found = [unpacked(b) for b in blobs]
    anchor = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in found])
    docs = np.concatenate([n for _, n in found]).astype(np.int64)
    source = np.repeat(np.arange(len(parts)), [len(x) for x, _ in found])
    order = np.argsort(anchor, kind="stable")
    anchor, source, docs = anchor[order], source[order], docs[order]
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    often = np.repeat(np.add.reduceat(docs, start), np.diff(np.append(start, len(anchor))))
    keep = often > 1
    return [
        (parts[k], packed(_steps(a), _steps(a[n > HOT])))
        for k, a, n in _dealt(source[keep], len(parts), anchor[keep], often[keep])
    ]


def _member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return sorted_set[at] == x


def part_segments(rows: pa.Table, blobs: list[bytes], shards: int, number: int) -> list[tuple[int, bytes]]:
    """Step 2: (shard, segments of shared anchors with the documents and places that have
    them); of a segment's places in the part, only those in the least document travel.
    The others are matches, which go by a number of the part's own beyond the shards."""
    part = Part(rows)
    data, bounds, doc, start, count, anchor = part.segments()
    found = [[np.cumsum(x, dtype=np.uint64) for x in unpacked(b)] for b in blobs]
    if not found or not len(doc):
        return []
    shared, hot = (np.sort(np.concatenate(x)) for x in zip(*found, strict=True))
    short = anchor >> np.uint64(16)
    keep = _member(shared, short)
    doc, start, count, short = doc[keep], start[keep], count[keep], short[keep]
    is_hot = _member(hot, short) | (short == 0)  # zero marks windows dealt singly
    if is_hot.any():  # single windows
        n = count[is_hot]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        doc = np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], n)])
        start = np.concatenate([start[~is_hot], np.repeat(start[is_hot], n) + rank])
        count = np.concatenate([count[~is_hot], np.ones(len(rank), np.int64)])
        short = np.concatenate([short[~is_hot], np.zeros(len(rank), np.uint64)])
    ids = np.array([i or 0 for i in part.ids], np.int64)
    out = []
    where = np.full(len(doc), -1)
    named = short > 0
    where[named] = (_mixed(short[named]) % np.uint64(shards)).astype(np.int64)
    for lo in range(0, len(doc), PIECE):  # windows dealt by their bytes
        own = np.flatnonzero(where[lo : lo + PIECE] < 0) + lo
        if len(own):
            text = _rows(data, start[own], count[own])
            words = text[:, :56].copy()
            words[:, SPAN:] = 0
            h = np.zeros(len(own), np.uint64)
            for w in words.view("<u8").T:
                h = _mixed((h ^ w) * _A)
            where[own] = (h % np.uint64(shards)).astype(np.int64)
    settled = []
    for k, d, s, c, a in _dealt(where, shards, doc, start, count, short):
        text, one, which = np.unique(_rows(data, s, c).view(f"S{ROW}").ravel(), return_index=True, return_inverse=True)
        which = which.ravel()
        least = np.full(len(text), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[d])
        # where the part has the segment in a smaller document, it matches whole and stays here
        here = ids[d] > least[which]
        settled.append((d[here], (s - bounds[d])[here], (s - bounds[d] + c)[here] + SPAN - 1))
        d, s, which = d[~here], s[~here], which[~here]
        out.append((k, packed(text, which.astype(np.uint32), ids[d], d.astype(np.uint32), s - bounds[d], _code(a[one]))))
    doc, lo, hi = (np.concatenate(x) for x in zip(*settled, strict=True)) if settled else ([], [], [])
    if len(doc):
        out.append((shards + number, packed(doc, lo, hi)))
    return out


def _code(anchor: np.ndarray) -> np.ndarray:
    """Enough of an anchor to tell most apart; zero only for zero."""
    return np.where(anchor > 0, anchor & np.uint64(0xFFFFFF) | np.uint64(1 << 24), 0).astype(np.uint32)


def _rows(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Segments as rows of ROW bytes: text, zeros, and the count at WIDTH, which is
    never zero; so rows compare as strings of one length."""
    text = np.zeros((len(start), ROW), np.uint8)
    column = np.arange(WIDTH)
    at = start[:, None] + column
    inside = column < (count + SPAN - 1)[:, None]
    text[:, :WIDTH][inside] = data[at[inside]]
    text[:, WIDTH] = count
    return text


class Level:
    """A suffix array: distinct SPAN-byte strings in order, and for each the least
    document that has it."""

    def __init__(self, strings: np.ndarray, least: np.ndarray):
        self.strings, self.least = strings, least

    def matched(self, strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted strings start here in a smaller document."""
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        return (self.strings[at] == strings) & (self.least[at] < docs)

    def merged(self, other: Level) -> Level:
        strings = np.concatenate([self.strings, other.strings])
        least = np.concatenate([self.least, other.least])
        order = np.argsort(strings, kind="stable")  # two ordered runs
        strings, least = strings[order], least[order]
        first = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
        return Level(strings[first], np.minimum.reduceat(least, first))


class Family:
    """Levels of geometrically growing size. Batches are added in ascending doc_id."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Take a batch of suffixes (SPAN bytes each, documents in order); returns
        which of them start in a smaller document of this batch or before."""
        if not len(strings):
            return np.zeros(0, bool)
        order = np.argsort(strings, kind="stable")  # the batch's suffix array
        strings, docs = strings[order], docs[order]
        first = np.concatenate([[True], strings[1:] != strings[:-1]])
        start = np.flatnonzero(first)
        least = np.minimum.reduceat(docs, start)
        run = np.cumsum(first) - 1
        hit = docs > least[run]
        for level in self.levels:
            rest = np.flatnonzero(~hit)
            hit[rest] = level.matched(strings[rest], docs[rest])
        new = Level(strings[start], least)
        while self.levels and len(self.levels[-1].strings) <= 2 * len(new.strings):
            new = self.levels.pop().merged(new)
        self.levels.append(new)
        out = np.zeros(len(hit), bool)
        out[order] = hit
        return out


def shard_matches(parts: list[int], blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """Step 3: (part, document in it, start and end of matches)."""
    found = [unpacked(b) for b in blobs]
    text, one, which = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
    segment = np.concatenate([which.ravel()[offsets[k] + f[1].astype(np.int64)] for k, f in enumerate(found)])
    ids, doc, start = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
    source = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
    least = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(least, segment, ids)
    raw = text.view(np.uint8).reshape(-1, ROW)
    count = raw[:, WIDTH].astype(np.int64)

    # the suffixes of the distinct segments, by ascending least document; a segment that
    # is alone with its anchor, or is a window dealt singly, can't share one with another
    anchor = np.concatenate([f[5] for f in found])[one]
    _, kind, size = np.unique(anchor, return_inverse=True, return_counts=True)
    shares = (size[kind.ravel()] > 1) & (anchor > 0)
    begin = np.full(len(text), -1)
    hits: list[np.ndarray] = [np.zeros(0, bool)]
    at = 0
    # equal windows have equal anchors: families of some of the anchors each hold what one would
    views = np.lib.stride_tricks.sliding_window_view(raw, SPAN, axis=1)
    families = max(1, -(-int(count[shares].sum()) // FAMILY))
    share = np.where(shares, _mixed(anchor.astype(np.uint64) * _A) % np.uint64(families), families)
    for own_share in range(families):
        family = Family()
        order = np.flatnonzero(share == own_share)
        order = order[np.argsort(least[order], kind="stable")]
        total = np.cumsum(count[order])
        lo = 0
        while lo < len(order):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BATCH, "left")) + 1
            own = order[lo:hi]
            n = count[own]
            begin[own] = at + np.cumsum(n) - n
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(own, n)
            suffix = np.ascontiguousarray(views[row, rank]).view(f"S{SPAN}").ravel()
            hits.append(family.add(suffix, least[row]))
            at += len(rank)
            lo = hi
    hit = np.concatenate(hits)

    # a segment whose least document is smaller matches whole; else its own suffixes do
    whole = ids > least[segment]
    spans = [(source[whole], doc[whole], start[whole], start[whole] + count[segment[whole]] + SPAN - 1)]
    some = np.flatnonzero(~whole & shares[segment])
    for own in np.array_split(some, len(some) * WINDOW // FAMILY + 1):
        n = count[segment[own]]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(own, n)
        own_hit = hit[np.repeat(begin[segment[own]], n) + rank]
        owner, rank = owner[own_hit], rank[own_hit]
        if len(owner):  # suffixes in a row make one span
            first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (rank[1:] != rank[:-1] + 1)])
            last = np.concatenate([first[1:], [True]])
            o = owner[first]
            spans.append((source[o], doc[o], start[o] + rank[first], start[o] + rank[last] + SPAN))
    source, doc, lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True))
    return [(parts[k], packed(d, a, b)) for k, d, a, b in _dealt(source, len(parts), doc, lo, hi)]


def cut(rows: pa.Table, blobs: list[bytes]) -> list[tuple]:
    """Step 4: (doc_id, text bytes, kept bytes, removed runs as (start, end))."""
    part = Part(rows)
    spans: dict[int, list] = {}
    found = [unpacked(b) for b in blobs]
    if found:
        doc, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lo, doc))
        for d, a, b in zip(doc[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
            own = spans.setdefault(d, [])
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
    out = []
    for d, (i, t) in enumerate(zip(part.ids, part.texts, strict=True)):
        runs, kept, at = spans.get(d, []), [], 0
        for a, b in runs:
            kept.append(t[at:a])
            at = b
        out.append((i, t, b"".join([*kept, t[at:]]), runs))
    return out


def _grouped(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    out = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    returned()  # what a group took, before the next one comes
    return out


def repeats(docs: DataFrame, result, ddl: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``result(doc_id, text bytes, kept bytes, removed runs)`` of schema
    ``ddl``, one for each document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts, buckets, shards = (max(1, -(-size // n)) for n in (PART_BYTES, BUCKET_BYTES, SHARD_BYTES))
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
    ).withColumn("rk", F.xxhash64("doc_id", "text"))
    own = own.withColumn("part", F.pmod("rk", F.lit(parts)).cast("int"))
    by_part = own.groupBy("part")
    anchor_rows, share_rows, out_rows = (arrow_schema(spark, s) for s in ("bucket int, part int, blob binary", "part int, blob binary", ddl))

    def anchors(key, rows):
        return _grouped(anchor_rows, [(k, key[0].as_py(), b) for k, b in part_anchors(rows, buckets)])

    def shared(rows):
        return _grouped(share_rows, shared_anchors(rows["part"].to_pylist(), rows["blob"].to_pylist()))

    def segmented(key, rows, blobs):
        number = key[0].as_py()
        return _grouped(anchor_rows, [(k, number, b) for k, b in part_segments(rows, blobs["blob"].to_pylist(), shards, number)])

    def matches(rows):
        found = rows["part"].to_pylist(), rows["blob"].to_pylist()
        settled = rows["bucket"][0].as_py() >= shards  # a part's own matches pass
        return _grouped(share_rows, list(zip(*found, strict=True)) if settled else shard_matches(*found))

    def removed(rows, blobs):
        return _grouped(out_rows, [result(*x) for x in cut(rows, blobs["blob"].to_pylist())])

    met = by_part.applyInArrow(anchors, "bucket int, part int, blob binary").groupBy("bucket").applyInArrow(shared, "part int, blob binary")
    dealt = by_part.cogroup(met.groupBy("part")).applyInArrow(segmented, "bucket int, part int, blob binary")
    found = dealt.groupBy("bucket").applyInArrow(matches, "part int, blob binary")
    return by_part.cogroup(found.groupBy("part")).applyInArrow(removed, ddl)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with the repeated bytes cut out; characters that lose bytes
    in the cut become U+FFFD."""
    return repeats(docs, lambda i, t, kept, runs: (i, kept.decode("utf-8", "replace")), "doc_id long, text string", doc_id, text)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def result(i, t, kept, runs):
        return i, len(t), len(t) - len(kept), len(runs), sha256(kept).hexdigest()

    return repeats(docs, result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", doc_id, text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM d)
), f AS (
  SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM w JOIN f USING (g) WHERE doc_id > least
), b AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit
), runs AS (
  SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM b) GROUP BY r, k
), gaps AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS z FROM runs
  UNION ALL SELECT r, max(hi), max(n) FROM runs JOIN d USING (r) GROUP BY r
), kept AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (r) GROUP BY r
), s AS (
  SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN s USING (r) LEFT JOIN kept USING (r)
"""
