"""Operator 5: SimHash near-duplicates by a byte-position inverted index.

A fingerprint is indexed by its eight bytes and their positions. Two fingerprints
that differ in three bits or fewer share at least five positional bytes, so pairs
with fewer shared ones are dropped unseen. Posting lists of single bytes hold a
256th of the corpus each, and tallying over them would touch nearly all pairs;
the tally is therefore taken on intersections of five lists: each of the 56 sets
of five positions keys the index, and a pair reaches the minimum of five exactly
if it meets under some key. What meets is verified by its differing bits.

Under a key, fingerprints differ in 24 bits only; so a list has 2**24 distinct
fingerprints at most, whatever the corpus. Short lists are compared pair by pair;
long ones are linked by a flood fill over the 2,325 patterns of up to three of
the 24 bits, which gives a spanning forest in time linear in the list.
Equal fingerprints are collapsed beforehand.

The pipeline's stage looks for looser copies: five words and a similarity of 0.8. There the
vote moves some 15 of 100 bits, too many for 64 of them to guarantee a byte. Its fingerprint is the
same vote over 768 bits, of whose 96 bytes such a pair shares 26. Lists of single bytes, at 32
positions, carry the fingerprints; within a list, the tally is taken on its intersections with two
more lists, 64 of them; pairs with fewer shared bytes than a pair at 0.8 has, less four standard
deviations, are dropped, and so are those with too many differing bits. What is left makes loose
classes, in which all such pairs are verified by their sets of shingles.

Cases: null, empty and blank texts have fingerprint zero and are linked like any
other; fewer words than a shingle make one shingle; long texts are hashed in
pieces; repeated rows get the same component; a null doc_id is no component's
name unless all its members have none; an empty table gives no rows; other
columns are ignored by the operator and carried by the stage.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, per_row, returned, sliced, table, written
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 3
POSITIONS, MIN_SHARED = 8, 8 - MAX_BITS
#: Positions left free by each key, and the mask of the others.
FREE = list(combinations(range(POSITIONS), POSITIONS - MIN_SHARED))
MASKS = [~sum(0xFF << 8 * p for p in free) & (1 << 64) - 1 for free in FREE]
PIECE = 1 << 18
#: Lists up to this long are compared pair by pair in one pass for all lists; up
#: to BLOCKS, by blocks; longer ones by the flood fill over bit patterns.
SHORT, BLOCKS = 6, 2048
#: Copies of a class's name, each for a part of its members.
SALTS = 16


def fingerprint(text: str | None) -> int:
    """64 bits: bit i is set if it is set in over half of the shingles' hashes."""
    # bytes.lower and bytes.split know ASCII only, as wanted
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    shingles = map(b" ".join, zip(*(words[k : n + k] for k in range(SHINGLE)), strict=True))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(64, np.int64)
    for start in range(0, n, PIECE):
        h = np.fromiter(hashes, np.uint64, min(PIECE, n - start))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rk, fp): rk tells rows apart that differ in doc_id or text; fp is the
    fingerprint as a signed long."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("rk", row_key("doc_id", "text"))
    rows = lambda batch: [(i, k, signed(fingerprint(t))) for i, k, t in batch]
    return per_row(own, "doc_id long, rk long, fp long", rows, ["doc_id", "rk", "text"])


def row_key(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), text)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that share enough positional bytes and differ in few enough bits."""
    x = a ^ b
    shared = (x[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_SHARED
    return shared & (np.bitwise_count(x) <= MAX_BITS)


def _flood(members: np.ndarray, neighbours) -> list[tuple[int, int]]:
    """A spanning forest as (parent, child) indexes. neighbours(i, rest) picks
    those of the indexes rest that are near to i."""
    rest = np.arange(1, len(members))
    edges, queue = [], [0]
    while True:
        while queue and len(rest):
            i = queue.pop()
            near = neighbours(i, rest)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
        if not len(rest):
            return edges
        queue, rest = [int(rest[0])], rest[1:]


def _forest_by_patterns(values: np.ndarray, free: tuple[int, ...]) -> list[tuple[int, int]]:
    """The same over a set of 24-bit values, by trying all patterns of up to
    three bits: linear in the list, and 2 MB of memory beside it for a bit of each value."""
    small = np.zeros(len(values), np.int64)
    for k, p in enumerate(free):
        small |= ((values >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << 8 * k
    order = np.argsort(small)
    ordered, left = small[order], np.zeros(1 << 21, np.uint8)  # left: the values not reached yet
    bit = lambda v: np.left_shift(1, v & 7).astype(np.uint8)
    np.bitwise_or.at(left, small >> 3, bit(small))
    patterns = np.array(
        [sum(1 << b for b in bits) for n in range(1, MAX_BITS + 1) for bits in combinations(range(24), n)], np.int64
    )
    edges = []
    for start in range(len(values)):
        if not left[small[start] >> 3] & bit(small[start]):
            continue
        left[small[start] >> 3] &= ~bit(small[start])
        queue = [start]
        while queue:
            i = queue.pop()
            near = small[i] ^ patterns
            near = near[(left[near >> 3] & bit(near)) > 0]
            if len(near):
                np.bitwise_and.at(left, near >> 3, ~bit(near))
                found = order[np.searchsorted(ordered, near)].tolist()
                edges += [(i, j) for j in found]
                queue += found
    return edges


def link_list(members: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    """Edges of a spanning forest of one list's near fingerprints."""
    if len(members) <= BLOCKS:
        edges = _flood(members, lambda i, rest: np.bitwise_count(members[rest] ^ members[i]) <= MAX_BITS)
    else:
        edges = _forest_by_patterns(members, free)
    return members[np.array(edges, np.int64).reshape(-1, 2)]


def link_sorted(combo: np.ndarray, masked: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Edges between near fingerprints of equal (combo, masked); rows are sorted."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate([[True], (combo[1:] != combo[:-1]) | (masked[1:] != masked[:-1])]))
    length = np.diff(np.append(start, n))
    out = [np.zeros((0, 2), np.uint64)]
    short = np.repeat(length <= SHORT, length)
    run = np.repeat(np.arange(len(start)), length)
    for d in range(1, SHORT):
        i = np.flatnonzero((run[d:] == run[:-d]) & short[d:]) if n > d else np.zeros(0, np.int64)
        near = _near(fp[i], fp[i + d])
        out.append(np.stack([fp[i][near], fp[i + d][near]], axis=1))
    for k in np.flatnonzero(length > SHORT):
        own = fp[start[k] : start[k] + length[k]]
        out.append(link_list(own, FREE[combo[start[k]]]))
    return np.concatenate(out)


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` so that their components are those
    of all pairs within MAX_BITS."""
    keys = F.explode(
        F.array(*(F.struct(F.lit(c).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("masked")) for c, m in enumerate(MASKS)))
    )
    dealt = (
        prints.select(keys.alias("k"), "fp")
        .select("k.combo", "k.masked", "fp")
        .repartition("combo", "masked")
        .sortWithinPartitions("combo", "masked")
    )
    target = arrow_schema(prints.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[tuple]) -> pa.RecordBatch:
            e = link_sorted(*(np.concatenate(c) for c in zip(*parts, strict=True))).view(np.int64)
            e = np.unique(e, axis=0)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=target)

        held: list[tuple] = []  # rows of the last list so far: it may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            combo, masked, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            last = np.flatnonzero((combo != combo[-1]) | (masked != masked[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield edges([*held, (combo[:cut], masked[:cut], fp[:cut])])
                held = []
            elif held and (held[-1][0][-1], held[-1][1][-1]) != (combo[0], masked[0]):
                yield edges(held)
                held = []
            held.append((combo[cut:], masked[cut:], fp[cut:]))
        if held:
            yield edges(held)
        returned()

    return dealt.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) from (doc_id, fp): root names the class, and
    component_id is the least doc_id in it. Fingerprints without a partner are their own class;
    for the others a class's least doc_id is found by partial sums and goes back to them in
    SALTS copies, so that no class is one key."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(near_pairs(distinct.select("fp")))
    labelled = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "root"), "labelled")
    named = labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    copies = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = labelled.where("root IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(copies, ["root", "_salt"])
    alone = labelled.where("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return alone.unionByName(met.select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each input row."""
    prints = written(fingerprints(docs, doc_id, text), "simhash")
    return prints.join(classes(prints), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- looser copies: the pipeline's stage

#: Words in a shingle, and the similarity of two documents' sets of shingles to be found.
LOOSE_SHINGLE, LOOSE_SIMILARITY = 5, 0.8
#: Bytes of a fingerprint, those of them that have lists, and intersections of a list with two
#: others. Of pairs at the similarity, one in thousands meets in none; closer ones, less.
LOOSE_POSITIONS, LISTS, CROSSINGS = 96, 32, 64
#: Sets of equal size at the similarity share this part of each, and differ in these of all bits.
_COMMON = 2 * LOOSE_SIMILARITY / (1 + LOOSE_SIMILARITY)
_TURNED = math.acos(_COMMON) / math.pi
_SAME = (1 - _TURNED) ** 8
#: Shared bytes of such a pair less four standard deviations, and differing bits plus six: pairs
#: beyond are dropped without a look at their sets.
LOOSE_SHARED = int(LOOSE_POSITIONS * _SAME - 4 * (LOOSE_POSITIONS * _SAME * (1 - _SAME)) ** 0.5)
LOOSE_BITS = int(8 * LOOSE_POSITIONS * _TURNED + 6 * (8 * LOOSE_POSITIONS * _TURNED * (1 - _TURNED)) ** 0.5)
#: Rows of lists that are gone through at once, at least.
AT_ONCE = 1 << 16
#: Members of a class verified in one task; larger classes are dealt to chunks, each with
#: about LEADERS members that all chunks have, and then to pairs of blocks.
CHUNK, LEADERS = 2048, 32
#: Rows of two longs that are broadcast at most: 32 MB.
SENT = 2 << 20
_DRAWN = np.random.default_rng(SEED)
_WORDS = _DRAWN.integers(0, 1 << 64, LOOSE_POSITIONS // 8, np.uint64) | np.uint64(1)
_TIES = _DRAWN.integers(0, 2, 8 * LOOSE_POSITIONS)
_CROSSED = _DRAWN.permutation(list(combinations(range(1, LOOSE_POSITIONS), 2)))[:CROSSINGS]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order, as 64-bit numbers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - LOOSE_SHINGLE + 1
    shingles = map(b" ".join, zip(*(words[k : n + k] for k in range(LOOSE_SHINGLE)), strict=True)) if n > 1 else [b" ".join(words)][: len(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def loose_fingerprint(hashes: np.ndarray) -> bytes:
    """The vote over LOOSE_POSITIONS bytes: a bit is set if it is set in over half of the
    shingles' hashes, which are drawn out to as many bits; a tie goes to the bit's own side."""
    n = len(hashes)
    if not n:
        return bytes(LOOSE_POSITIONS)
    counts = np.zeros(8 * LOOSE_POSITIONS, np.int64)
    for start in range(0, n, 255):  # so many fit a byte's sum, eight sums a word
        h = np.multiply.outer(hashes[start : start + 255], _WORDS)
        h = (h ^ (h >> np.uint64(32))) * _SPREAD
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), axis=1)
        counts += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts + _TIES > n).tobytes()


def loosely_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of rows that share enough bytes and differ in few enough bits."""
    x = a ^ b
    near = (x == 0).sum(axis=1) >= LOOSE_SHARED
    near[near] = np.bitwise_count(x[near]).sum(axis=1) <= LOOSE_BITS
    return near


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Have two ordered sets the similarity?"""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= LOOSE_SIMILARITY * (len(both) - shared)


def postings(prints: DataFrame) -> DataFrame:
    """(list, id, sig) for each list that a fingerprint is in; list names the position and its
    byte, and sig begins with that position."""
    target = arrow_schema(prints.sparkSession, "list int, id long, sig binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = batch.num_rows
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, LOOSE_POSITIONS)
            ends = pa.py_buffer(np.arange(0, (n + 1) * LOOSE_POSITIONS, LOOSE_POSITIONS, dtype=np.int32))
            for p in range(0, LOOSE_POSITIONS, LOOSE_POSITIONS // LISTS):
                sig = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(np.roll(raw, -p, axis=1).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(p << 8 | raw[:, p].astype(np.int32)), batch.column(0), sig], schema=target)
        returned()

    return prints.select("id", "sig").mapInArrow(run, "list int, id long, sig binary")


def meetings(lists: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Rows (i, j) of lists: edges that connect what all near pairs connect that are in one list
    and share one of its crossings. Runs of up to SHORT rows are compared pair by pair."""
    out = [np.zeros(0, np.int64)]
    for p, q in _CROSSED:
        key = lists.astype(np.int64) << 16 | sig[:, p].astype(np.int64) << 8 | sig[:, q]
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        start, length = start[length > 1], length[length > 1]
        pairs = []
        for d in range(1, SHORT):
            for k in range(SHORT - d):
                at = start[(length > d + k) & (length <= SHORT)] + k
                pairs.append(np.stack([order[at], order[at + d]], axis=1))
        pairs = np.concatenate(pairs)
        pairs = np.concatenate([part[loosely_near(sig[part[:, 0]], sig[part[:, 1]])] for part in np.array_split(pairs, len(pairs) // AT_ONCE + 1)])
        out.append(pairs[:, 0] << 32 | pairs[:, 1])
        for lo, n in zip(start[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
            own = order[lo : lo + n]
            edges = own[np.array(_flood(own, lambda i, rest, own=own: loosely_near(sig[own[rest]], sig[own[i]])), np.int64).reshape(-1, 2)]
            out.append(edges[:, 0] << 32 | edges[:, 1])
    found = np.unique(np.concatenate(out))
    return np.stack([found >> 32, found & 0xFFFFFFFF], axis=1)


def stars(pairs: np.ndarray) -> np.ndarray:
    """Rows (a, b) that connect what the given ones connect, one for each id but the least of its class,
    which is a: a group whose ids are all paired costs its length, not its square."""
    ids, ends = np.unique(pairs, return_inverse=True)
    label, (a, b) = np.arange(len(ids)), ends.reshape(-1, 2).T
    while (label[a] != label[b]).any():
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    others = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[label[others]], ids[others]], axis=1)


def met(prints: DataFrame) -> DataFrame:
    """(a, b) of ids that connect what all near fingerprints (id, sig) that meet connect. A task's
    lists give stars, so there are at most LISTS rows for each id."""
    dealt = postings(prints).repartition("list").sortWithinPartitions("list")
    target = arrow_schema(prints.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, enough = [], AT_ONCE
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                lists, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                held.append((lists, ids, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, LOOSE_POSITIONS)))
            if not held or (batch is not None and sum(len(x[0]) for x in held) < enough):
                continue
            lists, ids, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            done = len(lists) if batch is None else int(np.searchsorted(lists, lists[-1]))  # the last list may go on
            held, enough = [(lists[done:], ids[done:], sig[done:])], max(AT_ONCE, 2 * (len(lists) - done))
            if done:
                edges = stars(ids[meetings(lists[:done], sig[:done])])
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=target)
        returned()

    return dealt.mapInArrow(run, "a long, b long")


def in_chunks(members: DataFrame) -> DataFrame:
    """Lists by chunks: members of up to CHUNK are one; longer lists are dealt to several, with
    about LEADERS members in all of them. Connects most of a long list, not all."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    everywhere = (F.col("n") > CHUNK) & (F.pmod(F.xxhash64("id", "key"), F.col("n")) < LEADERS)
    chunk = F.when(everywhere, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("key", "id"), chunks).cast("int")))
    return members.withColumn("chunk", F.explode(chunk))


def in_block_pairs(members: DataFrame) -> DataFrame:
    """Lists (key, id, root) so that any two members of unequal root share a chunk: blocks of up to
    about CHUNK, and a chunk for each pair of them. Blocks of the list's largest class meet the others'
    blocks only; so a list that is all but one class is dealt in proportion to its length."""
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / (CHUNK // 2))).cast("int")
    dealt = members.drop("n").join(top, "key").withColumns({"_t": blocks(F.col("top.n")), "_o": blocks(F.col("n") - F.col("top.n"))})
    own = lambda n: F.pmod(F.xxhash64("key", "id"), n).cast("int")
    largest = F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda c: own(F.col("_t")) * F.col("_o") + c)
    others = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("_t") - 1), lambda b: b * F.col("_o") + own(F.col("_o"))),
        F.transform(F.sequence(F.lit(0), F.col("_o") - 1), lambda c: F.col("_t") * F.col("_o") + F.least(c, own(F.col("_o"))) * F.col("_o") + F.greatest(c, own(F.col("_o")))),
    )
    return dealt.withColumn("chunk", F.explode(F.when(F.col("root") == F.col("top.root"), largest).otherwise(others))).select("key", "chunk", "id", "root")


def loose_edges(chunked: DataFrame, prints: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of ids that are linked: for each chunk (key, chunk, id, root), edges that connect what all its
    links connect. Links are near pairs whose sets (id, hashes) have the similarity; root is what an id is
    known to be linked to."""
    dealt = chunked.join(prints.select("id", "sig"), "id").join(sets, "id")
    dealt = dealt.select("key", "chunk", "id", "root", "sig", "hashes").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "id")
    target = arrow_schema(prints.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 4), np.int64), np.zeros((0, LOOSE_POSITIONS), np.uint8), []
        own, sig, hashes = none
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                own = np.concatenate([own, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)])
                sig = np.concatenate([sig, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, LOOSE_POSITIONS)])
                hashes = [*hashes, *batch.column(5).to_pylist()]
            cuts = (np.flatnonzero((own[1:, :2] != own[:-1, :2]).any(axis=1)) + 1).tolist()
            done = len(own) if batch is None else cuts[-1] if cuts else 0  # the last list may go on
            edges = [np.zeros((0, 2), np.int64)]
            for lo, hi in itertools.pairwise([0, *(c for c in cuts if c < done), done]):
                if hi - lo > 1:
                    found = verified_forest(own[lo:hi, 3], sig[lo:hi], hashes[lo:hi])
                    edges.append(own[lo:hi, 2][np.array(found, np.int64).reshape(-1, 2)])
            own, sig, hashes = own[done:], sig[done:], hashes[done:]
            edges = np.unique(np.concatenate(edges), axis=0)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=target)
        returned()

    return dealt.mapInArrow(run, "a long, b long")


def verified_forest(root: np.ndarray, sig: np.ndarray, hashes: list[bytes]) -> list[tuple[int, int]]:
    """Edges that connect what the verified pairs connect, beyond those of equal root. Pairs
    of rows that are connected by then are not looked at."""
    _, label = np.unique(root, return_inverse=True)
    sets = [np.frombuffer(h, np.uint64) for h in hashes]
    edges = []
    for i in range(len(sig) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        for j in rest[loosely_near(sig[rest], sig[i])].tolist():
            if label[i] != label[j] and similar(sets[i], sets[j]):
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def loose_roots(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the fingerprints (id, sig, rk) that have a partner; texts: (rk, text).
    What meets makes loose classes first. Sets are made for their members only, and each class is
    verified in one task; classes of over CHUNK members within chunks and with the leaders, and,
    where they have two roots after that, whole, by pairs of blocks."""

    def lists(members, *more):
        return members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *more).where("n > 1")

    def connected(edges):
        return written(components(edges), "roots")

    def rooted(members, roots):
        named = roots.select(F.col("node").alias("id"), "root")
        return members.join(named, "id", "left").withColumn("root", F.coalesce("root", "id"))

    loose = connected(written(met(prints), "met"))
    members = loose.select(F.col("root").alias("key"), F.col("node").alias("id"), F.col("node").alias("root"))
    edges = None
    for deal in (in_chunks, in_block_pairs):
        open_lists = lists(members, (F.min("root") < F.max("root")).alias("open")).where("open").select("key", "n")
        left = written(members.join(open_lists, "key"), "open")
        # of known size: up to SENT rows are sent to the texts, where more have the texts dealt to them
        involved = written(left.select("id").distinct().join(prints.select("id", "rk"), "id"), "involved")
        small = involved.count() <= SENT
        own = texts.join(F.broadcast(involved) if small else involved, "rk").select("id", "text")
        rows = lambda batch: [(i, shingle_hashes(t).tobytes()) for i, t in batch]
        sets = written(per_row(own, "id long, hashes binary", rows, ["id", "text"]).groupBy("id").agg(F.min("hashes").alias("hashes")), "sets")
        verified = written(loose_edges(deal(left), prints, sets), "verified")
        edges = verified if edges is None else edges.unionByName(verified)
        roots = connected(edges)
        long = left.where(F.col("n") > CHUNK)
        if long.isEmpty():
            break
        # classes that fit a chunk are done; larger ones are dealt so that all of them meets
        members = written(rooted(long.select("key", "id"), roots), "again")
    return roots


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of looser copies stays: the one with the smallest doc_id;
    one without an id stays only if its class has no other. Of equal rows one stays. A
    class's first row is found by sums, and no join has the class as its key."""
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rk", row_key("doc_id", "text"))
    rows = lambda batch: [(i, k, loose_fingerprint(shingle_hashes(t))) for i, k, t in batch]
    prints = written(per_row(names, "doc_id long, rk long, sig binary", rows, ["doc_id", "rk", "text"]), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("first")
    distinct = written(prints.groupBy("sig").agg(first).withColumns({"id": F.xxhash64("sig"), "rk": F.col("first.rk")}), "sigs")
    roots = loose_roots(distinct, names.select("rk", "text"))
    kept = (
        distinct.join(roots, distinct["id"] == roots["node"], "left")
        .groupBy(F.coalesce("root", "id").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.rk").alias(own := f"_rk{uuid.uuid4().hex}"))
    )
    # what goes is less than what stays, and of known size: a small table is sent to the documents
    gone = written(prints.select(F.col("rk").alias(own)).distinct().join(kept, own, "left_anti"), "gone")
    left = docs.withColumn(own, row_key("doc_id", "text")).join(gone, own, "left_anti")
    repeated = written(prints.groupBy(F.col("rk").alias(own)).count().where("count > 1").select(own), "repeated")
    return _one_each(left, repeated, docs.columns, own)


def _one_each(left: DataFrame, repeated: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Of rows with a repeated key one; other rows need no look."""
    names = [F.col(f"`{c}`") for c in columns]
    if repeated.isEmpty():
        return left.select(*names)
    # partial sums collapse the copies before they are dealt; a hash picks one, so that
    # a task that is run again picks the same
    again = left.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_doc"))
    return left.join(repeated, key, "left_anti").select(*names).unionByName(again.select("_doc.*"))


