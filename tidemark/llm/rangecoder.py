"""Operator 1: token ids in a compressed binary file.

Ids are coded in blocks that share nothing: each starts from the same model, has
its own code words and checksums, and can be read alone. Within a block, three
predictions are mixed. Order 2 and order 1 each name an id, seen last after the
same two ids or the same one, with a confidence that follows its hits; order 0
spreads over all ids by adaptive counts. Weights follow how likely each made the
ids so far. The mixture cuts the coder's range: a share for order 2's id, one for
order 1's, and the rest, in which order 0 codes the id. The model learns from 16 ids
at once. The coder is a range coder with 48 bits, which puts out words of 16; the
encoder settles carries at the end.

Blocks of a batch are coded side by side: one step codes the next id of every
block, on arrays over the blocks. All arithmetic is integer, or IEEE sums,
products and quotients of floats in a fixed order, so readers repeat it exactly.

A block file is a Parquet table with a row for each block: (part, block, first,
n_ids, payload). The payload holds all that is needed to read it: magic, length,
checksums, the table of documents' pieces, and the code words. Parts ascend in
doc_id, blocks in part, pieces in block. A document longer than a block is cut.

Cases: a null or empty text has the end id only; a null doc_id comes first; rows
with one doc_id are stored each, in the order of their texts; very long texts are cut into blocks; an empty table
gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, per_row, returned, shared_dir, table, written

NAME, END = "byte_bpe_50k.json", 0
#: Ids in a block, and blocks coded side by side, at most.
BLOCK, LANES = 4096, 2048
#: Bytes of text whose new words go to the library together.
TEXT = 4 << 20
MAGIC = b"TMR2"
HEADER = struct.Struct("<4sIIII")  # magic, ids, pieces, crc32 of the ids, crc32 of all that follows
PIECES = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("last", "u1"), ("piece", "<u4"), ("n", "<u4")])

# The model's fixed values: a change makes another format.
BITS = (9, 10)  # slots of order 1 and order 2, as powers of two
GROUP = 16  # ids after which the model learns from them
#: Order 0 counts runs of ids, short ones where ids are low and frequent: (ids, width as a power of two).
RUNS = ((1024, 2), (3072, 5), (12288, 7), (49152, 9))
WIDTH = np.repeat([w for _, w in RUNS], [n >> w for n, w in RUNS]).astype(np.int32)
BUCKETS, WIDEST = len(WIDTH), int(WIDTH.max())
FIRST = (np.cumsum(1 << WIDTH) - (1 << WIDTH)).astype(np.int32)  # each run's first id
RUN = np.repeat(np.arange(BUCKETS), 1 << WIDTH)  # each id's run
PLACE = (RUN << 16 | np.arange(1 << 16) - FIRST[RUN]).astype(np.int32)  # and its place there
COUNTS = (1 + np.add.reduceat((1 << 24) // (np.arange(1 << 16) + 64), FIRST) // 4096).astype(np.int32)  # before any id came
STEP, REFRESH = 24, 1024  # added for an id; ids until order 0's shares are worked out anew
EARLY = (64, 256)  # and ids after which they are besides
TOTAL, SHARES = 1 << 16, 1 << 12  # shares of the mixture; of order 0's runs
STATES, RATE, RARE, PACE = 8, np.float32(1 / 12), np.float32(1 / 4096), np.float32(0.25)
# The coder's numbers are whole and below 2^53, so that floats hold them.
FULL, LOW, WORD = 2.0**48, 2.0**32, 2.0**16
MIXED, PLAIN = 1 / TOTAL, 1 / (SHARES << WIDEST)


def slots(before: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of order 1 and of order 2 within the blocks' tables, from the last two ids."""
    one = before * np.uint16(40503)
    return one >> np.uint16(16 - BITS[0]), (one + earlier * np.uint16(30011)) >> np.uint16(16 - BITS[1])


class Model:
    """The predictions for the next ids of each of n blocks. It learns from GROUP ids at
    once, in all blocks that go on: these are the first m."""

    def __init__(self, n: int):
        row = np.arange(n)
        self.table = np.zeros(n * sum(1 << b for b in BITS), np.int32)  # id << 3 | state
        self.base = np.stack([row << BITS[0], (n << BITS[0]) + (row << BITS[1])])
        self.sure = np.empty((2, n, STATES), np.float32)
        for order, top in enumerate((0.75, 0.85)):
            self.sure[order] = np.linspace(0.05, top, STATES)
        self.base_state = np.arange(2 * n).reshape(2, n) * STATES
        self.weight = np.full((2, n), 1 / 3, np.float32)  # order 0 has the rest
        self.shares = np.empty((2, n, STATES))  # of the mixture, by an entry's state
        self.counts = np.tile(COUNTS.astype(np.int64), (n, 1))
        self.base_run, self.base_share = row * BUCKETS, row * SHARES
        self.runs = np.empty((n, BUCKETS), np.int32)  # start << 13 | share
        self.lookup = np.empty((n, SHARES), np.uint16)  # the run that has a share
        self.counted = 0

    def _refresh(self, lo: int, hi: int) -> None:
        """Shares of 2^12 in all, one at least for each run."""
        sums = np.cumsum(self.counts[lo:hi], axis=1, dtype=np.int32)
        ends = (sums * ((SHARES - BUCKETS) / sums[:, -1:])).astype(np.int32)
        ends += np.arange(1, BUCKETS + 1, dtype=np.int32)
        ends[:, -1] = SHARES
        size = ends.copy()
        size[:, 1:] -= ends[:, :-1]
        ends -= size
        ends <<= 13
        np.bitwise_or(ends, size, out=self.runs[lo:hi])
        runs = np.tile(np.arange(BUCKETS, dtype=np.uint16), hi - lo)
        self.lookup[lo:hi] = np.repeat(runs, size.reshape(-1)).reshape(hi - lo, SHARES)

    def prepare(self, ids: np.ndarray, t: int, m: int) -> None:
        """For the ids from t on; ids: those before, in rows."""
        np.multiply(self.weight[:, :m, None] * self.sure[:, :m], np.float32(TOTAL - 512), out=self.shares[:, :m])
        np.floor(self.shares[:, :m], out=self.shares[:, :m])
        self.shares[:, :m] += 1
        if t % REFRESH == 0 or t in EARLY:
            if not t:  # all blocks are alike
                self._refresh(0, 1)
                self.runs[1:], self.lookup[1:] = self.runs[0], self.lookup[0]
                return
            for lo in range(0, m, 128):  # arrays that fit a cache
                hi = min(lo + 128, m)
                came = RUN.take(ids[self.counted : t, lo:hi])
                came += self.base_run[: hi - lo]
                seen = np.bincount(came.reshape(-1), minlength=(hi - lo) * BUCKETS)
                seen *= STEP
                self.counts[lo:hi] += seen.reshape(hi - lo, BUCKETS)
                self._refresh(lo, hi)
            self.counted = t

    def mixed(self, entry: np.ndarray, named: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares of order 1's id and order 2's; the latter has both if they are one. Over the last two axes."""
        share = self.shares.reshape(-1).take((entry & 7) + self.base_state[:, :m])
        one, two = share[..., 0, :], share[..., 1, :]
        both = one * (named[..., 0, :] == named[..., 1, :])
        two += both
        one -= both
        return one, two

    def learn(self, slot: np.ndarray, entry: np.ndarray, x: np.ndarray, m: int) -> None:
        """slot, entry: by id, order and block; x: the ids that came."""
        came, state = x[:, None].astype(np.int32) << 3, entry & 7
        named = entry - state
        hit = named == came
        # hits strengthen an entry, a miss weakens it, or replaces it if it is weak; of several in a slot, the last counts
        entry = np.where(hit, entry + (state < STATES - 1), np.where(state > 1, named + (state >> 1), came))
        self.table[slot.reshape(-1)] = entry.reshape(-1)
        # every second id tells how far to trust the predictions
        hit = hit[::2]
        at = state[::2] + self.base_state[:, :m]
        c = self.sure.reshape(-1).take(at)
        # weights go towards the predictions' shares in what came; whole numbers, whose sums have no order
        likely = np.where(hit, c, (1 - c) * RARE)
        w = self.weight[:, :m]
        likely *= w
        likely *= np.float32(1 << 16) / (likely[:, :1] + likely[:, 1:] + (1 - w[0] - w[1]) * RARE)
        part = likely.astype(np.int32).sum(axis=0, dtype=np.int32).astype(np.float32) * np.float32(1 / (len(hit) << 16))
        w += (part - w) * PACE
        w *= np.float32(0.98)
        w += np.float32(0.02 / 3)
        flat = self.sure.reshape(-1)
        at <<= 1
        at += hit
        missed, hits = np.bincount(at.reshape(-1), minlength=2 * flat.size).astype(np.float32).reshape(-1, 2).T
        flat += (hits - (hits + missed) * flat) * RATE


def _side_by_side(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of blocks, longest first, and how many go on at each place."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest + 1), "right")


def encode(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The code words of each block of ids (below 65,536)."""
    order, active = _side_by_side(np.array([len(b) for b in blocks], np.int64))
    longest, n = len(active) - 1, len(blocks)
    ids = np.zeros((longest + 2 + GROUP, n), np.uint16)  # two zeros before the first
    for lane, k in enumerate(order):
        ids[2 : 2 + len(blocks[k]), lane] = blocks[k]
    words = np.zeros((longest + 64) * n, np.uint32)  # by place and block; a carry stays with its word until the end
    at = np.arange(n)
    low, span = np.zeros(n), np.full(n, FULL)
    model = Model(n)

    def put(where, value):
        """Put out the top words of some blocks; what stays."""
        top = np.floor(value * (1 / LOW))
        words[where] = top.astype(np.uint32)
        return (value - top * LOW) * WORD

    def finish(blocks, value):
        for _ in range(3):
            value = put(at[blocks], value)
            at[blocks] += n

    finish(slice(active[0], n), low[active[0] :])
    for t in range(0, longest, GROUP):
        m, g = int(active[t]), min(GROUP, longest - t)
        model.prepare(ids[2:], t, m)
        if at.max() + 4 * GROUP * n > len(words):
            words = np.concatenate([words, np.zeros_like(words)])
        x = ids[t + 2 : t + 2 + g, :m]
        slot = np.stack(slots(ids[t + 1 : t + 1 + g, :m], ids[t : t + g, :m]), axis=1) + model.base[:, :m]
        entry = model.table.take(slot)
        named = entry >> 3
        one, two = model.mixed(entry, named, m)
        hit = named == x[:, None]
        second, first = hit[:, 1], hit[:, 0]
        rest = ~(second | first)
        both = one + two
        start = np.where(second, 0, np.where(first, two, both))
        share = np.where(second, two, np.where(first, one, TOTAL - both))
        # order 0 has the other ids only; those that were predicted take all of its range
        run = PLACE.take(x)
        place, run = run & 0xFFFF, run >> 16
        runs = model.runs.reshape(-1).take(run + model.base_run[:m])
        size = (runs & 0x1FFF) << (WIDEST - WIDTH.take(run))
        plain = np.where(rest, (runs >> 13 << WIDEST) + place * size, 0).astype(np.float64)
        size, part = np.where(rest, size, 1.0), np.where(rest, PLAIN, 1.0)
        ended = []
        l, s, a = low[:m], span[:m], at[:m]
        for k in range(g):
            for begin, wide, scale in ((start, share, MIXED), (plain, size, part[k])):
                unit = np.multiply(s, scale)
                np.floor(unit, out=unit)
                np.multiply(unit, wide[k], out=s)
                unit *= begin[k]
                l += unit
            small = s < LOW
            top = np.floor(l * (1 / LOW))
            words[a] = top.astype(np.uint32)  # where it isn't ready, the next one takes its place
            top *= small
            top *= LOW
            l -= top
            factor = np.where(small, WORD, 1.0)
            l *= factor
            s *= factor
            a += small * n
            more = (s < LOW).nonzero()[0]
            while len(more):
                l[more] = put(a[more], l[more])
                s[more] *= WORD
                a[more] += n
                more = more[s[more] < LOW]
            if active[t + k + 1] < active[t + k]:
                blocks = slice(active[t + k + 1], active[t + k])
                ended.append((blocks, l[blocks].copy(), a[blocks].copy()))
        for blocks, value, place in ended:
            at[blocks] = place
            finish(blocks, value)
        model.learn(slot, entry, x, m)
    used = at // max(n, 1)
    words = words.reshape(-1, n)[: used.max(initial=0)]
    words[np.arange(len(words))[:, None] >= used] = 0
    carry = words >> 16
    while carry.any():
        words &= 0xFFFF
        words[:-1] += carry[1:]
        carry = words >> 16
    words = np.ascontiguousarray(words.astype(np.uint16).T)
    out = [None] * n
    for lane, k in enumerate(order):
        out[k] = words[lane, : used[lane]].copy()
    return out


def decode(codes: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block, from its code words and length."""
    order, active = _side_by_side(np.array(lengths, np.int64))
    longest, n = len(active) - 1, len(codes)
    width = max((len(c) for c in codes), default=0) + 4 * GROUP  # blocks that have ended read on
    words = np.zeros((n, width), np.uint16)
    for lane, k in enumerate(order):
        words[lane, : len(codes[k])] = codes[k]
    words = np.ascontiguousarray(words.T)
    code, model = (words[0] * WORD + words[1]) * WORD + words[2], Model(n)
    words = words.reshape(-1)
    at_word, span = np.arange(n) + 3 * n, np.full(n, FULL)
    ids = np.zeros((longest + 2 + GROUP, n), np.uint16)  # two zeros before the first
    runs, lookup = model.runs.reshape(-1), model.lookup.reshape(-1)
    for t in range(0, longest, GROUP):
        m, g = int(active[t]), min(GROUP, longest - t)
        model.prepare(ids[2:], t, m)
        slot, entry = np.empty((g, 2, m), np.int64), np.empty((g, 2, m), np.int32)
        base, c, s, a = model.base[:, :m], code[:m], span[:m], at_word[:m]
        for k in range(g):
            one, two = slots(ids[t + k + 1, :m], ids[t + k, :m])
            np.add(base[0], one, out=slot[k, 0])
            np.add(base[1], two, out=slot[k, 1])
            model.table.take(slot[k], out=entry[k], mode="clip")
            named = entry[k] >> 3
            one, two = model.mixed(entry[k], named, m)
            both = one + two
            unit = s * MIXED
            np.floor(unit, out=unit)
            v = c / unit
            later, left = v >= two, v >= both
            c -= np.where(left, both, two * later) * unit
            x = np.where(later, named[0], named[1])
            np.multiply(np.where(later, one, two), unit, out=s)
            rest = left.nonzero()[0]
            # order 0
            unit = np.floor((TOTAL - both.take(rest)) * unit.take(rest) * PLAIN)
            ahead = c.take(rest)
            v = np.minimum(ahead / unit, (SHARES << WIDEST) - 1.0).astype(np.int32)
            run = lookup.take(model.base_share.take(rest) + (v >> WIDEST))
            start = runs.take(model.base_run.take(rest) + run)
            own = ((start & 0x1FFF) << (WIDEST - WIDTH.take(run))) * unit
            ahead -= (start >> 13 << WIDEST) * unit
            place = np.floor(ahead / own)
            c[rest] = ahead - place * own
            s[rest] = own
            x[rest] = FIRST.take(run) + place.astype(np.int32)
            ids[t + k + 2, :m] = x
            small = s < LOW
            factor = np.where(small, WORD, 1.0)
            s *= factor
            c *= factor
            c += words.take(a) * small
            a += small * n
            more = (s < LOW).nonzero()[0]
            while len(more):
                s[more] *= WORD
                c[more] = c[more] * WORD + words[a[more]]
                a[more] += n
                more = more[s[more] < LOW]
        model.learn(slot, entry, ids[t + 2 : t + 2 + g, :m], m)
    ids = np.ascontiguousarray(ids[2:].T)
    out = [None] * n
    for lane, k in enumerate(order):
        out[k] = ids[lane, : lengths[k]].copy()
    return out


class Blocks:
    """Collects documents' ids into blocks, in order."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.pieces: list[tuple] = []
        self.size = 0
        self.full: list[tuple[np.ndarray, list[tuple]]] = []

    def close(self) -> None:
        if self.pieces:
            self.full.append((np.concatenate(self.ids), self.pieces))
            self.ids, self.pieces, self.size = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document that fits a block isn't cut."""
        if self.size + len(ids) > BLOCK:
            self.close()
        for k in range(0, len(ids), BLOCK):
            part = ids[k : k + BLOCK]
            self.ids.append(part)
            self.pieces.append((doc_id or 0, doc_id is None, k + BLOCK >= len(ids), k // BLOCK, len(part)))
            self.size += len(part)
            if self.size >= BLOCK:
                self.close()


def payload(ids: np.ndarray, pieces: list[tuple], words: np.ndarray) -> bytes:
    body = np.array(pieces, PIECES).tobytes() + words.astype("<u2").tobytes()
    return HEADER.pack(MAGIC, len(ids), len(pieces), crc32(ids.astype("<u4").tobytes()), crc32(body)) + body


def opened(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(number of ids, their checksum, pieces, code words) of a payload."""
    magic, n, k, ids_crc, crc = HEADER.unpack_from(data)
    body = data[HEADER.size :]
    if magic != MAGIC or crc32(body) != crc:
        raise ValueError("damaged block")
    cut = k * PIECES.itemsize
    return n, ids_crc, np.frombuffer(body[:cut], PIECES), np.frombuffer(body[cut:], "<u2")


def read_blocks(payloads: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """(ids as bytes, pieces) of each block; all blocks are decoded side by side."""
    heads = [opened(p) for p in payloads]
    for (_, crc, pieces, _), ids in zip(heads, decode([h[3] for h in heads], [h[0] for h in heads]), strict=True):
        raw = ids.astype("<u4").tobytes()
        if crc32(raw) != crc:
            raise ValueError("ids don't match their checksum")
        yield raw, pieces


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def tokenizer(path: str | None):
    """The library's tokenizer; a task has one core, so it gets one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or default_path())


#: Byte-level vocabularies split a text before any merge by the rule
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, GAP = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"\s+")


@functools.cache
def kinds() -> np.ndarray:
    """Of each code point: 0 a letter, 1 a number, 2 white space, 3 anything else."""
    out, all_points = np.full(0x110000, 3, np.uint8), "".join(map(chr, range(0x110000)))
    for k, rule in enumerate((LETTER, NUMBER, GAP)):
        for m in rule.finditer(all_points):
            out[m.start() : m.end()] = k
    return out


def split_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the rule's matches begin, as booleans, in code points of texts without gaps
    between them; first: where texts begin, in the same form, and true once more at the end."""
    n = len(points)
    kind = np.concatenate([kinds().take(points), np.zeros(1, np.uint8)])
    gap = kind == 2
    start = np.ones(n + 1, bool)
    # of another kind than the one before, unless that is a space, which goes with what follows
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= gap[1:] | (points != 32)
    # the last of several gaps is by itself where a text goes on
    start[1:-1] |= gap[1:-1] & ~gap[2:] & ~first[2:]
    start |= first
    quotes = np.flatnonzero((points == 39) & start[:-1])
    if len(quotes):
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        one[first[quotes + 1]] = 0  # the text has ended
        two[first[np.minimum(quotes + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quotes[short | long] + 1] = False
        start[quotes[long] + 2] = False
        start[quotes[short] + 2] = True
        start[quotes[long] + 3] = True
    return start[:-1]


@functools.cache
def byte_letters() -> np.ndarray:
    """Byte-level vocabularies write a byte as a letter: of each byte, that letter's code."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint16)
    out[shown] = shown
    out[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    return out


class Encoder:
    """Ids as the library's; a merge never crosses a split, so the ids of split words
    are kept in an Arrow array, and the library sees each but once, until they are more than held."""

    def __init__(self, path: str | None, held: int = 500_000):
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.known, self.held = tokenizer(path), held
        self.special = re.compile("|".join(re.escape(t.content) for t in self.known.get_added_tokens_decoder().values()) or r"(?!)")
        # the same model, for words in the vocabulary's letters with a space between them
        self.spaced = tokenizer(path)
        self.spaced.pre_tokenizer = WhitespaceSplit()
        self.size = np.zeros(1 << 16, np.int64)  # bytes of each id
        for token, i in self.known.get_vocab().items():
            self.size[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.ids, self.start = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    @property
    def words(self) -> set[str]:
        return set(self.names.to_pylist())

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.known.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words in turn and where each word's end, by a text for 256 words; None if
        ids don't end with the words, as where the vocabulary has another alphabet."""
        ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        letters = byte_letters()[np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
        ends = ends[1:] - ends[0]
        lone = np.insert(letters, ends[:-1], np.uint16(32))
        got, at = [], 0
        for k in range(255, len(words) + 255, 256):
            k = min(k, len(words) - 1)
            upto = ends[k] + k
            (e,) = self.spaced.encode_batch_fast([lone[at:upto].tobytes().decode("utf-16-le")], add_special_tokens=False)
            got.append(np.array(e.ids, np.uint16))
            at = upto + 1
        ids = np.concatenate(got)
        place = np.cumsum(self.size[ids])
        cuts = np.searchsorted(place, ends)
        return (ids, cuts + 1) if place[-1] == ends[-1] and (place[cuts] == ends).all() else None

    def _learn(self, fresh: pa.LargeStringArray) -> None:
        if not len(fresh):
            return
        got = self._spaced(fresh)
        if got is None:
            each = self._library(fresh.to_pylist())
            got = np.fromiter(itertools.chain.from_iterable(each), np.uint16), np.cumsum([len(x) for x in each])
        self.names = pa.concat_arrays([self.names, fresh])
        self.start = np.concatenate([self.start, self.start[-1] + got[1]])
        self.ids = np.concatenate([self.ids, got[0]])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts with a special token's name go to the library whole."""
        if len(self.names) > self.held:
            self._forget()
        whole = {k: t for k, t in enumerate(texts) if self.special.search(t)}
        split = ["" if k in whole else t for k, t in enumerate(texts)]
        raw = "".join(split)
        points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in split], dtype=np.int64)
        first = np.zeros(len(points) + 1, bool)
        first[ends] = first[0] = True
        starts = np.append(np.flatnonzero(split_starts(points, first)), len(points))
        data, at = raw.encode(), starts
        if len(data) > len(points):
            begin = np.frombuffer(data, np.int8) >= -64  # of a code point
            at = np.append(np.flatnonzero(begin).take(starts[:-1]), len(data))
        words = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        number = pc.index_in(words.dictionary, self.names)
        fresh, before = number.is_null(), len(self.names)
        self._learn(words.dictionary.filter(fresh))
        number, fresh = pc.fill_null(number, 0).to_numpy().astype(np.int64), fresh.to_numpy(zero_copy_only=False)
        number[fresh] = np.arange(before, len(self.names))
        named = number[words.indices.to_numpy()]
        start = self.start[named]
        n = self.start[named + 1] - start
        sums = np.cumsum(n)
        ids = self.ids[np.arange(n.sum()) + np.repeat(start - sums + n, n)]
        cuts = np.append(0, sums)[np.searchsorted(starts, ends)]
        out = np.split(ids, cuts)[:-1]
        for k, t in whole.items():
            out[k] = np.array(self._library([t])[0], np.uint16)
        return out


@functools.cache
def encoder(path: str | None) -> Encoder:
    """A worker's own: its later tasks find the words known."""
    return Encoder(path)


def grouped(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """A batch's first two columns in groups of about TEXT bytes of text."""
    at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // TEXT
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [batch.num_rows]]).tolist()
    for lo, hi in itertools.pairwise(cuts):
        yield tuple(batch.column(k)[lo:hi].to_pylist() for k in range(2))


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> None:
    """Write a block file of all documents, in ascending doc_id."""
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    ddl = "part int, block long, first long, n_ids int, payload binary"
    target = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks, block, first, part = encoder(vocabulary), Blocks(), 0, 0, 0

        def rows(ready):
            nonlocal block, first
            out = []
            for (ids, pieces), words in zip(ready, encode([b[0] for b in ready]), strict=True):
                out.append((part, block, first, len(ids), payload(ids, pieces, words)))
                block, first = block + 1, first + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for names, texts in grouped(batch):
                for i, ids in zip(names, known.batch(texts), strict=True):
                    blocks.add(i, np.append(ids, np.uint16(END)))
                while len(blocks.full) >= LANES:
                    yield rows(blocks.full[:LANES])
                    del blocks.full[:LANES]
        blocks.close()
        if blocks.full:
            yield rows(blocks.full)
        returned()

    ordered.mapInArrow(run, ddl).write.parquet(path)


def _decoded(spark: SparkSession, path: str, ddl: str, row) -> DataFrame:
    """Rows ``row(part, first, doc_id, piece, last, ids as bytes)`` of each piece in a block
    file; first counts the part's ids before the piece."""
    target = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = -(-batch.num_rows // -(-batch.num_rows // LANES))  # groups of equal size
            for lo in range(0, batch.num_rows, step):
                part, first, payloads = (batch.column(k)[lo : lo + step].to_pylist() for k in range(3))
                out = []
                for p, f, (raw, pieces) in zip(part, first, read_blocks(payloads), strict=True):
                    at = 0
                    for doc_id, null, last, piece, n in pieces.tolist():
                        out.append(row(p, f + at, None if null else doc_id, piece, bool(last), raw[4 * at : 4 * (at + n)]))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)
        returned()

    return spark.read.parquet(path).select("part", "first", "payload").mapInArrow(run, ddl)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, first, doc_id, piece, last, ids): the pieces of a block file; first
    counts the part's ids before the piece, ids is binary, little-endian in 32 bits."""
    return _decoded(spark, path, "part int, first long, doc_id long, piece long, last boolean, ids binary", lambda *x: x)


# Checksums of whole documents from those of their pieces: a checksum is a polynomial over
# GF(2) modulo CRC-32's, which a text that follows shifts by its bits.
_CRC, _ORDER = 0xEDB88320, (1 << 32) - 1


def _times(a: int, b: int) -> int:
    """The product; bit 31 is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_CRC if b & 1 else 0)
    return out


@functools.cache
def _powers() -> list[list[int]]:
    """Shifts by up to 255 bits, by 256 times as many, and so on."""
    out, unit = [], 1 << 30
    for _ in range(4):
        out.append(list(itertools.accumulate(range(255), lambda a, _, unit=unit: _times(a, unit), initial=1 << 31)))
        unit = _times(out[-1][-1], unit)
    return out


def shifted(crc: int, n: int) -> int:
    """A checksum's part once n bytes follow; -n takes that back."""
    n = 8 * n % _ORDER
    for row in _powers():
        crc, n = _times(crc, row[n & 255]) if n & 255 else crc, n >> 8
    return crc


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in a block file. The file is
    decoded once, to a row for each piece, and a cut document's checksum is put together
    from its pieces' by sums, so that no document is gathered."""

    def row(part, first, doc_id, piece, last, raw):
        crc, n = crc32(raw), len(raw) // 4
        if piece or not last:  # as it would be at the document's start
            crc = shifted(crc, -4 * (piece * BLOCK + n))
        return part, first - piece * BLOCK, doc_id, last and not piece, piece * BLOCK + n, crc

    names = ["part", "first", "doc_id"]
    pieces = written(_decoded(spark, path, "part int, first long, doc_id long, whole boolean, n_tokens long, crc long", row), "pieces")
    # a document's start in its part names it
    cut = pieces.where("NOT whole").groupBy(*names).agg(F.max("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("crc"))

    def summed(batch):
        return [(*x, n, shifted(crc, 4 * n)) for *x, n, crc in batch]

    ddl = "part int, first long, doc_id long, n_tokens long, crc long"
    joined = per_row(cut, ddl, summed, [*names, "n_tokens", "crc"])
    # a row for each part, of which there are as many as tasks wrote
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, rows = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "part int, before long")
    return (
        pieces.where("whole").drop("whole").unionByName(joined)
        .join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return documents(spark, path)
