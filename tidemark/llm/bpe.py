"""Operator 3: BPE encoding by a pair occurrence index, and decoding.

The words of a batch that aren't known yet are laid out in one array of symbols
with links to their neighbours. An index maps each pair's rank to all positions
where the pair stands. The active ranks are applied in ascending order, each to all
its positions at once; the neighbours' new pairs are entered in their lists, and
entries that have gone stale are dropped when their list is used.

In a vocabulary where each symbol comes of one merge, and later than its parts,
a merge creates pairs of higher rank only; for others, a rank is applied to the
first position in each word, then taken up again.

Cases: null counts as empty, which has no ids; special tokens in a text become
their ids, as the library has it; long texts are split piece by piece; repeated
rows get equal ids; an empty table gives no rows; other columns are carried by
the stage and ignored by the query.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, per_row, table

NAME = "word_bpe_49k.json"
#: Code points of text whose new words are encoded together, and words held from one batch to the next.
PIECE, HELD = 8 << 20, 300_000

_SPACE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[b] = chr(256 + k)
    return out


@dataclass
class Vocabulary:
    """Merges as arrays, from the library's file."""

    path: str

    def __post_init__(self):
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.specials).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        first = {}
        for rank, m in enumerate(self.made.tolist()):
            first.setdefault(m, []).append(rank)
        self.ordered = all(
            rank > max(first.get(part, [-1]))
            for rank, parts in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))
            for part in parts
        ) and all(len(x) == 1 for x in first.values())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.any_word = regex.compile(pattern)
        # the same for ASCII, lower-cased texts
        self.ascii_word = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"\p{L}", "a-z").replace(r"[\p{N}]", "[0-9]").replace(r"\p{N}", "0-9"))
        self.special = re.compile("|".join(map(re.escape, self.specials)))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.ascii_word.findall(text.lower())
        # lower() knows a final sigma; the library goes by single characters
        return self.any_word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def merged(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in turn, and where each word's begin (one more at the end)."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    n = len(data)
    symbol = vocabulary.inner[data]
    last = ends - 1
    symbol[last] = vocabulary.final[data[last]]
    word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    after = np.arange(1, n + 1)
    after[last] = n  # position n stands for none
    before = np.arange(-1, n)
    before[np.concatenate([[0], ends[:-1]])] = n
    symbol = np.append(symbol, -1)
    after = np.append(after, n)
    lists: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray) -> list[int]:
        """Put positions into their pairs' lists; returns the ranks that are new."""
        rank = vocabulary.ranks(symbol[at], symbol[after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        new = []
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
            if r in lists:
                lists[r].append(part)
            else:
                lists[r] = [part]
                new.append(r)
        return new

    start = np.flatnonzero(after[:n] < n)
    active = enter(start) if n else []
    heapify(active)
    while active:
        r = heappop(active)
        parts = lists.pop(r)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        a, b = int(vocabulary.left[r]), int(vocabulary.right[r])
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if not len(at):
            continue
        at = np.sort(at)
        if a == b and len(at) > 1:  # of a run of equal symbols, every other position
            joins = after[at[:-1]] == at[1:]
            index = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~joins]), index, 0))
            at = at[(index - begin) % 2 == 0]
        if not vocabulary.ordered:
            _, first = np.unique(word[at], return_index=True)
            if len(first) < len(at):
                lists[r] = [np.delete(at, first)]
                heappush(active, r)
                at = at[first]
        gone = after[at]
        beyond = after[gone]
        symbol[at] = vocabulary.made[r]
        symbol[gone] = -1
        after[at] = beyond
        before[beyond] = at  # at n nothing is read
        left = before[at]
        for new in enter(np.unique(np.concatenate([at[beyond < n], left[left < n]]))):
            heappush(active, new)
    kept = symbol[:n] >= 0
    return symbol[:n][kept], np.concatenate([[0], np.cumsum(kept)[last]]) if n else np.zeros(1, np.int64)


class Codec:
    """Encodes and decodes texts; keeps the words of the latest batches, as rows of
    one array of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint16)
        self.start = np.zeros(1, np.int64)
        for s, i in self.vocabulary.specials.items():
            self._enter(["\0" + s], np.array([i]), np.array([0, 1]))

    def _enter(self, words: list[str], ids: np.ndarray, start: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32 if len(self.vocabulary.tokens) > 1 << 16 else np.uint16)])
        self.start = np.concatenate([self.start, start[1:] + self.start[-1]])

    def _learn(self, groups: list[list[str]]) -> None:
        fresh = list(set().union(*groups).difference(self.known))
        if fresh:
            self._enter(fresh, *merged(self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in fresh]))

    def split(self, text: str) -> list[str]:
        """A text's words and special tokens; these begin with NUL, as no other word with letters does."""
        if not self.vocabulary.special.search(text):
            return self.vocabulary.words(text)
        out, at = [], 0
        for m in self.vocabulary.special.finditer(text):
            out += [*self.vocabulary.words(text[at : m.start()]), "\0" + m[0]]
            at = m.end()
        return out + self.vocabulary.words(text[at:])

    def batch(self, texts: list[str]):
        """An array of ids for each text."""
        group, size = [], 0
        for t in texts:
            group.append(self.split(t))
            size += len(t)
            if size > PIECE:
                yield from self._encoded(group)
                group, size = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[list[str]]):
        if len(self.known) > HELD:
            self._forget()
        self._learn(group)
        for g in group:
            word = np.fromiter(map(self.known.__getitem__, g), np.int64, len(g))
            start, n = self.start[word], self.start[word + 1] - self.start[word]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield self.ids[np.repeat(start, n) + rank].astype("<u4")

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


#: Vocabularies, of which a worker sees one or two; words are kept for a task only.
_vocabularies: dict[str, Vocabulary] = {}


def codec(path: str) -> Codec:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return Codec(_vocabularies[path])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


def decoded_digest(own: Codec, ids: np.ndarray) -> str:
    return sha256(own.decode(ids.tolist()).encode("utf-8", "surrogatepass")).hexdigest()


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, the number of ids, and digests of ids and decoded text."""

    def rows(batch, own=[]):  # noqa: B006
        if not own:
            own.append(codec(path or default_path()))
        ids = own[0].batch([t or "" for _, t in batch])
        return [
            (i, len(x), sha256(x.tobytes()).hexdigest(), decoded_digest(own[0], x))
            for (i, _), x in zip(batch, ids, strict=True)
        ]

    return per_row(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, [doc_id, text])


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``n_tokens``; if asked for, with ``decoded_sha256``, the
    digest of the text that the ids are decoded to."""

    def rows(batch, own=[]):  # noqa: B006
        if not own:
            own.append(codec(path or default_path()))
        made = ((x.astype(np.int32), len(x)) for x in own[0].batch([t or "" for (t,) in batch]))
        return [(*r, decoded_digest(own[0], r[0])) for r in made] if decoded else list(made)

    return add_columns(docs, "ids array<int>, n_tokens long" + ", decoded_sha256 string" * decoded, rows, [text])


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``, of the ids."""

    def rows(batch):
        own = codec(path or default_path())
        return [(own.decode(x or []),) for (x,) in batch]

    return add_columns(docs, "decoded string", rows, [ids])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes, and decodes what it encoded: ``decoded_sha256`` tells a reader of the ids what they stand for."""
    return encode(docs, decoded=True)
