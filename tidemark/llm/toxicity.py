"""Operator 13: toxic passages as maximum-scoring segments of token log-odds.

*Tokens.* A word (a run of letters, case folded) scores the log-odds that a text with it is
toxic, above those of the corpus. Words and their families (the first ``STEM`` letters) are
counted by distinct texts; a family's share has a Dirichlet prior at the corpus's share, a
word's a prior at its family's, so that an unseen word scores as its family does and rare
words score little. The k-th use of a word in a text tells a k-th of that. ``DRIFT`` is
taken off each token, so that passages end.

*Passages.* One scan keeps the maximal segments (Ruzzo and Tompa): no extension and no part of
one scores more. Each token is pushed once and merged once; pointers skip what can't be a start.

*Calibration.* The best segment of n clean tokens follows an extreme-value law,
P(S >= s) = 1 - exp(-K n exp(-lambda s)). K and lambda are fitted to clean labelled texts, each
scored without its own counts. A passage is significant where fewer than one such is expected;
the passages of a document are aggregated by the law of the sum of the r best. Its -log p is
read off a rising curve fitted to the labelled texts, again each without its own counts.

Learned from labelled rows with crc32(doc_id) mod 5 other than 0, of which at most about
``SAMPLE`` are taken, by a hash; the model holds at most ``MODEL`` entries. Scores depend on the
text alone. Equal texts count once (labelled toxic if one of them is), so copies don't teach twice.

Cases: a null text is empty; empty texts have no passage; long texts are scanned whole, in linear
time; a null doc_id is not learned from, and its ``held_out`` is null; rows that repeat get equal
scores; of several labels of a doc_id any 1 counts, null labels count as missing; without labels of
both kinds each score is the share of toxic ones (0 if there are none); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, per_row, returned, sliced, table, written

WORD = re.compile(r"[^\W\d_]+")
#: Letters that make a family; longer words than LONG are known by a digest.
STEM, LONG = 4, 64
#: Strength of the Dirichlet priors, in texts; what each token costs; log-odds below which an entry is left out.
PRIOR, DRIFT, LEAST = 4.0, 0.7, 0.3
#: Bounds of the labelled sample and of the model.
SAMPLE, MODEL = 200_000, 500_000
FOLDS = 5
#: Bound of -log p for the calibration curve.
FAR = 60.0
#: How much of a score orders texts within a level of the curve.
TILT = 1e-3


def folded(word: str) -> str:
    word = word.lower()
    return word if len(word) <= LONG else f"#{blake2b(word.encode(), digest_size=12).hexdigest()}"


def family(word: str) -> str:
    return word[:STEM] + "*"


def entries(text: str) -> set[str]:
    """The words of a text and their families."""
    words = {folded(w) for w in set(WORD.findall(text))}
    return words | {family(w) for w in words}


@dataclass
class Counts:
    """Texts with an entry, by label: what the model knows."""

    toxic: int
    clean: int
    known: dict[str, tuple[int, int]]

    def log_odds(self, word: str, own: int | None = None) -> float:
        """Of a folded word; own: the label of a text that has it and is to be left out."""
        t_own, c_own = (own == 1, own == 0) if own is not None else (0, 0)
        n_toxic, n_clean = self.toxic - t_own, self.clean - c_own
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        prior = share
        for entry in (family(word), word):
            t, c = self.known.get(entry, (0, 0))
            t, c = max(t - t_own, 0), max(c - c_own, 0)
            prior = (t + PRIOR * prior) / (t + c + PRIOR)
        return math.log(prior / (1 - prior)) - math.log(share / (1 - share))


class Scores(dict):
    """Token scores by word as written; worked out once a word, the latest are held."""

    def __init__(self, counts: Counts, own: int | None = None, held: int = 500_000):
        super().__init__()
        self.counts, self.own, self.held = counts, own, held

    def __missing__(self, word: str) -> float:
        odds = self.counts.log_odds(folded(word), self.own)
        score = (odds if abs(odds) >= LEAST else 0.0) - DRIFT
        if len(self) >= self.held:
            self.clear()
        self[word] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first, after last) of all maximal segments, in order."""
    ends = np.cumsum(scores)
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, after last, latest with a lower start
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, first = float(ends[i] - scores[i]), float(ends[i]), i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, i + 1, j))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(right - left, first, after) for left, right, first, after, _ in kept]


def scanned(text: str, scores: Scores) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of tokens and the maximal segments; repeats of a word are discounted."""
    words = WORD.findall(text)
    own = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    seen: Counter = Counter()
    for i in np.flatnonzero(own > 0).tolist():
        seen[words[i]] += 1
        own[i] = (own[i] + DRIFT) / seen[words[i]] - DRIFT
    return len(words), segments(own)


def _single(above: float) -> float:
    """-log of the chance that clean tokens hold a segment that far above what is expected."""
    return above if above > 30 else -math.log(-math.expm1(-math.exp(min(-above, 30.0))))


@dataclass
class Law:
    """The extreme-value law of clean texts, and the curve from -log p to a probability."""

    scale: float = 1.0  # lambda
    rate: float = 1.0  # K
    curve: list[tuple[float, float]] = field(default_factory=list)  # -log p and the share of toxic texts there

    def bits(self, n: int, score: float) -> float:
        """How far a segment is above what n clean tokens are expected to hold."""
        return self.scale * score - math.log(self.rate * n)

    def surprise(self, n: int, found: list[tuple[float, int, int]]) -> float:
        """-log p of a document's significant segments together: the least p of the sums of
        the r best, each r paid for by a factor of two."""
        above = sorted((b for s, _, _ in found if (b := self.bits(n, s)) > 0), reverse=True)
        if not above:
            best = max((self.bits(n, s) for s, _, _ in found), default=-math.inf)
            return _single(best) if found else 0.0
        low, total = -math.inf, 0.0
        for r, b in enumerate(above, 1):
            total += b
            log_p = -_single(b) if r == 1 else -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            low = max(low, -log_p - (r - 1) * math.log(2))
        return max(low, 0.0)

    def score(self, surprise: float) -> float:
        at = min(surprise, FAR)
        level = float(np.interp(at, [x for x, _ in self.curve], [y for _, y in self.curve]))
        return (1 - TILT) * level + TILT * level * at / FAR  # the level is flat at both ends


def fitted_law(best: list[tuple[float, float, int]]) -> Law:
    """Lambda and K by maximum likelihood from (best score, tokens, texts) of clean texts; texts
    without a segment say that their best is below any. K follows from lambda."""
    some = np.array([(s, n, k) for s, n, k in best if s > 0]).reshape(-1, 3)
    none = sum(n * k for s, n, k in best if s <= 0)
    total = some[:, 2].sum()
    if not total:
        return Law()
    likely, law = -math.inf, Law()
    for scale in np.geomspace(0.05, 5, 400):
        rate = total / ((some[:, 2] * some[:, 1] * np.exp(-scale * some[:, 0])).sum() + none)
        value = total * (math.log(rate) + math.log(scale) - 1) - scale * (some[:, 2] * some[:, 0]).sum()
        if value > likely:
            likely, law = value, Law(float(scale), float(rate))
    return law


def fitted_curve(law: Law, seen: list[tuple[float, int, int]]) -> Law:
    """The rising step curve nearest to (-log p, label, texts), by pooling neighbours that
    fall; scores are read off between the middles of its steps. Unlike a logistic curve it
    isn't bent by labels that are wrong at either end."""
    share = sum(k * y for _, y, k in seen) / sum(k for *_, k in seen)
    steps: list[list[float]] = []  # texts, toxic, sum of -log p
    for x in sorted({min(s, FAR) for s, _, _ in seen}):
        own = [(y, k) for s, y, k in seen if min(s, FAR) == x]
        n = sum(k for _, k in own)
        steps.append([n, sum(y * k for y, k in own), n * x])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            n, t, total = steps.pop()
            steps[-1] = [steps[-1][0] + n, steps[-1][1] + t, steps[-1][2] + total]
    law.curve = [(total / n, (t + share) / (n + 1)) for n, t, total in steps]
    return law


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the labelled texts that are learned from, each once."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder() != 0)).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = known.count()
    if n > sample:  # the hash's upper bits; about as many as asked for
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < int(2**32 * sample / n))
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # bounded: 12 bytes a row of the sample
    texts = own.join(F.broadcast(known), "doc_id")
    held = written(texts.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), "toxicity-sample")
    once = held.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return held.select("doc_id", "digest", "text").join(F.broadcast(once), ["doc_id", "digest"]).select("text", "toxic")


def counted(texts: DataFrame) -> DataFrame:
    """(entry, t, c): texts with each entry, by label, added up in each task first."""
    schema = "entry string, t long, c long"
    target = arrow_schema(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def out():
            names = list(toxic.keys() | clean.keys())
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([n[x] for x in names], pa.int64()) for n in (toxic, clean))], schema=target)
            toxic.clear()
            clean.clear()
            return made

        for batch in map(pa.RecordBatch.to_pydict, sliced(batches)):
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                (toxic if label else clean).update(entries(text))
            if len(toxic) + len(clean) > 300_000:
                yield out()
        yield out()
        returned()

    return texts.mapInArrow(run, schema).groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MODEL) -> tuple[Counts, Law]:
    """The model of the labelled rows: entries that toxic texts have, and the law."""
    spark, texts = docs.sparkSession, sampled(docs, labels, sample)
    kinds = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    if not n1 or not n0:
        return Counts(n1, n0, {}), Law(curve=[(0.0, float(n1 > 0))])
    # one text tells nothing of others; entries without a toxic text lower no passage's score by much
    strong = counted(texts).where("t > 0 AND t + c > 1").orderBy(F.desc("t"), "entry").limit(most)
    counts = Counts(n1, n0, {r["entry"]: (r["t"], r["c"]) for r in strong.collect()})
    shared = spark.sparkContext.broadcast(counts)

    def scored(batch):
        each = [Scores(shared.value, label) for label in (0, 1)]
        return [(label, *((n, [s for s, _, _ in found]))) for text, label in batch for n, found in [scanned(text, each[label])]]

    alone = written(per_row(texts, "toxic int, n long, found array<double>", scored, ["text", "toxic"]), "toxicity-alone")
    best = F.round(F.coalesce(F.array_max("found"), F.lit(0.0)), 1)
    # tokens by the tenth of their logarithm: a bounded number of rows
    size = F.round(F.exp(F.round(F.log(F.greatest("n", F.lit(1))), 1)), 1)
    groups = alone.where("toxic = 0").groupBy(best.alias("s"), size.alias("n")).agg(F.count(F.lit(1)).alias("k"))
    law = fitted_law([(r["s"], r["n"], r["k"]) for r in groups.collect()])

    def surprises(batch):
        return [(label, round(law.surprise(n, [(s, 0, 0) for s in found]), 2)) for label, n, found in batch]

    seen = per_row(alone, "toxic int, s double", surprises, ["toxic", "n", "found"])
    seen = seen.groupBy(F.least("s", F.lit(FAR)).alias("s"), "toxic").agg(F.count(F.lit(1)).alias("k")).collect()
    return counts, fitted_curve(law, [(r["s"], r["toxic"], r["k"]) for r in seen])


def passages(text: str, scores: Scores, law: Law) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's score, and its significant passages: (start, end, log-odds) in code points."""
    n, found = scanned(text, scores)
    score = law.score(law.surprise(n, found))
    significant = [x for x in found if law.bits(n, x[0]) > 0]
    if not significant:
        return score, []
    places = [m.span() for m in WORD.finditer(text)]
    return score, [(places[first][0], places[after - 1][1], s) for s, first, after in significant]


def scored(docs: DataFrame, model: tuple[Counts, Law], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score, the number of significant passages, and these as start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scores] = []  # a worker's tokens, over its batches

    def rows(batch):
        counts, law = shared.value
        if not held:
            held.append(Scores(counts))
        out = []
        for i, t in batch:
            score, found = passages(t or "", held[0], law)
            out.append((i, score, len(found), ",".join(f"{s}:{e}" for s, e, _ in found)))
        return out

    return per_row(docs, "doc_id long, score double, n_passages long, passages string", rows, [doc_id, text])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = scored(docs, learned(docs, table(spark, sf_dir, "labels")))
    return each.select(
        "doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages"
    )
