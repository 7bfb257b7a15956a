"""Operator 11: how filters interact, over all orders in which they can be applied.

A document is reduced to a mask of the filters that it fails, and the corpus to *cells*:
counts by part, mask and label. All orders are then walked by adjacent transpositions
(plain changes): a swap of neighbours leaves the documents that reach the pair, and those
that leave it, as they are, so that only the two swapped steps are worked out again, from
the cells. Each filter's removals are added up along the walk: over the number of orders
they are its Shapley value, here kept as the whole sum.

The filter E (identical to the text of a smaller doc_id) needs the whole table. Texts are
told apart by 128-bit digests. Rows are added up by digest, part, label and doc_id first, so
that a text which a third of all rows have is spread by its ids; what then meets under a digest
is a row for each part and label, with its least doc_id and the rows that have it.

Cases: a null text is empty, a null lang an empty part; a null doc_id is neither smaller nor
larger than another, so that its row never fails E; rows that repeat fail E only if a smaller
doc_id has their text; a text of any length is read whole, once; of several labels of a doc_id
any 1 counts; a null label counts as 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from string import ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
UPPER, SYMBOLS = ascii_uppercase.encode(), b"#$%&*|"

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: str | None) -> tuple[int, bytes]:
    """The mask of A to D that a text fails, and its digest."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII white space
    mask = len(words) < MIN_WORDS
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, UPPER))) > UPPER_PERCENT * len(text or "")) << 2
    mask |= (len(data.translate(None, SYMBOLS)) < len(data)) << 3
    return int(mask), blake2b(data, digest_size=16).digest()


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row: doc_id, part, mask of A to D, digest of the text."""

    def rows(batch):
        return [(i, p or "", *failures(t)) for i, t, p in batch]

    return per_row(docs, "doc_id long, part string, mask int, digest binary", rows, [doc_id, text, part])


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask of A to E, n, good, toxic): documents and, of those, the labelled ones."""
    known = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    judged = masked(documents).join(known, "doc_id", "left").na.fill(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = judged.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # rows that have the least id of their kind; those without an id are apart
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_without"),
    )
    by_digest = by_kind.groupBy("digest").agg(
        F.min("least").alias("first"), F.collect_list(F.struct(*kind[1:], "n", "least", "n_least", "n_without")).alias("kinds")
    )
    each = by_digest.select("first", F.inline("kinds"))
    originals = F.col("n_without") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = each.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask").alias("m"), originals.alias("k")),
            F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - originals).alias("k")),
        )),
    )
    return (
        split.where("k > 0")
        .groupBy("part", F.col("m").alias("mask"))
        .agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))
    )


def plain_changes(n: int) -> Iterator[int]:
    """The places k at which swapping k and k + 1 visits all orders of n things: the largest
    thing that still can moves on in its direction, and larger ones turn round."""
    order, left = list(range(n)), [True] * n
    while True:
        at = {x: i for i, x in enumerate(order)}
        for x in reversed(range(n)):
            i = at[x]
            j = i - 1 if left[x] else i + 1
            if 0 <= j < n and order[j] < x:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            left[y] = not left[y]
        yield min(i, j)


def _step(own: list[tuple[int, int, int, int]], before: int, bit: int) -> tuple[int, ...]:
    """What a filter does after those of the mask ``before``: kept, removed, redundant,
    unique failures, good and toxic documents lost."""
    kept = removed = redundant = unique = good_lost = toxic_lost = 0
    for mask, n, good, toxic in own:
        if mask & bit:
            unique += n * (mask == bit)
            if mask & before:
                redundant += n
            else:
                removed, good_lost, toxic_lost = removed + n, good_lost + good, toxic_lost + toxic
        elif not mask & before:
            kept += n
    return kept, removed, redundant, unique, good_lost, toxic_lost


def walked(own: list[tuple[int, int, int, int]], names: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    of all orders, from (mask, n, good, toxic) cells; filter names[k] has bit 1 << k."""
    order, n = list(range(len(names))), len(names)
    steps = [_step(own, (1 << k) - 1, 1 << k) for k in order]
    sums, visited = [0] * n, []

    def visit():
        for f, s in zip(order, steps, strict=True):
            sums[f] += s[1]
        visited.append((tuple(order), tuple(steps)))

    visit()
    for k in plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        steps[k] = _step(own, before, 1 << order[k])
        steps[k + 1] = _step(own, before | 1 << order[k], 1 << order[k + 1])
        visit()
    return [("".join(names[f] for f in o), k + 1, *s, sums[f]) for o, ss in visited for k, (f, s) in enumerate(zip(o, ss, strict=True))]


def interactions(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """All orders of the filters for each part of ``counted`` (part, mask, n, good, toxic):
    a part has at most a cell for each mask."""
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def rows(batch):
        return [(p, *x) for p, own in batch for x in walked([(c["mask"], c["n"], c["good"], c["toxic"]) for c in own], names)]

    return per_row(by_part, STEPS, rows, ["part", "cells"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), m AS (
  SELECT doc_id, part, (len(words) < 100)::INT AS a, (100 * len(list_distinct(words)) < 80 * len(words))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > first, false)::INT AS e FROM w
), cell AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM f v, f w, f x, f y, f z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cell, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
