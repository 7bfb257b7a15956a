"""Batches added to the stored family equal one run over all documents."""

import random
from collections import Counter

import pytest

from tidemark.llm import suffix_index, suffixes

from .data import documents, frame, prose


def corpus():
    r = random.Random(6)
    rows = [x for x in documents() if x[0] is not None] + [(None, None, None, None), (None, prose(1, 120), "d", "x")]
    shared = [prose(700 + k, 12) for k in range(6)]
    for k in range(60):
        rows.append((20 + k, f"{prose(800 + k, 20)} {r.choice(shared)} {prose(900 + k, r.choice([1, 40]))} {r.choice(shared)[10:]}", "e", "x"))
    rows.append((90, "é" * 200 + prose(2, 40) + "é" * 100, "e", "x"))
    return rows


def test_batches_equal_one_run(spark, tmp_path):
    rows = corpus()
    want = Counter(tuple(r) for r in suffixes.digests(frame(spark, rows)).collect())
    assert sum(r[2] > 0 for r in want) > 30
    index = suffix_index.Index(spark, str(tmp_path / "index"))
    got, sizes = Counter(), []
    for lo, hi in ((None, 8), (8, 30), (30, 60), (60, 200)):
        part = [x for x in rows if (x[0] is None if lo is None else False) or (x[0] is not None and (lo or 0) <= x[0] < hi)]
        got += Counter(tuple(r) for r in index.add(frame(spark, part)).collect())
        sizes.append(index.levels())
    assert got == want
    # geometric: each level over twice the one after it, so few
    assert all(a > 2 * b for levels in sizes for a, b in zip(levels, levels[1:], strict=False))
    assert max(map(len, sizes)) <= 3
    with pytest.raises(ValueError, match="not greater"):
        index.add(frame(spark, [(5, "late", "e", "x")]))


def test_empty_batches_change_nothing(spark, tmp_path):
    index = suffix_index.Index(spark, f"file://{tmp_path}/index")
    assert index.add(frame(spark, [])).collect() == [] and index.levels() == []
    index.add(frame(spark, [(1, prose(1, 30), "e", "x")]))
    before = index.levels()
    assert index.add(frame(spark, [])).collect() == [] and index.levels() == before
    # the same index, opened again
    again = suffix_index.Index(spark, f"file://{tmp_path}/index")
    [row] = again.add(frame(spark, [(2, prose(1, 30), "e", "x")])).collect()
    assert row["n_removed"] == row["n_bytes"] and row["n_spans"] == 1
