"""Operator 13: segments against all segments, counts and log-odds against plain ones, held-out accuracy."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity as tox

from .data import prose

RUDE = "gorbak blenth snarv krulm dresk".split()


def corpus(n: int = 700, seed: int = 5):
    """Clean and toxic texts; rude words come alone or with endings; some labels are wrong."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = re.sub(r"\d+", "", prose(1000 + i, r.choice([20, 60, 200]))).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3 + len(words) // 20):
                words.insert(r.randrange(len(words)), r.choice(RUDE) + r.choice(["", "en", "ischer", "ost"]))
        docs.append((i, " ".join(words), "en", "s"))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic) ^ (i % 97 == 0)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("toxic"))
    docs, labels = corpus()
    docs += [(900, None, None, None), (901, "", "en", "s"), (None, "gorbak blenth snarv krulm", "en", "s"), (902, "7 8 9 !!", "en", "s")]
    docs += [(903, docs[6][1], "de", "t"), (903, docs[6][1], "de", "t"), (904, "x" * 500 + " gorbak " + prose(7, 20000), "en", "s")]
    labels += [(903, 0, 1), (903, 1, None), (900, None, None), (None, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path, docs, labels


def test_held_out_texts_are_told_apart(spark, tables):
    path, docs, _ = tables
    rows = tox.op13(spark, path).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    made = {r["doc_id"]: r for r in rows}
    truth = [(i, i % 6 == 0) for i, *_ in docs if i is not None and i < 700]
    held = [(i, t) for i, t in truth if made[i]["held_out"]]
    assert len(held) > 100 and all(made[i]["predicted"] == t for i, t in held)
    assert all(made[i]["predicted"] == t for i, t in truth)
    assert made[None]["predicted"] == 1 and made[903]["score"] == made[6]["score"]
    assert made[900]["score"] == made[901]["score"] == made[902]["score"] < 0.1 and made[904]["n_passages"] <= 1
    # the passages hold rude words, and begin and end with one
    for i, text, *_ in docs[:200]:
        for s, e in (map(int, x.split(":")) for x in made[i]["passages"].split(",") if x):
            if made[i]["predicted"]:
                assert re.match("|".join(RUDE), text[s:e]), text[s:e]


def test_scores_follow_the_text_alone(spark, tables, tmp_path):
    path, docs, labels = tables
    model = tox.learned(spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet"))
    again = spark.createDataFrame([(10_000 + k, t) for k, (_, t, *_) in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"] - 10_000: r["score"] for r in tox.scored(again, model).collect()}
    want = {r["doc_id"]: r["score"] for r in tox.scored(spark.read.parquet(path + "/documents.parquet"), model).collect()}
    assert all(got[k] == want[i] for k, (i, *_) in enumerate(docs))


@pytest.mark.parametrize("labels,want", [([], 0.0), ([(1, 1, 1)], 1.0), ([(1, 1, 0)], 0.0)])
def test_labels_of_one_kind(spark, labels, want):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    model = tox.learned(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [abs(r["score"] - want) < 2 * tox.TILT for r in tox.scored(docs, model).collect()] == [True, True]
    assert tox.scored(docs.limit(0), model).collect() == []


def test_sample_is_bounded_and_each_text_counts_once(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(4000)], "doc_id long, quality int, toxic int")
    whole = {r["text"]: r["toxic"] for r in tox.sampled(docs, labels).collect()}
    learned = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5]
    assert whole == {f"text {k}": int(any(i % 8 == 1 for i in learned if i // 2 == k)) for k in {i // 2 for i in learned}}
    assert tox.sampled(docs, labels).count() == len(whole)
    assert 300 < tox.sampled(docs, labels, 500).count() < 600


def test_counts_equal_plain_ones(spark):
    texts = [(prose(k, 30), k % 3 == 0) for k in range(40)] + [("Éa éA ÉA", True), ("y" * 100 + " Y" + "y" * 99, False), ("", True)]
    got = {r["entry"]: (r["t"], r["c"]) for r in tox.counted(spark.createDataFrame([(t, int(y)) for t, y in texts], "text string, toxic int").repartition(3)).collect()}
    want = {}
    for t, y in texts:
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", t)}
        words = {tox.folded(w) for w in words}
        for e in words | {w[:4] + "*" for w in words}:
            a, b = want.get(e, (0, 0))
            want[e] = (a + y, b + (not y))
    assert got == want
    assert got["éa"] == (1, 0) and len([e for e in got if e.startswith("#")]) == 2


def test_log_odds_have_priors_and_leave_out_the_own_text():
    counts = tox.Counts(10, 90, {"rude": (8, 0), "rude*": (9, 0), "fine": (2, 60), "fine*": (2, 60), "rare": (1, 0), "rare*": (1, 0)})
    assert counts.log_odds("rude") > counts.log_odds("rudely") > 1 > counts.log_odds("other") == 0 > counts.log_odds("fine")
    assert counts.log_odds("rare") > counts.log_odds("rare", 1) == 0.0
    alone = tox.Counts(9, 90, {"rude": (7, 0), "rude*": (8, 0)})
    assert math.isclose(counts.log_odds("rude", 1), alone.log_odds("rude"))


def all_maximal(x):
    """By the definition: the best segment, then those left and right of it."""
    best, at = 0, None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            s = sum(x[i:j])
            if s > best or (s == best and at and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return [*all_maximal(x[:i]), (best, i, j), *((s, a + j, b + j) for s, a, b in all_maximal(x[j:]))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-7, -3, -2, -1, 1, 2, 4, 8]), max_size=14))
def test_segments_are_all_maximal_ones(x):
    got = tox.segments(np.array(x, float))
    assert sum(s for s, *_ in got) == sum(s for s, *_ in all_maximal(x))
    assert [s for s, *_ in got] == [s for s, *_ in all_maximal(x)]
    assert all(s == sum(x[a:b]) and x[a] > 0 and x[b - 1] > 0 for s, a, b in got)


def test_segments_take_linear_time():
    def seconds(n):
        x = np.tile([5.0, -1.0, 3.0, -6.0, 1.0, -0.5], n)
        x[: 3 * n] -= 0.9
        start = time.process_time()
        tox.segments(x)
        return time.process_time() - start

    seconds(1000)
    assert seconds(80_000) < 30 * max(seconds(10_000), 0.01)


def test_law_is_recovered_from_its_own_draws():
    r = np.random.default_rng(3)
    n = r.integers(50, 5000, 20_000)
    s = (np.log(0.02 * n) - np.log(-np.log(r.random(len(n))))) / 1.3
    law = tox.fitted_law([(round(float(max(a, 0)), 2), float(b), 1) for a, b in zip(s, n, strict=True)])
    assert abs(law.scale - 1.3) < 0.05 and abs(math.log(law.rate / 0.02)) < 0.15
    # a clean text's p is uniform; two passages that are significant say more than one
    p = np.exp([-law.surprise(int(b), [(float(a), 0, 0)]) for a, b in zip(s, n, strict=True) if a > 0])
    assert abs(np.quantile(p, 0.05) - 0.05) < 0.01
    assert law.surprise(300, [(9.0, 0, 1), (9.0, 2, 3)]) > law.surprise(300, [(9.0, 0, 1)]) > law.surprise(3000, [(9.0, 0, 1)])
    assert law.surprise(300, []) == 0


def test_curve_rises():
    seen = [(0.5, 0, 90), (0.5, 1, 9), (3.0, 0, 10), (3.0, 1, 0), (9.0, 0, 1), (9.0, 1, 4), (40.0, 1, 30)]
    law = tox.fitted_curve(tox.Law(), seen)
    scores = [law.score(x / 10) for x in range(0, 700)]
    assert all(a <= b for a, b in zip(scores, scores[1:], strict=False)) and scores[0] < 0.15 and scores[-1] > 0.9
