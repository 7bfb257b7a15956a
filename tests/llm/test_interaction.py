"""Operator 11 against a plain version: every order is run through, document by document."""

import re
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import interaction

from .data import prose

ROWS = [
    (1, "short text", "en"), (2, "short text", "en"), (2, "short text", "en"), (3, "short text", "de"), (None, "short text", "en"),
    (4, None, "en"), (5, "", None), (6, "", "en"), (7, " \n ", "en"), (8, "word " * 150, "en"), (9, "WORD # " * 150, "de"),
    (10, prose(1, 200), "en"), (10, prose(2, 200), "en"), (11, prose(1, 200) + " $", "en"), (12, prose(3, 5000), "fr"),
    (13, "É" * 30 + "A" * 3, "fr"), (14, " ".join(f"w{i}" for i in range(99)), "en"), (15, " ".join(f"w{i}" for i in range(100)), "en"),
    (None, None, None),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (8, None, 1), (10, 1, 0), (12, 1, 1), (99, 1, 1), (None, 1, 1)]


def plain(rows, labels):
    out = {}
    failing = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        good = any(j == i and q == 1 for j, q, _ in labels if j is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if j is not None)
        failing.append((lang or "", fails, good, toxic))
    for part in {p for p, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture
def tables(spark, tmp_path):
    def written(rows, labels):
        spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS part").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return written


def test_interactions_equal_all_orders_and_sql(spark, tables):
    path = tables(ROWS, LABELS)
    got = sorted(tuple(r) for r in interaction.op11(spark, path).collect())
    assert got == plain(ROWS, LABELS)
    assert len(got) == 4 * 600
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(interaction.SQL).fetchall()) == got


def test_no_documents(spark, tables):
    assert interaction.op11(spark, tables([], [])).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 4), st.data())
def test_walk_equals_plain_orders(n, data):
    masks = data.draw(st.lists(st.tuples(st.integers(0, 2**n - 1), st.integers(1, 9)), max_size=12))
    own, names = [(m, k, k // 2, k // 3) for m, k in masks], "PQRS"[:n]
    want, sums = {}, dict.fromkeys(names, 0)
    for order in permutations(range(n)):
        gone = 0
        for k, f in enumerate(order):
            hit = [x for x in own if x[0] >> f & 1 and not x[0] & gone]
            gone |= 1 << f
            sums[names[f]] += sum(x[1] for x in hit)
            kept = sum(x[1] for x in own if not x[0] & gone)
            want["".join(names[i] for i in order), k + 1] = (kept, sum(x[1] for x in hit), sum(x[2] for x in hit), sum(x[3] for x in hit))
    got = interaction.walked(own, names)
    assert {(o, k): (kept, removed, good, toxic) for o, k, kept, removed, _, _, good, toxic, _ in got} == want
    assert all(s == sums[o[k - 1]] for o, k, *_, s in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_all_orders_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in interaction.plain_changes(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert len(seen) == len(list(permutations(range(n)))) == 1 + sum(1 for _ in interaction.plain_changes(n))
