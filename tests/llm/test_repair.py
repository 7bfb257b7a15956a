"""Operator 12 against a search over all edits, and its damage and counts against plain ones."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
VIABLE = re.compile(r"(s?(ua)*u?)?")


def cheapest(rows):
    """(cost, audit, turns) over all sequences of edits; rows: (role, text, must go, truncated)."""
    best = [(4 * len(rows), "D" * len(rows), ())]

    def go(i, cost, audit, out):
        initials = "".join(r[:1] for r, _ in out)
        if cost > best[0][0] or not VIABLE.fullmatch(initials) or any(not r for r, _ in out):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best[0] = min(best[0], (cost, audit, out))
        if len(audit) < 3 * len(rows) + 3:
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", (*out, (role, "")))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            go(i + 1, cost + 4, audit + "D", out)
            if not must_go:
                go(i + 1, cost + 3 * truncated, audit + "K", (*out, (role, text)))
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + 3 * truncated, audit + "R", (*out, (new, text)))

    go(0, 0, "", ())
    return best[0]


def parsed(rows):
    edits = []
    parser = repair.Parser(lambda letter, turn: edits.append((letter, turn)))
    for r in rows:
        parser.turn(*r)
    return parser.end(), "".join(x for x, _ in edits), tuple(t for _, t in edits if t)


ROWS = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "unknown"]), st.sampled_from(["a", "b"]), st.booleans(), st.booleans())


@settings(max_examples=150, deadline=None)
@given(st.lists(ROWS, max_size=4))
def test_parse_equals_search_over_all_edits(rows):
    assert parsed(rows) == cheapest(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(ROWS, max_size=60), st.integers(1, 5))
def test_settling_changes_nothing(rows, every):
    want, old = parsed(rows), repair.SETTLE
    repair.SETTLE = every
    try:
        assert parsed(rows) == want
    finally:
        repair.SETTLE = old


def test_long_conversations_take_linear_time_and_are_settled_on_the_way():
    def run(n):
        r, out = random.Random(n), []
        parser = repair.Parser(lambda letter, turn: out.append(letter))
        start = time.process_time()
        for i in range(n):
            parser.turn(r.choice(["user", "assistant", "assistant", "system", "tool"]), f"{i}.", r.random() < 0.2, r.random() < 0.2)
        assert len(out) > n - 3 * repair.SETTLE
        parser.end()
        return time.process_time() - start

    run(1000)
    assert run(40_000) < 30 * max(run(4_000), 0.01)


def plain(rows):
    """Whole query, row by row."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = groups[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        faults, judged = {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for k, (_, role, text) in enumerate(own):
            seen = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not seen else "duplicate" if any(x[1:] == (role, text) for x in own[:k]) else "truncated" if seen[-1] not in ".!?" else None
            if fault:
                faults[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, turns = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, digest)
    return sorted(((k, *v) for k, v in out.items()), key=str)


def conversations():
    r, rows = random.Random(8), []
    for conv in range(60):
        for turn in range(r.randint(1, 5)):
            role = "system" if turn == 0 and conv % 4 == 0 else ["user", "assistant"][turn % 2]
            rows.append((conv, turn + (turn > 2) * (conv % 3), role, r.choice(["Yes.", "no!", "What é?", "stop", "a.b", " .\n"]) + (str(turn) + "." if conv % 2 else "")))
    rows += [(100, None, "user", "first?"), (100, 5, "assistant", None), (100, 5, None, "x."), (101, 3, "user", ""), (None, None, None, None), (None, 1, "user", "q?")]
    rows += [(102, 1, "user", "same."), (102, 1, "user", "same."), (102, 2, "assistant", "z" * 300_000 + "."), (103, -4, "", "y."), (103, -1, "robot", "ok. \x1f")]
    return rows


@pytest.fixture
def path(spark, tmp_path):
    spark.createDataFrame([(*x, "extra") for x in conversations()], SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_repairs_equal_plain_ones(spark, path):
    got = sorted((tuple(r) for r in repair.op12(spark, path).collect()), key=str)
    assert got == plain(conversations())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(repair.SQL).fetchall(), key=str) == got
    turns = repair.repaired(repair.damaged(spark.read.parquet(path + "/conversations.parquet"))).orderBy("conv_id", "position").collect()
    by_conv = defaultdict(list)
    for r in turns:
        assert r["position"] == len(by_conv[r["conv_id"]])
        by_conv[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(by_conv[x[0]]).encode()).hexdigest() == x[-1] for x in got)


def test_all_rows_dropped_and_no_rows(spark, tmp_path):
    conv = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(conv, 0, "user", "Hi.", "")], SCHEMA).write.parquet(str(tmp_path / "a/conversations.parquet"))
    assert [tuple(r) for r in repair.op12(spark, str(tmp_path / "a")).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b/conversations.parquet"))
    assert repair.op12(spark, str(tmp_path / "b")).collect() == []
