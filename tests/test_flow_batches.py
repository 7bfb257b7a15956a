"""Pairs of frames that go through the flow together have the flow they have alone; suppliers go to several tasks."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_optical_flow import texture
from tidemark.functions import optical_flow as flow
from tidemark.plans import catalog


@pytest.mark.parametrize("size", [(40, 40), (17, 90), (130, 70), (5, 2), (1, 1)])
def test_pairs_at_once_and_one_by_one(size):
    r = np.random.default_rng(5)
    before, after = r.uniform(0, 255, (2, 3, *size))
    found = flow.dense(before, after)
    assert found.shape == (2, 3, *size)
    assert np.allclose(found, np.stack([flow.dense(a, b) for a, b in zip(before, after, strict=True)], 1), rtol=1e-9, atol=1e-9)


def test_filters_go_by_blocks():
    """Against plain sums, over several blocks and fewer pixels than taps."""
    taps = np.array([0.5, 1.0, 0.0, -2.0, 0.25])
    for n in (1, 3, flow.BLOCK, flow.BLOCK + 1, 2 * flow.BLOCK + 9):
        x = np.random.default_rng(n).uniform(size=(2, n, 3))
        at = np.arange(n)
        held = sum(t * x[:, np.clip(at + k - 2, 0, n - 1)] for k, t in enumerate(taps))
        alone = np.stack([sum(t * x[:, i + k - 2] for k, t in enumerate(taps) if 0 <= i + k - 2 < n) for i in range(n)], 1)
        for edge, want in ((True, held), (False, alone)):
            assert np.allclose(flow._along(x, taps, -2, edge), want)
            assert np.allclose(flow._along(x.swapaxes(1, 2), taps, -1, edge), want.swapaxes(1, 2))


def test_frames_of_several_kinds_in_a_batch(spark):
    """Other sizes, colours, margins and missing frames among them; each row keeps its own."""
    rows = []
    for k in range(40):
        side, dx, dy = (24, 40)[k % 2], k % 5 - 2.0, (k % 3 - 1) / 2
        a, b = texture(side, seed=k).ravel(), texture(side, dx, dy, seed=k).ravel()
        a = np.repeat(a, 3) if k % 4 == 3 else a
        rows.append((k, None if k % 7 == 0 else a.tolist(), None if k == 8 else b.tolist(), k % 3 * 4))
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>, m int").coalesce(1)
    got = {r.k: r.s for r in df.select("k", flow.flow_statistics("a", "b", "m").alias("s")).collect()}
    for k, a, b, m in rows:
        if a is None or b is None:
            assert tuple(got[k]) == (None, None, None)
            continue
        n = int(len(b) ** 0.5)
        dx, dy = flow.dense(flow.grey(a), flow.grey(b))[:, m : n - m, m : n - m]
        assert np.allclose(tuple(got[k]), [np.hypot(dx, dy).mean(), dx.mean(), dy.mean()], rtol=1e-9, atol=1e-9)


def test_what_is_no_frame_is_said():
    good = texture(16).ravel()[None]
    with pytest.raises(ValueError, match="no numbers"):
        flow.statistics(good, np.where(np.arange(256) == 9, np.nan, good), 0)
    with pytest.raises(ValueError, match="shapes"):
        flow.statistics(good, texture(20).ravel()[None], 0)


def test_suppliers_of_one_file_go_to_several_tasks(spark, tmp_path):
    n = 150
    table = pd.DataFrame({"s_suppkey": np.arange(n) + 250_000, "s_nationkey": np.arange(n, dtype="int32") * 7 % 25})
    table.to_parquet(tmp_path / "supplier.parquet")
    df = catalog.QUERIES["flow_shifts"](spark, str(tmp_path))
    tasks = df.select(F.spark_partition_id().alias("p"), "s_suppkey").groupBy("p").count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < n / 2
    moved = lambda key: (key % 9 - 4) / 2
    assert {(r.s_suppkey, r.dx, r.dy) for r in df.collect()} == {(s, moved(s), moved(t)) for s, t in zip(table.s_suppkey, table.s_nationkey, strict=True)}


def test_an_empty_table_and_unknown_keys(spark, tmp_path):
    """As in SQL, a part of the shift that isn't known is null, and the other one is found."""
    for name, keys, nations in (("none", [], []), ("unknown", [4, None, 6], [4, None, None])):
        (tmp_path / name).mkdir()
        file = tmp_path / name / "supplier.parquet"
        pd.DataFrame({"s_suppkey": pd.array(keys, "Int64"), "s_nationkey": pd.array(nations, "Int32")}).to_parquet(file)
        got = catalog.QUERIES["flow_shifts"](spark, str(tmp_path / name)).select("s_suppkey", "dx", "dy", "direction").collect()
        want = duckdb.sql(catalog.ORACLE_SQL["flow_shifts"].replace("FROM supplier", f"FROM '{file}'")).fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == len(keys)
