"""The whole pipeline against plain versions of its stages; the entry with and without it."""

import hashlib

import duckdb
import pandas as pd

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import bpe, pii, quality

from .data import documents, prose
from .test_operators import plain_similar_classes, plain_verdict


def corpus():
    rows = [(i, t, s) for i, t, s, _ in documents()]
    rows += [(800 + k, prose(80 + k, 60), "e") for k in range(6)]
    rows += [(820, prose(82, 60) + " x", "e"), (821, f"{prose(95, 30)} {prose(20, 25)} {prose(96, 30)}", "e")]
    rows += [(822, f"{prose(97, 30)} write to ann.3@mail1.example.com or +1 (988) 555-2485 {prose(98, 10)}", "e")]
    return rows


def test_pipeline_equals_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    table.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, prose(20, 25)), (2, "…"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], columns=["doc_id", "text", "source"]))
    judged = con.sql(f"SELECT kept FROM ({quality.SQL}) ORDER BY doc_id").fetchall()
    left = [r for r, (kept,) in zip(rows, judged, strict=True) if kept]

    groups = {}
    for row, root in zip(left, plain_similar_classes([t for _, t, _ in left]), strict=True):
        groups.setdefault(root, []).append(row)
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    left = [r for r in left if not plain_verdict(r[1], items)[-1]]

    made, known = pii.Surrogates(), Tokenizer.from_file(bpe.default_path())
    want = []
    for i, text, source in left:
        new = made.replaced(text)[0]
        ids = known.encode(new, add_special_tokens=False).ids
        decoded = hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.append((i, new, "en", source, len(new), ids, len(ids), decoded))

    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "decoded_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert not any("ann.3" in r["text"] for r in got.collect()) and 821 not in {r["doc_id"] for r in got.collect()}


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, fp string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, prose(1, 40), "en", "a", 1, 3, "f"), (2, None, None, None, None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.limit(0)):
            assert stage(spark, own, str(tmp_path)).columns == docs.columns
    assert [r["doc_id"] for r in quality.stage(spark, docs, "").collect()] == [1]


def test_entry_has_all():
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
