"""From raw documents to token ids: each stage works on what the one before kept.

Quality rules, SimHash near-duplicates and benchmark decontamination drop
documents; PII replaces text; BPE adds the ids and a digest of the text decoded from them.

Cases: documents with null, empty or very short texts go in the first stage; very long
texts are worked on whole; of repeated rows one stays, the others go as near-duplicates;
rows without a doc_id stay where they have no copy with one; an empty table gives an empty
one; extra columns are carried, but for ``ids``, ``n_tokens`` and ``decoded_sha256``, which the last stage
makes, and ``n_chars``, which follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, pii, quality, simhash, winnowing
from tidemark.llm.common import shared_dir

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-duplicates", simhash.stage),
    ("benchmark decontamination", winnowing.stage),
    ("personal data", pii.stage),
    ("byte-pair encoding", bpe.stage),
]

#: Surrogates and ids can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written and read again."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
