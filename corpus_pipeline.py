"""A corpus pipeline: documents in, token ids out, in five stages.

Each stage reads all rows its predecessor kept, and its decisions take effect; every
stage's result is written as Parquet in the shared folder and read again by the next.

1. quality: documents that the n-gram model rejects go.
2. near_duplicates: one document of each group stays (5-word shingles, similarity 0.8).
3. decontaminate: documents that hold a passage of a benchmark item go.
4. pii: personal data in the texts becomes marks; every document stays.
5. bpe: ids of every text and the text they decode to (doc_id, n_tokens, ids, decoded).

Defined cases are those of the operators; an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tianguis.llm import bpe, decontaminate, minhash, pii, quality
from tianguis.llm.common import materialise, read_table, ship_package
from tianguis.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"), quality.BYTES)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    path = tokenizer_path()
    return bpe.encoded(docs, path, bpe.build_lexicon(docs, path)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("bpe", encode),
]

# The n-gram model, shingle hashes, edit distance and merges have no SQL form; tests hold
# the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
