"""Corpus pipeline: documents go through STAGES in order, each written as Parquet and read again by the next.

1. quality: documents that the risk-controlled quality rules reject go.
2. near_duplicates: of each SimHash component the document with the least id stays.
3. decontamination: documents of which tiles cover half of a benchmark item go.
4. pii: personal data is replaced by its kind in angle brackets; n_chars follows.
5. bpe: every text is encoded and decoded; ids and the hash of the decoded bytes are returned.

Every stage takes (spark, docs, sf_dir), handles whole texts and keeps columns
it does not know. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vexel.llm.bpe_codec import encode_decode
from vexel.llm.common import scratch_dir, ship, table
from vexel.llm.decontamination import drop_contaminated
from vexel.llm.pii import labelled_sentences, redact, train_model
from vexel.llm.quality import apply_rules
from vexel.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return apply_rules(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return redact(docs, train_model(labelled_sentences()), length_col="n_chars")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True, kept_words=80_000, slice_rows=256)  # workers live on beside stages that need the memory


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]

#: SQL can't express fingerprints, tiling, the CRF or byte-pair merging; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
