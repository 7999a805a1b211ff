"""Queries of the corpus operators by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import quality
from vexel.llm.bpe_codec import op6_bpe_codec
from vexel.llm.common import ship
from vexel.llm.decontamination import op5_string_tiling
from vexel.llm.html_extraction import op3_host_suffix_array
from vexel.llm.pii import op7_crf_pii
from vexel.llm.quality import op8_risk_controlled_quality
from vexel.llm.sharding import op10_hash_tree_sharding
from vexel.llm.simhash import op9_simhash_bktree
from vexel.llm.substring_dedup import op1_paragraph_minhash
from vexel.llm.token_counts import op4_token_counts
from vexel.llm.toxicity import op2_noisy_channel_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: tuple[Query, ...] = (
    op1_paragraph_minhash, op2_noisy_channel_toxicity, op3_host_suffix_array, op4_token_counts, op5_string_tiling,
    op6_bpe_codec, op7_crf_pii, op8_risk_controlled_quality, op9_simhash_bktree, op10_hash_tree_sharding,
)


def shipped(query: Query) -> Query:
    """The query, after the package has been given to the executors."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL has no XXH64, CRC, regular expressions over several texts, merges or decoders as the others need; the tests hold those against brute force."""
    return {op8_risk_controlled_quality.__name__: quality.oracle_sql()}
