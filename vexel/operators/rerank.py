"""Hybrid reranking: search score, hashed character n-grams and fuzzy partial matching in one weighted sum.

Totals are numbers and sorted as numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions.text import fuzzy_partial_ratio, partial_ratio, text_hash_score, text_hash_scores

#: Weights of search, hash and fuzzy score.
WEIGHTS = (0.80, 0.15, 0.05)


def combined(search: Column, hashed: Column, fuzzy: Column, weights: Sequence[float] = WEIGHTS) -> Column:
    return search * weights[0] + hashed * weights[1] + fuzzy * weights[2]


def ranked(rows: DataFrame, k: int, tie_col: str, total_col: str = "total") -> DataFrame:
    """The k rows of highest total, with rank from 0; NaN totals last."""
    order = [F.when(F.isnan(total_col), F.lit(None)).otherwise(F.col(total_col)).desc_nulls_last(), F.asc(tie_col)]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def hybrid_rerank(results: DataFrame, query: str, k: int = 5, weights: Sequence[float] = WEIGHTS, text_col: str = "text", score_col: str = "score", tie_col: str = "rank") -> DataFrame:
    """results (the few rows of a search) with hash_score, fuzzy_score, total and their new rank."""
    rows = results.withColumn("hash_score", text_hash_score(query, F.col(text_col))).withColumn("fuzzy_score", fuzzy_partial_ratio(query, F.col(text_col)))
    rows = rows.withColumn("total", combined(F.col(score_col), F.col("hash_score"), F.col("fuzzy_score"), weights)).withColumnRenamed(tie_col, "__tie")
    return ranked(rows, k, "__tie").drop("__tie")


def hybrid_rerank_results(sentences: Sequence[str], search_scores: Sequence[float], query: str, k: int = 5, weights: Sequence[float] = WEIGHTS) -> tuple[list[str], list[float]]:
    """The same for lists on the driver: the k best sentences and their totals. Inputs that can't be scored come back unchanged, cut to k."""
    if not sentences:
        return [], []
    try:
        hashed = text_hash_scores(query, list(sentences))
        totals = [weights[0] * s + weights[1] * h + weights[2] * partial_ratio(query, t) for s, h, t in zip(search_scores, hashed, sentences, strict=True)]
        order = sorted(range(len(totals)), key=lambda i: (math.isnan(totals[i]), -totals[i] if not math.isnan(totals[i]) else 0, i))[:k]
        return [sentences[i] for i in order], [totals[i] for i in order]
    except Exception:
        return list(sentences[:k]), list(search_scores[:k])
