"""Autocut: results are cut after the largest relative gap between neighbours, where it is over a fifth.

The DataFrame form works on (rank, score) rows of one result, or of many with a
group column; the list form on plain scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a gap counts if it is larger than this.
LEAST_GAP = 0.2


def _gaps(scores: Sequence[float], sign: int) -> list[float]:
    out = []
    for before, now in zip(scores, scores[1:], strict=False):
        change = sign * (now - before)
        out.append(change / before if before else math.inf if change > 0 else -math.inf if change < 0 else math.nan)
    return out


def _cut(scores: Sequence[float], sign: int) -> list[int]:
    gaps = [-math.inf if math.isnan(g) else g for g in _gaps(scores, sign)]
    if not gaps or max(gaps) <= LEAST_GAP:
        return []
    return list(range(gaps.index(max(gaps)) + 1, len(scores)))


def autocut_scores(scores: Sequence[float]) -> list[int]:
    """Positions to drop from similarities in descending order."""
    return _cut(scores, -1)


def autocut_distances(distances: Sequence[float]) -> list[int]:
    """Positions to drop from distances in ascending order."""
    return _cut(distances, 1)


def autocut(results: DataFrame, ascending: bool = False, score_col: str = "score", rank_col: str = "rank", group_cols: Sequence[str] = (), from_zero: bool = True) -> DataFrame:
    """The rows before the largest gap; all of them where no gap is large enough. ascending: the scores are distances.

    from_zero: a change from 0 is an infinite gap, as in the list form; otherwise it is none, as in SQL.
    """
    ordered = Window.partitionBy(*group_cols).orderBy(rank_col)
    whole = Window.partitionBy(*group_cols)
    before = F.lag(score_col).over(ordered)
    change = (F.col(score_col) - before) * (1 if ascending else -1)
    gap = F.try_divide(change, before)
    if from_zero:
        gap = F.when(before == 0, F.when(change > 0, F.lit(math.inf)).when(change < 0, F.lit(-math.inf))).otherwise(gap)
    rows = results.withColumn("__gap", gap)
    rows = rows.withColumn("__largest", F.max("__gap").over(whole))
    rows = rows.withColumn("__cut", F.min(F.when((F.col("__gap") == F.col("__largest")) & (F.col("__largest") > LEAST_GAP), F.col(rank_col))).over(whole))
    return rows.where(F.col("__cut").isNull() | (F.col(rank_col) < F.col("__cut"))).drop("__gap", "__largest", "__cut")
